"""Parquet scans."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None,
         column: str = "date") -> DataFrame:
    """Read a table, optionally only ``date_from <= date <= date_to``.

    On a table laid out by date the bounds become partition filters: other
    folders are not opened.
    """
    df = spark.read.parquet(path)
    if date_from is not None:
        df = df.filter(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.filter(F.col(column) <= F.lit(date_to).cast("date"))
    return df


def scan_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """Like :func:`scan`, but None where the table is missing or its files are no Parquet (see :func:`why_not`)."""
    return None if why_not(spark, path) else scan(spark, path)


def why_not(spark: SparkSession, path: str) -> str | None:
    """Why a table cannot be opened, in one line; None if it can."""
    try:
        scan(spark, path)
        return None
    except (AnalysisException, PySparkException, Py4JError) as reason:
        return str(reason).strip().splitlines()[0][:300]


def scan_all(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame | None]:
    return {name: scan_if_present(spark, path) for name, path in paths.items()}


def of_type(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one kind; the comparison is pushed to the Parquet reader."""
    return df.filter(F.col(column) == value)


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
