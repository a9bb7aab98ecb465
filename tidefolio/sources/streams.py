"""Unbounded sources and the typing of their payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
           files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files under ``path``."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def topic(spark: SparkSession, servers: str, name: str, **options: str) -> DataFrame:
    """Stream of a Kafka topic (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", name).options(**options).load()


def decode(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON payload into typed columns plus a ``malformed`` flag.

    Works on batches and streams alike. A payload that is no JSON, or whose
    fields do not fit their types, keeps its row with ``malformed = true``.
    """
    fields = T.StructType.fromDDL(schema)
    with_bad = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = df.withColumn("_payload", F.from_json(F.col(column).cast("string"), with_bad, options))
    bad = F.col("_payload").isNull() | F.col("_payload._bad").isNotNull()
    return parsed.select(
        *df.columns,
        *[F.col(f"_payload.{f.name}").alias(f.name) for f in fields.fields],
        bad.alias("malformed"),
    )


def well_formed(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("malformed")).drop("malformed")


def malformed(decoded: DataFrame, column: str) -> DataFrame:
    """The side output: payloads that did not decode."""
    return decoded.filter("malformed").select(column)
