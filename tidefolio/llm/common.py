"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (starts a job).

    Cuts lineage for executors that may be lost, freezes generated ids, and lets
    Catalyst see the real size. zstd, because these tables are read once or twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm, folder = df.sparkSession._jvm, files[0].rpartition("/")[0]
            if "/tidefolio/" in folder:  # only what ``stored`` made
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def named(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct rows of ``columns`` with an integer ``name`` each, by sort order within hash partitions.

    Two rows get one name exactly if they are equal: no hashing decides. Names are
    frozen in a stored table, since a second evaluation may number otherwise.
    """
    ordered = df.select(*columns).distinct().sortWithinPartitions(*columns)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()), label)
