"""Where jobs keep tables that must outlive a task or a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# What holds inside of :func:`scratch`. Parquet files are a third smaller by zstd than by snappy. Plans whose generated method is
# larger than what the JVM compiles run faster by operators.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.codegen.hugeMethodLimit": "8000"}
_stored: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is missing and the
    session is local; on a cluster a missing setting is an error, because an
    executor's own disk is not visible to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidefolio-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tidefolio/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (starts a job).

    Cuts lineage so that a lost executor re-reads files, and gives Catalyst the
    real size of a derived table, which is what its broadcast threshold checks.
    """
    path = new_path(df.sparkSession, label)
    if _stored.get() is not None:
        _stored.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Holds the disk that a job takes down to its tables, and to what the running query shuffles.

    Tables that :func:`written` stores inside are removed at the end, so nothing lazy that reads them may leave the block.
    The files of a shuffle go when its query ends; Spark alone keeps them until the driver collects its
    garbage, which a large heap may never do. What is stored inside is compressed by zstd. These settings hold for
    the whole session meanwhile.
    """
    before = {name: spark.conf.get(name, None) for name in LEAN}
    outer = _stored.set([])
    try:
        for name, value in LEAN.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        for path in _stored.get():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _stored.reset(outer)
