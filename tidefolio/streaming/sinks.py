"""Running streams into tables and topics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidefolio.operators import layout
from tidefolio.operators.keysets import last_of_each
from tidefolio.sources.streams import stream
from tidefolio.storage import new_path


def land(rows: DataFrame, path: str, checkpoint: str, partition_by: str | None = None,
         every: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once.

    Runs until the available input is used up, or each ``every`` (for example
    ``"60 seconds"``) for good.
    """
    writer = (rows.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def land_changes(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Log what changed in each micro-batch (update mode), with the batch's number as ``version``.

    A batch that is run again writes the same folder again, so each counts once. Runs until the
    available input is used up, or each ``every`` for good.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def changes(rows: DataFrame, path: str) -> DataFrame:
    """The log that :func:`land_changes` wrote for ``rows``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("version", T.LongType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The last micro-batch that a stream has finished, from its checkpoint."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return max((int(n) for n in names if n.isdigit()), default=None)


def fold(spark: SparkSession, path: str, checkpoint: str, keys: Sequence[str]) -> dict[str, int]:
    """Fold the finished versions of a change log into the last of them, one row a key; returns versions folded and rows left.

    The newest row of each key carries the number of the last finished batch afterwards, which later versions
    exceed as before, so readers need not know. New files come before old ones go: in between a key's newest row is there
    twice, which a view of the newest row does not show. The log is then as long as its keys, and what came since. Readers that
    listed the old files must list again.
    """
    layout.finish(spark, path)
    last = committed(spark, checkpoint)
    versions = sorted(int(v) for v in layout.stored_days(spark, path, "version") if last is not None and int(v) <= last)
    if len(versions) < 2:
        return {"versions": 0, "rows": 0}
    folders = [f"{path}/version={v}" for v in versions]
    rows = spark.read.option("basePath", path).parquet(*folders)
    aside = f"{path}/{layout.JOURNAL}-new"
    last_of_each(rows, keys, F.col("version").cast("bigint")).drop("version").write.mode("overwrite").parquet(aside)
    left = spark.read.parquet(aside).count()
    new = [(name, f"{folders[-1]}/folded-{name.rpartition('/')[2]}") for name in layout.files_of(spark, aside)]
    layout.replace_files(spark, path, new, [name for folder in folders for name in layout.files_of(spark, folder)])
    layout.remove_days(spark, path, [str(v) for v in versions[:-1]], "version")
    return {"versions": len(versions), "rows": left}


def drained(rows: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Run a stream over all available input and return the table it wrote."""
    path = new_path(rows.sparkSession, label)
    land(rows, f"{path}/table", f"{path}/checkpoint", partition_by).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/table").select(*rows.columns)


def replayed(arrivals: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], label: str,
             updates: bool = False) -> DataFrame:
    """Feed batches one after the other through one stream that stops in between.

    Each batch is landed as files, then the stream resumes from its checkpoint
    and takes all of them, so the cuts between micro-batches are those between
    the given batches at any number of files. With ``updates`` the result is the log of changes. What arrived and the
    checkpoint are removed after the last batch.
    """
    path, result = None, None
    for batch in arrivals:
        path = path or new_path(batch.sparkSession, label)
        batch.write.mode("append").parquet(f"{path}/arrived")
        result = build(stream(batch.sparkSession, f"{path}/arrived", batch.schema))
        (land_changes if updates else land)(result, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    for used in ("arrived", "checkpoint"):
        layout.remove_table(result.sparkSession, f"{path}/{used}")
    if updates:
        return changes(result, f"{path}/table")
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/table").select(*result.columns)


def to_messages(rows: DataFrame, key: str) -> DataFrame:
    """Rows as (key, value) messages, the value being JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def publish(rows: DataFrame, key: str, servers: str, topic: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Send a stream to a Kafka topic (needs the Kafka connector on the class path).

    Runs until the available input is used up, or each ``every`` for good.
    """
    writer = (to_messages(rows, key).writeStream.format("kafka")
              .option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
