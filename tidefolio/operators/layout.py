"""Writing tables: by date, incrementally, compacted, clustered."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefolio.operators.keysets import only_in


def write_table(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table."""
    df.write.mode("overwrite").parquet(path)


def write_by_date(df: DataFrame, path: str, column: str = "date", only_given_dates: bool = False,
                  finish: Callable[[DataFrame], DataFrame] | None = None, gather: bool = True) -> None:
    """Replace a table laid out as ``date=YYYY-MM-DD`` folders.

    The rebalance hint gathers each date in few files and lets AQE split a date
    that is too large for one task. With ``only_given_dates`` just the dates in
    ``df`` are replaced; by default the whole table is. What ``finish`` adds to a row (ids, texts) is worked out after
    the rows have met and does not cross the network. Without ``gather`` rows are written where they are, which
    is for those read from few files a date (:func:`lies_gathered`).
    """
    mode = "dynamic" if only_given_dates else "static"
    rows = df.hint("rebalance", F.col(column)) if gather else df
    ((rows if finish is None else finish(rows)).write.mode("overwrite")
     .option("partitionOverwriteMode", mode).partitionBy(column).parquet(path))


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _days(spark: SparkSession, path: str, since: str | None, column: str) -> dict[str, frozenset[str]]:
    """The ``date=`` folders from ``since`` on (None: all), with the names of their files."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return {}
    found = {}
    for entry in files.listStatus(where):
        name, _, value = entry.getPath().getName().partition("=")
        if name == column and (since is None or value >= since):
            found[value] = frozenset(f.getPath().getName() for f in files.listStatus(entry.getPath()))
    return found


def remove_dates(spark: SparkSession, path: str, since: str | None, keep: Collection[str] = (),
                 column: str = "date") -> None:
    """Remove the ``date=`` folders from ``since`` on (None: all) but those in ``keep``."""
    files, _ = _folder(spark, path)
    for value in _days(spark, path, since, column):
        if value not in keep:
            files.delete(_folder(spark, f"{path}/{column}={value}")[1], True)


def replace_since(df: DataFrame, path: str, since: str | None, column: str = "date",
                  finish: Callable[[DataFrame], DataFrame] | None = None, gather: bool = True) -> None:
    """Replace a table by date, in full or from ``since`` on; days that ``df`` lacks are gone afterwards.

    Days are written before those that kept their old files are removed, so a run that died
    in between leaves old days, not gaps, and writing again puts them right. ``df`` has no day
    before ``since``.
    """
    if since is None:
        write_by_date(df, path, column, finish=finish, gather=gather)
        return
    before = _days(df.sparkSession, path, since, column)
    write_by_date(df, path, column, only_given_dates=True, finish=finish, gather=gather)
    after = _days(df.sparkSession, path, since, column)
    written = [day for day, names in after.items() if names != before.get(day)]
    remove_dates(df.sparkSession, path, since, written, column)


def lies_gathered(spark: SparkSession, path: str, column: str = "date", few: int = 8, large: int = 32 << 20) -> bool:
    """Whether the dates of a table are few files or large ones: then a copy of it need not be shuffled to be so, too."""
    files, where = _folder(spark, path)
    dates = [files.listStatus(entry.getPath()) for entry in files.listStatus(where) if entry.getPath().getName().startswith(f"{column}=")]
    sizes = [f.getLen() for found in dates for f in found]
    return len(sizes) <= few * len(dates) or sum(sizes) >= large * len(sizes)


def stored_days(spark: SparkSession, path: str, column: str = "date") -> list[str]:
    """The days of a table laid out by date, from its folders, in order."""
    return sorted(day for day, names in _days(spark, path, None, column).items() if names)


def remove_table(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    if files.exists(where):
        files.delete(where, True)


def in_days(df: DataFrame, days: Collection[str], column: str = "date") -> DataFrame:
    """Rows of the given days; on a table laid out by date other folders are not opened."""
    return df.filter(F.col(column).isin([F.lit(d).cast("date") for d in sorted(days)])) if days else df.filter(F.lit(False))


def not_in_days(df: DataFrame, days: Collection[str], column: str = "date") -> DataFrame:
    return df.filter(~F.col(column).isin([F.lit(d).cast("date") for d in sorted(days)])) if days else df


def days_of(df: DataFrame, column: str = "date") -> list[str]:
    """The distinct days of ``df``, in order; a calendar bounds them."""
    return sorted(str(r[0]) for r in df.select(column).distinct().collect() if r[0] is not None)


def remove_days(spark: SparkSession, path: str, days: Collection[str], column: str = "date") -> None:
    """Remove the ``date=`` folders of the given days."""
    files, _ = _folder(spark, path)
    for value in days:
        where = _folder(spark, f"{path}/{column}={value}")[1]
        if files.exists(where):
            files.delete(where, True)


def replace_days(df: DataFrame, path: str, days: Collection[str] | None, column: str = "date",
                 finish: Callable[[DataFrame], DataFrame] | None = None, gather: bool = True) -> None:
    """Replace the given days of a table (None: all of it); those that ``df`` lacks are gone afterwards.

    ``df`` has no other days. Days are written before emptied ones are removed.
    """
    if days is None:
        write_by_date(df, path, column, finish=finish, gather=gather)
        return
    before = _days(df.sparkSession, path, None, column)
    write_by_date(df, path, column, only_given_dates=True, finish=finish, gather=gather)
    after = _days(df.sparkSession, path, None, column)
    remove_days(df.sparkSession, path, [d for d in days if d in after and after[d] == before.get(d)], column)


def day_marks(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """Per day of a stored table: its rows and its newest file's time, which shows late and corrected rows.

    Reads the footers, no column.
    """
    return (spark.read.parquet(path).select(column, F.col("_metadata.file_modification_time").alias("_t"))
            .groupBy(column).agg(F.count(F.lit(1)).alias("num_rows"), F.max("_t").alias("newest")))


def changed_days(before: DataFrame, now: DataFrame, column: str = "date") -> list[str]:
    """Days whose marks differ, or that only one side has."""
    sides = before.select(column, "num_rows", "newest", F.lit(1).alias("_n")).unionByName(
        now.select(column, "num_rows", "newest", F.lit(1).alias("_n")))
    return days_of(sides.groupBy(column, "num_rows", "newest").agg(F.sum("_n").alias("_n")).filter("_n = 1"), column)


def new_dates(source: DataFrame, target: DataFrame, column: str = "date") -> DataFrame:
    """Dates that the source has and the target does not have yet."""
    return only_in(source, target, column)


def new_rows(source: DataFrame, target: DataFrame, column: str = "date") -> DataFrame:
    """Source rows of dates that the target does not have yet.

    Dates are broadcast: a calendar bounds them (a century has 36,525). On a
    table laid out by date they prune the source's folders at run time. A column
    of another type is left to Catalyst's threshold.
    """
    dates = new_dates(source, target, column)
    if isinstance(source.schema[column].dataType, T.DateType):
        dates = F.broadcast(dates)
    return source.join(dates, column, "left_semi").select(*source.columns)


def compact(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Rewrite many small files as few of the advisory size, to a new path.

    The old files stay until the caller switches over, so a failed run loses
    nothing. Returns the compacted table.
    """
    rows = df.hint("rebalance", F.col(partition_by)) if partition_by else df.hint("rebalance")
    writer = rows.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def cluster(df: DataFrame, *columns: str) -> DataFrame:
    """Sort rows into files by ``columns`` so that reads on them skip row groups.

    Ranges are cut by the columns, then by a hash of the row, then by the input
    partition: a key with a third of all rows covers several files instead of
    one, even if those rows are copies of each other. All three are the same
    when a lost task runs again.
    """
    spread = df.withColumns({"_hash": F.xxhash64(*df.columns), "_part": F.spark_partition_id()})
    ranged = spread.repartitionByRange(*columns, "_hash", "_part")
    return ranged.sortWithinPartitions(*columns).drop("_hash", "_part")


def _ordinal(df: DataFrame, column: str) -> Column:
    """A column as a number in the same order: texts by their first seven bytes."""
    if isinstance(df.schema[column].dataType, T.StringType):
        head = F.rpad(F.substring(F.col(column).cast("binary"), 1, 7), 7, F.lit(b"\x00"))
        return F.conv(F.hex(head), 16, 10).cast("bigint")
    return F.col(column)


def _rank(value: Column, bounds: list) -> Column:
    """How many of the ordered bounds are at most ``value``, by halving."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(bounds[middle]), among(middle + 1, high)).otherwise(among(low, middle))
    return F.coalesce(among(0, len(bounds)), F.lit(0)).cast("bigint")


def _cells(bits: int) -> list[int]:
    """Place on the Hilbert curve of each cell of a square grid, row by row: four smaller curves, turned so that ends meet."""
    if bits == 0:
        return [0]
    inner, half = _cells(bits - 1), 1 << (bits - 1)
    size, quarter = 2 * half, half * half
    out = [0] * (size * size)
    for x in range(half):
        for y in range(half):
            at = inner[x * half + y]
            out[y * size + x] = at  # mirrored
            out[x * size + half + y] = quarter + at
            out[(half + x) * size + half + y] = 2 * quarter + at
            out[(size - 1 - y) * size + half - 1 - x] = 3 * quarter + at  # mirrored the other way
    return out


def curve(df: DataFrame, first: str, second: str, bits: int = 6) -> Column:
    """The place of a row on a Hilbert curve through two columns (starts a job).

    Each column is cut into ``2 ** bits`` ranges of about as many rows, found by one aggregate over all of
    them. Neighbours on the curve are neighbours in the grid, so a stretch of it is narrow in both columns. NULL is in
    the first range.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    places = {c: _ordinal(df, c) for c in (first, second)}
    found = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, steps)), 10_000).alias(c) for c, v in places.items()]).first()
    one, other = (_rank(places[c], sorted(set(found[c] or []))) for c in (first, second))
    table = F.split(F.lit(",".join(map(str, _cells(bits)))), ",").cast("array<int>")
    return table[(one * (1 << bits) + other).cast("int")]


def cluster_by_curve(df: DataFrame, first: str, second: str, files: int | None = None, bits: int = 6) -> DataFrame:
    """Sort rows into files so that a filter on *either* column skips most of them.

    In a plain sort only the first column does. A cell of the curve that holds more rows than a file takes is cut by a
    hash of the row, then by the input partition, as in :func:`cluster`.
    """
    spread = df.withColumns({"_place": curve(df, first, second, bits), "_hash": F.xxhash64(*df.columns), "_part": F.spark_partition_id()})
    order = ["_place", "_hash", "_part"]
    ranged = spread.repartitionByRange(files, *order) if files else spread.repartitionByRange(*order)
    return ranged.sortWithinPartitions("_place", first, second).drop(*order)


JOURNAL = "_compaction"


def small_files(spark: SparkSession, path: str, limit: int, column: str = "date") -> dict[str, list[str]]:
    """Files below half of ``limit`` bytes in each day's folder that has two or more of them."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return {}
    found = {}
    for folder in files.listStatus(where):
        if folder.isDirectory() and folder.getPath().getName().startswith(f"{column}="):
            small = sorted(str(f.getPath()) for f in files.listStatus(folder.getPath())
                           if f.isFile() and f.getPath().getName().endswith(".parquet") and f.getLen() < limit // 2)
            if len(small) > 1:
                found[folder.getPath().getName()] = small
    return found


def compact_small(spark: SparkSession, path: str, limit: int, column: str = "date") -> dict[str, int]:
    """Merge the small files of each day of a table where it lies; returns files removed and added.

    Planned from the file listing: files of half the ``limit`` or more are neither read nor renamed, and
    days with a single small file are left alone. New files are written aside; a journal then says which come and
    which go, and is applied file by file. A run that died is finished from its journal first, or,
    if it died before that, leaves a folder that nothing reads. Readers must not list the table in between.
    """
    finish(spark, path)
    plan = small_files(spark, path, limit, column)
    if not plan:
        return {"removed": 0, "added": 0}
    aside = f"{path}/{JOURNAL}-new"
    old = [name for names in plan.values() for name in names]
    rows = spark.read.option("basePath", path).parquet(*old)
    rows.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(aside)
    files, _ = _folder(spark, path)
    new = [(str(f.getPath()), f"{path}/{day}/{f.getPath().getName()}") for day in plan
           for f in files.listStatus(_folder(spark, f"{aside}/{day}")[1]) if f.getPath().getName().endswith(".parquet")]
    replace_files(spark, path, new, old)
    return {"removed": len(old), "added": len(new)}


def files_of(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files right in a folder."""
    files, where = _folder(spark, folder)
    return sorted(str(f.getPath()) for f in files.listStatus(where) if f.getPath().getName().endswith(".parquet")) if files.exists(where) else []


def replace_files(spark: SparkSession, path: str, new: list[tuple[str, str]], old: list[str]) -> None:
    """Move new files to their targets, then remove old ones, by a journal in ``path`` that a later call finishes."""
    steps = [("add", a, b) for a, b in new] + [("remove", name, "") for name in old]
    spark.createDataFrame(steps, "step string, file string, target string").coalesce(1).write.mode("overwrite").json(f"{path}/{JOURNAL}")
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Finish what a journal says; each step may have been done already."""
    files, journal = _folder(spark, f"{path}/{JOURNAL}")
    if files.exists(_folder(spark, f"{path}/{JOURNAL}/_SUCCESS")[1]):
        steps = spark.read.schema("step string, file string, target string").json(f"{path}/{JOURNAL}").collect()
        for row in sorted(steps, key=lambda r: r.step):  # "add" goes first
            source = _folder(spark, row.file)[1]
            if row.step == "add" and files.exists(source):
                files.rename(source, _folder(spark, row.target)[1])
            elif row.step == "remove":
                files.delete(source, False)
    files.delete(journal, True)
    remove_table(spark, f"{path}/{JOURNAL}-new")
