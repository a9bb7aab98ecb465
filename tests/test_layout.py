import os

import pytest
from pyspark.sql import functions as F
from tests.conftest import day, plan_of, rows, settings

from tidefolio.operators import layout, serving
from tidefolio.sources.tables import scan, scan_if_present
from tidefolio.storage import new_path


def dated(spark, *days):
    return spark.createDataFrame([(d, day(f"2024-01-{d:02d}")) for d in days], "n long, date date")


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_by_date_replaces_all_or_given_dates(spark):
    path = new_path(spark, "t")
    layout.write_by_date(dated(spark, 1, 2), path)
    layout.write_by_date(dated(spark, 2, 3), path, only_given_dates=True)
    assert [r["n"] for r in rows(scan(spark, path), "n")] == [1, 2, 3]
    layout.write_by_date(dated(spark, 4), path)
    assert [r["n"] for r in rows(scan(spark, path), "n")] == [4]


def test_few_files_per_date(spark):
    path = new_path(spark, "t")
    many = spark.range(1000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"))
    layout.write_by_date(many.repartition(16), path)
    assert len(files(path)) == 3


def test_date_range_prunes_partitions(spark):
    path = new_path(spark, "t")
    layout.write_by_date(dated(spark, *range(1, 11)), path)
    ranged = scan(spark, path, "2024-01-04", "2024-01-05")
    assert [r["n"] for r in rows(ranged, "n")] == [4, 5]
    assert "PartitionFilters: [isnotnull(date" in plan_of(ranged)
    assert len(ranged.inputFiles()) > 0 and scan_if_present(spark, path + "-missing") is None


def test_new_dates_and_rows(spark):
    source, target = dated(spark, 1, 2, 3, 3), dated(spark, 1)
    assert [r["date"].day for r in rows(layout.new_dates(source, target), "date")] == [2, 3]
    assert [r["n"] for r in rows(layout.new_rows(source, target), "n")] == [2, 3, 3]


def test_compaction_keeps_rows_in_fewer_files(spark):
    small, big = new_path(spark, "small"), new_path(spark, "big")
    dated(spark, *range(1, 29)).repartition(20).write.parquet(small)
    got = layout.compact(spark.read.parquet(small), big)
    assert rows(got, "n") == rows(spark.read.parquet(small), "n")
    assert len(files(big)) < len(files(small))


def test_clustering_splits_a_hot_key(spark):
    """Half of all rows have one key; they must not end up in one file."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        parts = layout.cluster(df, "k").withColumn("p", F.spark_partition_id())
        sizes = {r["p"]: r["count"] for r in parts.groupBy("p").count().collect()}
        spans = parts.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo", "hi").collect()
    assert len(sizes) == 4 and max(sizes.values()) < 7000
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_clustering_splits_copies(spark):
    df = spark.range(20_000, numPartitions=8).select(F.lit(7).alias("k"))
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = [r["count"] for r in layout.cluster(df, "k").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_merge(spark):
    batch = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, n double, s string")
    live = spark.createDataFrame([("b", 0.5, None), ("c", 3.0, "z")], "k string, n double, s string")
    got = serving.merge(batch, live, ["k"], add=["n"], replace=["s"])
    assert [(r["k"], r["n"], r["s"]) for r in rows(got, "k")] == [("a", 1.0, "x"), ("b", 2.5, "y"), ("c", 3.0, "z")]


def test_reconcile(spark):
    batch = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    live = spark.createDataFrame([("a", 1.005), ("b", 2.5), ("d", 4.0)], "k string, v double")
    got = serving.reconcile(batch, live, ["k"], "v")
    assert [(r["k"], r["status"]) for r in rows(got, "k")] == [
        ("a", "match"), ("b", "mismatch"), ("c", "batch_only"), ("d", "rt_only")]


def test_latest_view_expires(spark):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "gone")], "k string, at int, v string")
    got = serving.latest_view(log, ["k"], ["at"], "at", "2")
    assert rows(got) == [{"k": "a", "at": 2, "v": "new"}]


def files_that_may_hold(path, column, value):
    """Files whose footers do not rule the value out, and all files."""
    import glob

    import pyarrow.parquet as pq
    names = glob.glob(f"{path}/*.parquet")
    met = 0
    for name in names:
        meta = pq.read_metadata(name)
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        met += any(s.min <= value <= s.max for s in stats)
    return met, len(names)


def test_a_filter_on_either_column_skips_most_files(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 1000).cast("int").alias("a"),
                                     F.concat(F.lit("user"), F.lpad((F.col("id") * 104729 % 5000).cast("string"), 5, "0")).alias("b"), "id")
    hot = spark.range(100_000).select(F.lit(500).alias("a"), F.lit("user02500").alias("b"), (F.col("id") + 10 ** 6).alias("id"))
    path = new_path(spark, "curve")
    layout.cluster_by_curve(df.unionByName(hot), "a", "b", files=48).write.parquet(path)
    for column, values in (("a", (3, 250, 777, 999)), ("b", ("user00007", "user01234", "user04999"))):
        for value in values:
            met, whole = files_that_may_hold(path, column, value)
            assert met < whole / 3 and whole >= 40, (column, value, met, whole)
    back = spark.read.parquet(path)
    assert back.count() == 300_000 and back.agg(F.sum("id")).first()[0] == df.unionByName(hot).agg(F.sum("id")).first()[0]
    most = max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect())
    assert most < 3 * 300_000 / 48  # the hot cell covers several files
    empty = layout.cluster_by_curve(df.limit(0), "a", "b", files=4)
    assert empty.count() == 0


def test_the_curve_visits_every_cell_and_moves_by_one():
    for bits in (1, 2, 3, 6):
        size = 1 << bits
        at = {place: divmod(cell, size) for cell, place in enumerate(layout._cells(bits))}
        assert sorted(at) == list(range(size * size))
        assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(size * size - 1))


def test_only_small_files_are_compacted(spark):
    path = new_path(spark, "small")
    big = spark.range(200_000).select(F.xxhash64("id").alias("x"), F.lit("2024-01-01").cast("date").alias("date"))
    big.coalesce(1).write.partitionBy("date").parquet(path)
    for i in range(4):
        spark.range(50).select(F.xxhash64("id", F.lit(i)).alias("x"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("date")) \
            .coalesce(1).write.mode("append").partitionBy("date").parquet(path)
    spark.range(3).select(F.col("id").alias("x"), F.lit("2024-01-09").cast("date").alias("date")).coalesce(1).write.mode("append").partitionBy("date").parquet(path)
    before, want = layout._days(spark, path, None, "date"), sorted(map(tuple, spark.read.parquet(path).collect()))
    largest = max(os.path.getsize(f.removeprefix("file:")) for f in big.sparkSession.read.parquet(path).inputFiles() for f in [f.replace("file://", "")])
    done = layout.compact_small(spark, path, largest)
    after = layout._days(spark, path, None, "date")
    assert done == {"removed": 8, "added": 2} and sorted(map(tuple, spark.read.parquet(path).collect())) == want
    parquet = lambda names: {n for n in names if n.endswith(".parquet")}
    kept = parquet(before["2024-01-01"]) & parquet(after["2024-01-01"])
    assert len(kept) == 1 and len(parquet(after["2024-01-01"])) == 2 and before["2024-01-09"] == after["2024-01-09"]
    assert layout.compact_small(spark, path, largest) == {"removed": 0, "added": 0}


def test_a_compaction_that_died_is_finished(spark, monkeypatch):
    path = new_path(spark, "journal")
    for i in range(3):
        spark.range(20).select((F.col("id") + 20 * i).alias("x"), F.lit("2024-01-01").cast("date").alias("date")).coalesce(1) \
            .write.mode("append").partitionBy("date").parquet(path)
    apply, calls = layout.finish, []

    def once(*given):
        calls.append(given)
        if len(calls) == 2:
            raise RuntimeError("lost")
        apply(*given)
    with monkeypatch.context() as patch:
        patch.setattr(layout, "finish", once)
        with pytest.raises(RuntimeError):
            layout.compact_small(spark, path, 10 ** 6)
    assert layout.compact_small(spark, path, 10 ** 6) == {"removed": 0, "added": 0}
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == list(range(60)) and len(spark.read.parquet(path).inputFiles()) == 1
