"""What the plans must look like: pushdown, pruning, few shuffles, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of, settings

import __spark_entry__ as entry
from tidefolio.operators import layout, market, positions, quality, rewards, serving
from tidefolio.sources.testtables import TestTables
from tidefolio.storage import new_path, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return TestTables(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, tables):
    """The domain tables as files, as a lake has them."""
    return {n: written(getattr(tables, n)(), n) for n in ("transactions", "prices", "rewards", "spend", "users")}


def exchanges(plan):
    """Hash shuffles of a plan, by their keys."""
    return re.findall(r"Arguments: hashpartitioning\(([^)]*)\), ENSURE", plan)


def test_filter_reaches_the_reader(spark):
    plan = plan_of(entry.queries()["filter_by_type"](spark, SF))
    assert "EqualTo(event_type,purchase)" in plan and "props" not in plan


def test_snapshot_reads_only_its_columns(stored):
    plan = plan_of(positions.snapshot(stored["transactions"], stored["prices"]))
    schemas = re.findall(r"ReadSchema: (.*)", plan)
    assert any("quantity" in s and "price:" not in s for s in schemas)


def test_snapshot_shuffles_twice(stored):
    plan = plan_of(positions.snapshot(stored["transactions"], stored["prices"]))
    keys = [re.sub(r"#\d+L?", "", k) for k in exchanges(plan)]
    assert keys == ["user_id, symbol, date, 4", "user_id, symbol, 4"]
    assert "partial_try_sum" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_summary_shuffles(stored):
    """Two for the daily sums and one to the user; the small user table is broadcast."""
    plan = plan_of(rewards.summary(stored["rewards"], stored["spend"], stored["users"]))
    keys = sorted(re.sub(r"#\d+L?", "", k) for k in exchanges(plan))
    assert keys == ["user_id, 4", "user_id, date, 4", "user_id, date, _alone, 4"]
    with settings(plan and stored["users"].sparkSession, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(rewards.summary(stored["rewards"], stored["spend"], stored["users"]))
        # Without it only the users move: the rows are where the join needs them.
        assert len(exchanges(plan)) == 4


def test_dense_snapshot_stretches_last(stored):
    totals = positions.positions(stored["transactions"])
    tree = plan_of(positions.dense_snapshot(totals, stored["prices"], "2001-08-01")).split("\n\n")[0]
    assert tree.index("Generate (") < tree.index("BroadcastHashJoin")


def test_many_sparse_quotes_are_not_broadcast(spark, stored):
    """1,000 symbols with two quotes years apart: few stored rows, a million days."""
    quotes = written(spark.range(2000).select(
        F.concat(F.lit("S"), F.floor(F.col("id") / 2)).alias("symbol"),
        F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") % 2 * 3000).cast("int")).alias("date"), F.lit(1.0).alias("close")), "sparse")
    totals = positions.positions(stored["transactions"])
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "2k"}):
        plan = plan_of(positions.dense_snapshot(totals, quotes, "2001-08-01"))
    tree = plan.split("\n\n")[0]
    assert "SortMergeJoin" in tree and "Broadcast" not in tree and tree.index("Generate (") < tree.index("SortMergeJoin")


def test_last_rows_are_hashed(spark, stored):
    totals = positions.positions(stored["transactions"])
    facts = positions.snapshot(stored["transactions"], stored["prices"])
    log = spark.createDataFrame([(1, "a", 1.0, 1)], "k int, text string, v double, version long")
    for df in (positions.latest(totals), positions.latest(facts), positions._opening_rows(totals, totals.columns),
               serving.latest_view(log, ["k"], ["version"]), serving.latest_view(log.drop("text"), ["k"], ["version"])):
        assert "SortAggregate" not in plan_of(df)


def test_top_portfolios_read_one_day(spark, stored):
    path = new_path(spark, "facts")
    layout.write_by_date(positions.snapshot(stored["transactions"], stored["prices"]).filter("year(date) = 1995"), path)
    plan = plan_of(positions.top_portfolios(spark.read.parquet(path)))
    assert re.search(r"PartitionFilters: \[[^\]]*Subquery", plan)


def test_candles_hash_and_combine(tables):
    plan = plan_of(market.candles(tables.ticks(), "1 minute"))
    assert "SortAggregate" not in plan and "partial_min_by" in plan and len(exchanges(plan)) == 1


def test_checks_of_a_table_are_one_scan(stored, spark):
    checks = quality.required_columns({"raw_transactions": quality.REQUIRED["raw_transactions"]})
    plan = plan_of(quality.run_checks(spark, {"raw_transactions": stored["transactions"]}, checks))
    assert plan.count("Scan parquet  (") == 1
    assert "total_value" not in plan


def test_orphans_are_distinct_before_the_join(stored):
    plan = plan_of(quality.orphans(stored["transactions"], stored["users"], "user_id"))
    assert "Join" not in plan and len(exchanges(plan)) == 1
    assert plan.index("HashAggregate (") < plan.index("Exchange (") < plan.rindex("HashAggregate (")


def test_latest_date_prunes_partitions(spark, stored):
    path = new_path(spark, "facts")
    layout.write_by_date(stored["rewards"], path)
    plan = plan_of(positions.on_latest_date(spark.read.parquet(path)))
    assert re.search(r"PartitionFilters: \[[^\]]*Subquery", plan)


def test_new_rows_prune_partitions(spark, stored):
    path = new_path(spark, "raw")
    layout.write_by_date(stored["rewards"], path)
    raw = spark.read.parquet(path)
    plan = plan_of(layout.new_rows(raw, raw.filter("date < '2024-01-20'")))
    assert "LeftSemi BuildRight" in plan and "dynamicpruning" in plan


SMALL_PARTS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def hot_trades(spark, n=60_000):
    """A third of all trades are of one symbol on one day, each by another user."""
    hot = F.col("id") % 3 == 0
    return spark.range(n, numPartitions=8).select(
        F.col("id").cast("string").alias("tx_id"), (F.col("id") % 50_000).alias("user_id"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 97)).alias("symbol"),
        F.lit("buy").alias("tx_type"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("total_value"),
        F.lit(0.0).alias("fee"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.when(hot, 0).otherwise((F.col("id") % 31).cast("int"))).alias("date"))


def test_hot_symbol_day_is_split_when_prices_are_too_large(spark):
    with settings(spark, **SMALL_PARTS):
        trades = hot_trades(spark)
        prices = written(trades.groupBy("symbol", "date").agg(F.lit(3.0).alias("close")), "prices")
        facts = positions.snapshot(trades, prices)
        got = facts.toPandas()
        assert "SortMergeJoin(skew=true)" in facts._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 60_000 and (got.market_value == 3.0).all()


def test_hot_user_is_combined_before_its_window(spark):
    """Fifty thousand purchases of one user on one day are one row at the window."""
    buys = spark.range(90_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.lit("buy").alias("tx_type"),
        F.lit(1.0).alias("total_value"), F.lit("2024-01-01").cast("date").alias("date"))
    daily = rewards.daily_buy_spend(buys)
    got = rewards.rolling(daily, "daily_buy_spend", "s").filter("user_id = 0").collect()
    assert [(r["daily_buy_spend"], r["s"]) for r in got] == [(30_000.0, 30_000.0)]
    assert "partial_try_sum" in plan_of(daily)


def test_one_user_is_read_from_one_bucket(spark, stored):
    """Also where the table is found by its path. Without the setting the plan does not say so, but prunes all the same."""
    rows = stored["transactions"].groupBy("user_id", "symbol").agg(F.sum("quantity").alias("held"))
    path, user = new_path(spark, "by-user"), rows.agg(F.min("user_id")).first()[0]
    stored_rows = serving.store_by_key(rows, "held_by_user", path, buckets=8)
    known = serving.open_by_key(spark, "held_again", path, rows.schema, buckets=8)
    for table in (stored_rows, known):
        one = serving.merge_of_one(table, table, "user_id", user, ("user_id", "symbol"), add=["held"])
        with settings(spark, **{"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            plan = plan_of(serving.merge_of_one(table, table, "user_id", user, ("user_id", "symbol"), add=["held"]))
        assert plan.count("SelectedBucketsCount: 1 out of 8") == 2 and "PushedFilters: [IsNotNull(user_id), EqualTo(user_id" in plan
        assert sorted(r.held for r in one.collect()) == sorted(2 * r.held for r in rows.filter(F.col("user_id") == user).collect())
    for name in ("held_by_user", "held_again"):
        spark.sql(f"DROP TABLE {name}")


def test_figures_of_headline_plans_stay_small(stored):
    """Expressions in the analysed plan; the exact sums alone made several thousand once."""
    frames = {"snapshot": positions.snapshot(stored["transactions"], stored["prices"]),
              "summary": rewards.summary(stored["rewards"], stored["spend"], stored["users"])}
    for name, df in frames.items():
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(text) < 60_000, (name, len(text))
