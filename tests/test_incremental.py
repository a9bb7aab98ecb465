"""Staging by changed days, positions continued one by one."""

import datetime as dt
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from tests.conftest import day, plan_of, rows, settings

from tidefolio.operators import layout, repeats
from tidefolio.plans import portfolio, rewards, staging
from tidefolio.plans.lake import Lake
from tidefolio.storage import new_path, scratch, written

TRADE = ("tx_id string, user_id string, symbol string, tx_type string, quantity double, price double, total_value double, "
         "fee double, date date")


def trade(i, user, symbol, quantity, date, kind="buy"):
    return (i, user, symbol, kind, float(quantity), 2.0, 2.0 * quantity, 0.5, day(date))


def land(spark, lake, *trades):
    spark.createDataFrame(trades, TRADE).write.mode("append").partitionBy("date").parquet(lake.raw("transactions"))


def quote(spark, lake, *prices):
    layout.write_by_date(spark.createDataFrame([(s, float(c), day(d)) for s, c, d in prices], "symbol string, close double, date date"),
                         lake.raw("prices"), only_given_dates=True)


def facts(spark, lake):
    return rows(spark.read.parquet(lake.warehouse("fact_portfolio_daily")), "user_id", "symbol", "date")


def in_full(spark, lake):
    """The facts of a full run over the same raw tables."""
    whole = Lake(new_path(spark, "whole"))
    for table in ("transactions", "prices"):
        layout.write_by_date(spark.read.parquet(lake.raw(table)), whole.raw(table))
    portfolio.run(spark, whole.base)
    return facts(spark, whole)


def staged(spark, lake):
    return sorted((r["tx_id"], str(r["date"])) for r in rows(staging.rows(spark, lake, "transactions")))


def test_repeats_count_once_on_their_first_day(spark):
    """A copy 200 days later, one that arrives 100 days earlier, and one that goes away again."""
    lake = Lake(new_path(spark, "repeats"))
    land(spark, lake, trade("a", "u", "A", 1, "2024-03-01"), trade("b", "u", "A", 2, "2024-03-02"), trade("b", "u", "A", 2, "2024-03-02"))
    assert staging.refresh(spark, lake, "transactions") is None
    assert staged(spark, lake) == [("a", "2024-03-01"), ("b", "2024-03-02")]
    land(spark, lake, trade("a", "u", "A", 1, "2024-09-17"), trade("c", "u", "A", 3, "2024-09-17"))
    assert staging.refresh(spark, lake, "transactions") == ["2024-09-17"]
    assert staged(spark, lake) == [("a", "2024-03-01"), ("b", "2024-03-02"), ("c", "2024-09-17")]
    land(spark, lake, trade("c", "u", "A", 3, "2024-06-09"))
    assert staging.refresh(spark, lake, "transactions") == ["2024-06-09", "2024-09-17"]
    assert staged(spark, lake) == [("a", "2024-03-01"), ("b", "2024-03-02"), ("c", "2024-06-09")]
    layout.remove_days(spark, lake.raw("transactions"), ["2024-03-01"])
    assert staging.refresh(spark, lake, "transactions") == ["2024-03-01", "2024-09-17"]
    assert staged(spark, lake) == [("a", "2024-09-17"), ("b", "2024-03-02"), ("c", "2024-06-09")]
    assert staging.refresh(spark, lake, "transactions") == []


def test_only_changed_days_are_read(spark):
    lake = Lake(new_path(spark, "pruned"))
    land(spark, lake, *[trade(f"t{i}", "u", "A", 1, str(dt.date(2024, 1, 1) + dt.timedelta(i % 40))) for i in range(80)])
    staging.refresh(spark, lake, "transactions")
    raw = spark.read.parquet(lake.raw("transactions"))
    _, ids, once = staging._changed(raw, spark.read.parquet(lake.staging("transactions_ids")), "tx_id", ["2024-01-05", "2024-02-01"])
    plan = plan_of(once)
    scans = [part for part in plan.split("Scan parquet")[1:] if "PartitionFilters" in part and "tx_id" in part.split("\n\n")[0]]
    assert scans and all("date#" in re.search(r"PartitionFilters: \[(.*)\]", part).group(1) for part in scans)
    assert "SortAggregate" not in plan
    assert ids.count() == 4 and once.count() == 4


def test_once_keeps_one_of_a_much_repeated_event(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("x"), F.col("id") % 500)).alias("k"),
                                    F.lit(day("2024-01-01")).alias("date"), F.lit("text").alias("t")).repartition(6)
    lone = spark.createDataFrame([(None, day("2024-01-01"), "n"), (None, day("2024-01-01"), "n"), (None, day("2024-01-02"), "n")], df.schema)
    got = repeats.once(df.unionByName(lone), "k")
    assert got.groupBy("k").count().filter("k IS NOT NULL AND count > 1").count() == 0
    assert got.filter("k IS NOT NULL").count() == df.select("k").distinct().count() and got.filter("k IS NULL").count() == 2


def test_many_repeated_ids_are_one_shuffle(spark, monkeypatch):
    """Too many for a broadcast: one window over all rows, not two joins that shuffle them; each task sends one row an id."""
    df = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("k"),
                                  F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 7).cast("int")).alias("date"), F.lit("text").alias("t"))
    own, others = (written(df.filter(f"date {sign} '2024-01-04'"), "part") for sign in (">=", "<"))

    def plain(rows):
        return sorted(rows.groupBy("k").agg(F.min("date").alias("date")).collect())

    few = sorted(repeats.once(own, "k", others).select("k", "date").collect())
    monkeypatch.setattr(repeats, "FEW_IDS", 10)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(repeats.once(written(df, "all"), "k"))
        tree = plan.split("\n\n")[0]
        assert "Join" not in tree and tree.count("WindowGroupLimit") == 2
        assert sorted(repeats.once(df, "k").select("k", "date").collect()) == plain(df)
        assert sorted(repeats.once(own, "k", others).select("k", "date").collect()) == few == [
            r for r in plain(df) if r.date >= day("2024-01-04")]


def test_equal_rows_are_found_by_their_hashes(spark):
    """Whole rows are shuffled only where a hash occurs twice; nulls and both zeros as in ``distinct``."""
    df = written(spark.createDataFrame([("a", None, 0.0), ("a", None, -0.0), (None, "a", 1.0), ("b", "c", float("nan")),
                                        ("b", "c", float("nan")), (None, None, None), (None, None, None), ("d", "e", 2.0)],
                                       "x string, y string, v double"), "rows")
    got = repeats.equal_once(df)
    assert got.count() == df.distinct().count() == 5
    assert sorted(map(str, got.select("x", "y").collect())) == sorted(map(str, df.distinct().select("x", "y").collect()))
    assert "LeftAnti" in plan_of(got)


def test_a_late_trade_rewrites_its_position_only(spark):
    """The days on which the position trades are written again; the others keep their files."""
    lake = Lake(new_path(spark, "late"))
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(30)]
    land(spark, lake, *[trade(f"{u}{s}{i}", u, s, 1 + i % 3, d, "sell" if i % 7 == 6 else "buy") for i, d in enumerate(days)
                        for u, s in (("u", "A"), ("v", "A"), ("w", "B")) if u != "w" or i % 10 == 4])
    quote(spark, lake, *[(s, 5 + i, d) for i, d in enumerate(days) for s in "AB"])
    portfolio.run(spark, lake.base, incremental=True)
    before = layout._days(spark, lake.warehouse("fact_portfolio_daily"), None, "date")
    land(spark, lake, trade("late", "w", "B", 7, days[2]))
    done = portfolio.run(spark, lake.base, incremental=True)
    after = layout._days(spark, lake.warehouse("fact_portfolio_daily"), None, "date")
    assert done["positions"] == 1
    assert {d for d in days if before.get(d) != after[d]} == {days[2], days[4], days[14], days[24]}
    assert facts(spark, lake) == in_full(spark, lake)
    # nothing changed since, then a price: all positions of that day, no other day
    assert portfolio.run(spark, lake.base, incremental=True)["rows"] == 0
    quote(spark, lake, ("A", 99, days[10]))
    assert (portfolio.run(spark, lake.base, incremental=True)["first_date"], facts(spark, lake)) == (day(days[10]), in_full(spark, lake))


def test_random_late_trades_equal_a_full_run(spark):
    rng, lake, n = random.Random(11), Lake(new_path(spark, "random")), 0
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(12)]
    quote(spark, lake, *[(s, 3 + i % 4, d) for i, d in enumerate(days) for s in "ABC" if rng.random() < 0.8])
    for step in range(4):
        given = []
        for _ in range(10):
            n += 1
            given.append(trade(f"t{n}", rng.choice("uvwx"), rng.choice("ABC"), rng.randint(1, 9), rng.choice(days[:6 + 2 * step]),
                               rng.choice(["buy", "buy", "sell"])))
        land(spark, lake, *given, *rng.sample(given, 2))  # some arrive twice
        portfolio.run(spark, lake.base, incremental=True)
    assert facts(spark, lake) == in_full(spark, lake)


def test_a_run_that_died_is_made_up_for(spark, monkeypatch):
    lake = Lake(new_path(spark, "died"))
    land(spark, lake, *[trade(f"t{i}", "uv"[i % 2], "A", 1, f"2024-01-{1 + i:02d}") for i in range(8)])
    quote(spark, lake, *[("A", 5 + i, f"2024-01-{i:02d}") for i in range(1, 12)])
    portfolio.run(spark, lake.base)
    land(spark, lake, trade("late", "u", "A", 9, "2024-01-03"))

    def broken(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(portfolio, "_close", broken)
        with pytest.raises(RuntimeError):
            portfolio.run(spark, lake.base, incremental=True)
    portfolio.run(spark, lake.base, incremental=True)
    assert facts(spark, lake) == in_full(spark, lake)
    land(spark, lake, trade("new", "u", "A", 1, "2024-01-11"))
    portfolio.run(spark, lake.base, incremental=True)
    assert facts(spark, lake) == in_full(spark, lake)


def test_rewards_read_staged_trades(spark):
    """What the portfolio quarantines counts for no tier either."""
    lake = Lake(new_path(spark, "agree"))
    land(spark, lake, trade("a", "u", "A", 100, "2024-01-02"), trade("bad", "u", "A", 10 ** 6, "2024-01-02", "gift"),
         trade(None, "u", "A", 10 ** 6, "2024-01-02"))
    reward = "reward_id string, user_id string, reward_type string, reward_amount double, spend_amount double, date date"
    layout.write_by_date(spark.createDataFrame([("r", "u", "cashback", 1.0, 2.0, day("2024-01-02"))] * 2, reward), lake.raw("rewards"))
    layout.write_table(spark.createDataFrame([("u", "gold", "DE")], "user_id string, tier string, country string"), lake.warehouse("dim_user"))
    rewards.run(spark, lake.base)
    fact = rows(spark.read.parquet(lake.warehouse("fact_reward_daily")))
    assert [(r["cashback_count"], r["daily_buy_spend"]) for r in fact] == [(1, 200.0)]


def some_days(spark, lake, prices=True):
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(6)]
    land(spark, lake, *[trade(f"{u}{s}{i}", u, s, 1 + i, d) for i, d in enumerate(days) for u, s in (("u", "A"), ("v", "A"), ("w", "B"))])
    if prices:
        quote(spark, lake, *[(s, 5 + i, d) for i, d in enumerate(days) for s in "AB"])
    return days


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_jobs_leave_no_tables_between_and_no_shuffle_files(spark):
    lake = Lake(new_path(spark, "lean"))
    days = some_days(spark, lake)
    shared, shuffled = set(os.listdir(os.path.dirname(lake.base))), shuffle_files(spark)
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    for late in (None, ("late", "w", "B", 7, days[2]), ("later", "u", "A", 7, days[1])):
        if late is not None:
            land(spark, lake, trade(*late))
        portfolio.run(spark, lake.base, incremental=True)
        assert set(os.listdir(os.path.dirname(lake.base))) == shared
        for _ in range(50):  # blocks are removed in the background
            if shuffle_files(spark) <= shuffled:
                break
            time.sleep(0.1)
        assert shuffle_files(spark) <= shuffled
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec
    assert facts(spark, lake) == in_full(spark, lake)


def test_scratch_removes_its_tables_after_an_error(spark):
    outer = written(spark.range(3), "outer")
    with pytest.raises(RuntimeError), scratch(spark):
        inner = written(spark.range(4), "inner")
        with scratch(spark):
            innermost = written(spark.range(5), "innermost")
        assert inner.count() == 4 and not os.path.exists(innermost.inputFiles()[0].removeprefix("file://"))
        raise RuntimeError
    assert outer.count() == 3 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))


def test_ids_and_rows_that_repeat_alone_are_moved(spark):
    """With what repeats known, the index and the rows are the same as from all rows; those that are alone take no shuffle."""
    df = written(spark.createDataFrame([("a", 1, day("2024-01-03")), ("a", 1, day("2024-01-03")), ("a", 2, day("2024-01-01")), ("b", 3, day("2024-01-02")),
                                        (None, 4, day("2024-01-02")), (None, 4, day("2024-01-02")), (None, 5, day("2024-01-02"))], "k string, n int, date date"), "ids")
    shared = repeats.shared_ids(df, "k")
    ids = repeats.day_ids(df, "k", shared=shared)
    assert sorted(ids.collect()) == sorted(repeats.day_ids(df, "k").collect()) and ids.count() == 3
    order = lambda rows: sorted(rows.collect(), key=str)
    assert order(repeats.once(df, "k", shared=shared, gather=True)) == order(repeats.once(df, "k"))
    assert len(order(repeats.once(df, "k"))) == 4
    alone = written(df.filter("k = 'b'"), "alone")
    shared = repeats.shared_ids(alone, "k")
    lines = plan_of(repeats.day_ids(alone, "k", shared=shared)).split("\n\n")[0]
    assert lines.count("BroadcastExchange") == 2 and lines.count("HashAggregate") == 2  # one branch has no aggregate


def test_raw_days_of_few_files_are_staged_as_they_lie_others_gathered(spark):
    few, many = Lake(new_path(spark, "few")), Lake(new_path(spark, "many"))
    rows_ = [trade(f"t{i}", "u", "A", 1, f"2024-01-0{1 + i % 2}") for i in range(60)]
    land(spark, few, *rows_, rows_[0])
    spark.createDataFrame(rows_, TRADE).repartition(20).write.partitionBy("date").parquet(many.raw("transactions"))
    for lake, gathered in ((few, True), (many, False)):
        assert layout.lies_gathered(spark, lake.raw("transactions")) == gathered
        staging.refresh(spark, lake, "transactions")
        assert staged(spark, lake) == sorted((r[0], str(r[-1])) for r in rows_)
    assert [len(names) for names in layout._days(spark, many.staging("transactions"), None, "date").values()] == [1, 1]


def test_facts_are_the_same_with_more_prices_than_a_broadcast_holds(spark, monkeypatch):
    lake = Lake(new_path(spark, "prices"))
    days = some_days(spark, lake)
    monkeypatch.setattr(portfolio, "FEW_PRICES", 1)
    for late in (None, ("late", "w", "B", 7, days[2])):
        if late is not None:
            land(spark, lake, trade(*late))
        portfolio.run(spark, lake.base, incremental=True)
    monkeypatch.undo()
    assert facts(spark, lake) == in_full(spark, lake) != []


def test_facts_are_written_where_totals_lie(spark):
    """One file a day, and no shuffle but those of the totals: positions without prices leave no facts."""
    lake = Lake(new_path(spark, "lie"))
    days = some_days(spark, lake)
    portfolio.run(spark, lake.base)
    assert {d: len(names) for d, names in layout._days(spark, lake.warehouse("fact_portfolio_daily"), None, "date").items()} == dict.fromkeys(days, 1)
    bare = Lake(new_path(spark, "bare"))
    some_days(spark, bare, prices=False)
    quote(spark, bare, ("Z", 1, days[0]))
    assert portfolio.run(spark, bare.base)["rows"] == 0
    land(spark, bare, trade("late", "w", "B", 7, days[2]))
    assert portfolio.run(spark, bare.base, incremental=True)["rows"] == 0
