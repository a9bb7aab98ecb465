import json
import os
import time

import pytest
from pyspark.sql import functions as F
from tests.conftest import at, day, rows, settings

from tidefolio.operators import layout, positions, quality, serving
from tidefolio.plans import __main__ as command
from tidefolio.plans import portfolio, quality as quality_job, realtime, reconciliation, rewards
from tidefolio.plans.lake import Lake
from tidefolio.sources.dimensions import calendar, listed_assets
from tidefolio.sources.testtables import TestTables
from tidefolio.storage import new_path


@pytest.fixture
def lake(spark):
    """A small lake with two months of trades and rewards."""
    base = new_path(spark, "lake")
    at = Lake(base)
    t = TestTables(spark, "/root/testdata/sf0.001")
    shift = lambda df: df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.dayofyear("date") % 60).cast("int")))
    layout.write_by_date(shift(t.transactions()), at.raw("transactions"))
    layout.write_by_date(shift(t.prices()).groupBy("symbol", "date").agg(F.max("close").alias("close")), at.raw("prices"))
    layout.write_by_date(t.rewards(), at.raw("rewards"))
    layout.write_table(t.users(), at.warehouse("dim_user"))
    layout.write_table(t.assets(), at.warehouse("dim_asset"))
    bounds = spark.createDataFrame([(day("2024-01-01"), day("2024-12-31"))], "first_date date, last_date date")
    layout.write_table(calendar(bounds), at.warehouse("dim_date"))
    return at


def facts(spark, lake, table="fact_portfolio_daily"):
    return spark.read.parquet(lake.warehouse(table))


def test_incremental_run_equals_a_full_one(spark, lake):
    whole = portfolio.run(spark, lake.base)
    expected = rows(facts(spark, lake), "user_id", "symbol", "date")
    assert whole["rows"] == len(expected) > 0

    part = Lake(new_path(spark, "part"))
    for table in ("transactions", "prices"):
        known = spark.read.parquet(lake.raw(table)).filter("date < '2024-02-01'")
        layout.write_by_date(known, part.raw(table))
    portfolio.run(spark, part.base)
    for table in ("transactions", "prices"):
        layout.write_by_date(spark.read.parquet(lake.raw(table)).filter("date >= '2024-02-01'"),
                             part.raw(table), only_given_dates=True)
    added = portfolio.run(spark, part.base, incremental=True)
    assert added["first_date"] == day("2024-02-01")
    assert rows(facts(spark, part), "user_id", "symbol", "date") == expected

    # Nothing new: nothing changes. Redone days: the same again.
    portfolio.run(spark, part.base, incremental=True)
    assert rows(facts(spark, part), "user_id", "symbol", "date") == expected
    portfolio.run(spark, part.base, incremental=True, since="2024-02-15")
    assert rows(facts(spark, part), "user_id", "symbol", "date") == expected


def test_rewards_from_a_day_on_equal_a_full_run(spark, lake):
    rewards.run(spark, lake.base)
    expected = rows(facts(spark, lake, "fact_reward_daily"), "user_id", "date")
    assert len(expected) == 261
    redone = rewards.run(spark, lake.base, since="2024-01-20")
    assert redone["first_date"] == day("2024-01-20")
    assert rows(facts(spark, lake, "fact_reward_daily"), "user_id", "date") == expected


def test_quality_job_reports_and_fails(spark, lake):
    portfolio.run(spark, lake.base)
    rewards.run(spark, lake.base)
    floors = dict.fromkeys(quality.ROW_FLOORS, 1)
    summary = quality_job.run(spark, lake.base, "good", floors=floors)
    assert (summary["total_checks"], summary["failed"], summary["pass_rate"]) == (36, 0, 100.0)
    written = [f for f in os.listdir(f"{lake.report('good')}/checks") if f.endswith(".json")]
    with open(f"{lake.report('good')}/checks/{written[0]}") as lines:
        assert {json.loads(line)["status"] for line in lines} == {"PASS"}
    with pytest.raises(quality_job.QualityError, match="of 36 checks failed"):
        quality_job.run(spark, lake.base, "strict")
    with pytest.raises(quality_job.QualityError, match="of 41 checks failed"):
        quality_job.run(spark, lake.base, "stale", as_of="2030-01-01", floors=floors)
    with open(f"{lake.raw('prices')}/broken.parquet", "w") as file:
        file.write("no parquet at all")
    for old in os.listdir(lake.raw("prices")):
        if old.startswith("date="):
            layout.remove_dates(spark, lake.raw("prices"), None)
    with pytest.raises(quality_job.QualityError):
        quality_job.run(spark, lake.base, "broken", floors=floors)
    assert [r["table"] for r in rows(spark.read.json(f"{lake.report('broken')}/not_loaded"))] == ["raw_prices"]


def test_command_line(spark, lake, monkeypatch, capsys):
    monkeypatch.setattr(command, "session", lambda app: spark)
    assert command.main(["portfolio", "--base", lake.base]) == 0
    assert command.main(["rewards", "--base", lake.base]) == 0
    assert command.main(["quality", "--base", lake.base]) == 1
    assert "checks failed" in capsys.readouterr().err


def test_reconciliation_job(spark):
    """Sold-out and unpriced positions match; a planted fault, a missing and a later trade are seen as what they are."""
    lake = Lake(new_path(spark, "reconcile"))

    def arrive(*given):
        spark.createDataFrame([(i, u, s, k, float(q), 1.0, float(q), 0.0, at(t)) for i, u, s, k, q, t in given], realtime.TRADE) \
            .write.mode("append").parquet(lake.incoming("transactions"))

    spark.createDataFrame([(1, "A", at("2024-01-01 10:00:00"), 1.0, 1.0)], realtime.TICK).write.parquet(lake.incoming("ticks"))
    arrive(("1", "u", "A", "buy", 1, "2024-01-01 01:00:00"), ("2", "u", "A", "sell", 1, "2024-01-02 01:00:00"),
           ("3", "u", "B", "buy", 2, "2024-01-02 01:00:00"), ("4", "v", "A", "buy", 3, "2024-01-02 02:00:00"))
    realtime.run(spark, lake.base)
    portfolio.run(spark, lake.base)
    arrive(("5", "v", "A", "buy", 9, "2024-01-03 02:00:00"), ("6", "w", "A", "buy", 1, "2024-01-02 03:00:00"))
    realtime.run(spark, lake.base)
    reconciliation.run(spark, lake.base)
    got = {(r["user_id"], r["symbol"]): (r["batch_value"], r["rt_value"], r["status"]) for r in rows(facts(spark, lake, "fact_reconciliation"))}
    assert got == {("u", "A"): (0.0, 0.0, "match"), ("u", "B"): (2.0, 2.0, "match"), ("v", "A"): (3.0, 3.0, "match"),
                   ("w", "A"): (None, 1.0, "rt_only")}
    portfolio.run(spark, lake.base, incremental=True)
    reconciliation.run(spark, lake.base)
    assert {r["status"] for r in rows(facts(spark, lake, "fact_reconciliation"))} == {"match"}


def test_listed_assets(spark):
    assert listed_assets(spark).count() == 10


def test_realtime_job_lands_and_follows(spark):
    lake = Lake(new_path(spark, "stream"))

    def arrive(ticks, trades):
        spark.createDataFrame([(i, s, at(t), p, 1.0) for i, s, t, p in ticks], realtime.TICK) \
            .write.mode("append").parquet(lake.incoming("ticks"))
        spark.createDataFrame([(i, u, "A", k, q, v / q, v, 0.0, at(t)) for i, u, k, q, v, t in trades], realtime.TRADE) \
            .write.mode("append").parquet(lake.incoming("transactions"))
        spark.createDataFrame([("r1", "u", "cashback", 1.0, 2.0, "gold", at("2024-01-01 00:00:00"))], realtime.REWARD) \
            .write.mode("append").parquet(lake.incoming("rewards"))
        realtime.run(spark, lake.base)

    arrive([(1, "A", "2024-01-01 00:00:05", 10.0), (1, "A", "2024-01-01 00:00:05", 10.0)],
           [("t1", "u", "buy", 3.0, 3000.0, "2024-01-01 00:00:00")])
    arrive([(2, "A", "2024-01-01 00:00:20", 12.0), (3, "A", "2024-01-03 00:00:00", 11.0)],
           [("t2", "u", "sell", 1.0, 12.0, "2024-01-01 00:00:10"), ("t3", "v", "buy", 1.0, 1.0, "2024-01-05 00:00:00"),
            ("t1", "u", "buy", 3.0, 3000.0, "2024-01-01 00:00:00")])
    # far too late for the views, but not for the raw zone
    arrive([(4, "A", "2023-12-01 00:00:00", 5.0)], [("t0", "v", "buy", 7.0, 7.0, "2023-12-01 00:00:00")])

    read = spark.read.parquet
    assert read(lake.raw("ticks")).count() == 5 and read(lake.raw("transactions")).count() == 5 and read(lake.raw("rewards")).count() == 3
    bar = rows(read(lake.realtime("ohlcv_1m")))
    assert [(r["open"], r["close"], r["num_ticks"]) for r in bar] == [(10.0, 12.0, 2)]
    assert rows(read(lake.realtime("reward_tier")).filter("date = '2024-01-02'"))[0]["tier"] == "silver"
    live = {r["user_id"]: (r["quantity_held"], r["price"]) for r in rows(realtime.portfolio_pnl(spark, lake.base))}
    assert live == {"u": (2.0, 11.0), "v": (1.0, 11.0)}
    portfolio.run(spark, lake.base)
    assert {r["user_id"]: r["quantity_held"] for r in rows(read(lake.staging("positions_daily")).filter("date = '2023-12-01'")
                                                          .selectExpr("user_id", "quantity_held.whole AS quantity_held"))} == {"v": 7}

    # The same streams can be kept running, and pick up what comes in.
    running = realtime.run(spark, lake.base, every="1 second")
    spark.createDataFrame([("t4", "v", "A", "buy", 2.0, 1.0, 2.0, 0.0, at("2024-01-05 00:00:01"))], realtime.TRADE) \
        .write.mode("append").parquet(lake.incoming("transactions"))
    deadline, seen = time.time() + 90, False
    while time.time() < deadline and not seen:
        time.sleep(1)
        seen = {r["user_id"]: r["quantity_held"] for r in rows(realtime.portfolio_pnl(spark, lake.base))}["v"] == 3.0
    for query in running:
        query.stop()
    assert seen


def test_any_order_of_runs_equals_a_full_run(spark):
    """Random daily runs, late and corrected trades, emptied days, changed prices and redone days."""
    import random
    rng = random.Random(7)
    lake, fresh = Lake(new_path(spark, "random")), 0
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    trades = {d: [] for d in days}
    quotes = {d: [("A", 10.0 + i), ("B", 5.0)] for i, d in enumerate(days)}

    def put(table, d, given, schema):
        path = f"{lake.raw(table)}/date={d}"
        if given:
            spark.createDataFrame(given, schema).write.mode("overwrite").parquet(path)
        else:
            layout.remove_dates(spark, lake.raw(table), d, {x for x in days if x != d})

    def trade(d):
        nonlocal fresh
        fresh += 1
        kind = rng.choice(["buy", "buy", "sell"])
        trades[d].append((f"t{fresh}", rng.choice("uv"), rng.choice("AB"), kind, float(rng.randint(1, 5)), 2.0, 10.0, 0.1))

    def store(d):
        put("transactions", d, trades[d], "tx_id string, user_id string, symbol string, tx_type string, quantity double, "
                                          "price double, total_value double, fee double")

    for i, d in enumerate(days):
        for _ in range(3):
            trade(d)
        store(d)
        put("prices", d, quotes[d], "symbol string, close double")
        what = rng.choice(["late", "empty", "price", "correct", "redo", "nothing"]) if i else "nothing"
        past = rng.choice(days[:i]) if i else d
        if what == "late":
            trade(past)
        elif what == "empty":
            trades[past].clear()
        elif what == "correct" and trades[past]:
            trades[past][0] = (*trades[past][0][:4], 9.0, *trades[past][0][5:])
        elif what == "price":
            quotes[past] = [("A", 99.0)]
            put("prices", past, quotes[past], "symbol string, close double")
        if what in ("late", "empty", "correct"):
            store(past)
        portfolio.run(spark, lake.base, incremental=True, since=past if what == "redo" else None)
        got = rows(facts(spark, lake), "user_id", "symbol", "date")
        whole = Lake(new_path(spark, "whole"))
        for table in ("transactions", "prices"):
            layout.write_by_date(spark.read.parquet(lake.raw(table)), whole.raw(table))
        portfolio.run(spark, whole.base)
        assert got == rows(facts(spark, whole), "user_id", "symbol", "date"), (d, what, past)


def test_rewards_withdrawn_for_good(spark, lake):
    rewards.run(spark, lake.base)
    gone = "2024-01-25"
    layout.remove_dates(spark, lake.raw("rewards"), gone, {f"2024-01-{d:02d}" for d in range(26, 32)} | {"2024-02-01"})
    rewards.run(spark, lake.base, since="2024-01-20")
    redone = rows(facts(spark, lake, "fact_reward_daily"), "user_id", "date")
    rewards.run(spark, lake.base)
    assert redone == rows(facts(spark, lake, "fact_reward_daily"), "user_id", "date")


def test_bad_trades_are_quarantined(spark):
    lake = Lake(new_path(spark, "bad"))
    given = [("t1", "u", "A", "buy", 1.0, 1.0, 1.0, 0.0, day("2024-01-01")), ("t2", None, "A", "buy", 1.0, 1.0, 1.0, 0.0, day("2024-01-01")),
             ("t3", "u", "A", "hold", 1.0, 1.0, 1.0, 0.0, day("2024-01-02")), ("t1", "u", "A", "buy", 1.0, 1.0, 1.0, 0.0, day("2024-01-01"))]
    layout.write_by_date(spark.createDataFrame(given, "tx_id string, user_id string, symbol string, tx_type string, quantity double, "
                                                      "price double, total_value double, fee double, date date"), lake.raw("transactions"))
    ticks = spark.createDataFrame([(1, "A", at("2024-01-01 10:00:00"), 3.0, 1.0, day("2024-01-01")),
                                   (2, "A", at("2024-01-01 11:00:00"), 4.0, 1.0, day("2024-01-01"))],
                                  "event_id long, symbol string, ts timestamp, price double, volume double, date date")
    layout.write_by_date(ticks, lake.raw("ticks"))
    assert portfolio.run(spark, lake.base)["quarantined"] == 2
    assert [(r["quantity_held"], r["market_price"]) for r in rows(facts(spark, lake))] == [(1.0, 4.0)]
    assert spark.read.parquet(lake.staging("quarantine_transactions")).count() == 2


def test_facts_are_made_in_methods_the_jvm_compiles(spark):
    """The JVM interprets methods of more than 8000 bytes; ids are made after the rows of a day have met."""
    trades = spark.createDataFrame([("t", "u", "A", "buy", 2.0, 3.0, 6.0, 0.1, day("2024-01-01"))], (
        "tx_id string, user_id string, symbol string, tx_type string, quantity double, price double, total_value double, fee double, date date"))
    prices = spark.createDataFrame([("A", day("2024-01-01"), 4.0)], "symbol string, date date, close double")
    totals = positions.positions(trades).localCheckpoint()
    with settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        made = portfolio._valued(portfolio._priced(totals, prices).repartition("date"))  # the hint needs adaptive plans
        stages = made._jdf.queryExecution().debug().codegenToSeq()
        assert stages.size() > 1
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert max(sizes) < 8000
    path = new_path(spark, "facts")
    layout.write_by_date(portfolio._priced(totals, prices), path, finish=portfolio._valued)
    assert rows(spark.read.parquet(path).select(*made.columns)) == rows(positions.snapshot(trades, prices))
