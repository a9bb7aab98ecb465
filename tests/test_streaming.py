import os
import time

import pytest
from pyspark.sql import functions as F
from tests.conftest import at, day, rows

from tidefolio.operators import market, positions, serving
from tidefolio.sources.streams import decode, malformed, stream, well_formed
from tidefolio.storage import new_path, scratch
from tidefolio.streaming import live_pnl, sinks, tiers, windows

TICK = "event_id long, symbol string, ts timestamp, price double, volume double"


def ticks(spark, *given):
    return spark.createDataFrame([(i, s, at(t), float(p), 1.0) for i, s, t, p in given], TICK)


def bars(df):
    return [(r["symbol"], r["window_start"].strftime("%H:%M"), r["open"], r["high"], r["low"], r["close"], r["num_ticks"])
            for r in rows(df, "symbol", "window_start")]


def test_candles_break_ties_and_put_the_boundary_later(spark):
    got = market.candles(ticks(
        spark, (2, "A", "2024-01-01 00:00:00", 5), (1, "A", "2024-01-01 00:00:00", 4),
        (3, "A", "2024-01-01 00:00:59", 9), (4, "A", "2024-01-01 00:01:00", 1)), "1 minute")
    assert bars(got) == [("A", "00:00", 4.0, 9.0, 4.0, 9.0, 3), ("A", "00:01", 1.0, 1.0, 1.0, 1.0, 1)]


def test_candles_order_by_any_kind_of_tie(spark):
    given = ticks(spark, (10, "A", "2024-01-01 00:00:00", 5), (9, "A", "2024-01-01 00:00:00", 4))
    named = given.withColumn("event_id", F.format_string("%03d", "event_id"))
    assert bars(market.candles(named, "1 minute")) == bars(market.candles(given, "1 minute"))


def test_disorder_counts_and_late_ticks_do_not(spark):
    batches = [
        ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (2, "A", "2024-01-01 00:01:20", 2)),
        # 50 s is the watermark: the window 00:00 is still open for this one.
        ticks(spark, (3, "A", "2024-01-01 00:00:50", 3), (4, "A", "2024-01-01 00:05:00", 4)),
        # 04:30 by now: too late.
        ticks(spark, (5, "A", "2024-01-01 00:00:55", 99), (6, "A", "2024-01-01 00:06:00", 6)),
    ]
    got = sinks.replayed(batches, lambda t: windows.ohlcv(t, "1 minute"), "bars")
    assert bars(got) == [("A", "00:00", 1.0, 3.0, 1.0, 3.0, 2), ("A", "00:01", 2.0, 2.0, 2.0, 2.0, 1),
                         ]


def test_repeated_events_count_once(spark):
    first = ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (1, "A", "2024-01-01 00:00:10", 1), (2, "A", "2024-01-01 00:00:20", 1))
    hot = spark.range(5000).select(F.lit(3).cast("long").alias("event_id"), F.lit("B").alias("symbol"),
                                   F.lit("2024-01-01 00:00:21").cast("timestamp").alias("ts"),
                                   F.lit(1.0).alias("price"), F.lit(1.0).alias("volume"))
    again = ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (4, "A", "2024-01-01 00:00:22", 1))
    got = sinks.replayed([first, hot, again], windows.dedup, "dedup")
    assert [r["event_id"] for r in rows(got, "event_id")] == [1, 2, 3, 4]


def test_hot_copies_shrink_before_the_shuffle(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"event_id": [7] * 1000 + [8], "v": list(range(1001))})
    kept = pa.Table.from_batches(list(windows._first_of_each(["event_id"])(iter([batch]))))
    assert kept.to_pydict() == {"event_id": [7, 8], "v": [0, 1000]}


def spend(spark, *given):
    return spark.createDataFrame([(u, float(v), at(t)) for u, t, v in given], "user_id string, total_value double, ts timestamp")


def test_tier_falls_when_the_user_goes_quiet(spark):
    batches = [
        spend(spark, ("a", "2024-01-01 10:00:00", 30000), ("a", "2024-01-01 11:00:00", 30000)),
        spend(spark, ("a", "2024-01-03 10:00:00", 3000), ("b", "2024-01-03 10:00:00", 1)),
        spend(spark, ("b", "2024-02-15 10:00:00", 1)),
    ]
    got = {(r["user_id"], str(r["date"])): (r["rolling_spend"], r["tier"])
           for r in rows(sinks.replayed(batches, tiers.reward_tier, "tiers"))}
    assert got["a", "2024-01-01"] == (60000.0, "diamond")
    assert got["a", "2024-01-02"] == (60000.0, "diamond")
    assert got["a", "2024-01-03"] == (63000.0, "diamond")
    assert got["a", "2024-01-31"] == (63000.0, "diamond")
    assert got["a", "2024-02-01"] == (3000.0, "silver")
    assert got["a", "2024-02-02"] == (3000.0, "silver")
    assert got["a", "2024-02-03"] == (0.0, "bronze")
    assert ("a", "2024-02-04") not in got
    assert got["b", "2024-01-03"] == (1.0, "bronze")


def test_tier_of_today_follows_purchases_and_timers(spark):
    batches = [
        spend(spark, ("a", "2024-01-01 10:00:00", 30000), ("a", "2024-01-01 11:00:00", 30000)),
        spend(spark, ("a", "2024-01-03 10:00:00", 3000), ("b", "2024-01-03 10:00:00", 1)),
        spend(spark, ("b", "2024-02-01 10:00:00", 1)),
        spend(spark, ("b", "2024-02-15 10:00:00", 1)),
        spend(spark, ("b", "2024-02-15 11:00:00", 1)),
    ]
    log = rows(sinks.replayed(batches, tiers.reward_tier_now, "tiers"), "version")
    a = [(str(r["date"]), r["rolling_spend"], r["tier"]) for r in log if r["user_id"] == "a"]
    assert a[:2] == [("2024-01-01", 60000.0, "diamond"), ("2024-01-03", 63000.0, "diamond")]
    assert a[-1][1:] == (0.0, "bronze")  # went quiet, fell by timer
    assert any(r[1:] == (3000.0, "silver") and r[0] >= "2024-02-01" for r in a)
    b = [(str(r["date"]), r["rolling_spend"]) for r in log if r["user_id"] == "b"]
    assert ("2024-02-01", 2.0) in b and b[-1] == ("2024-02-15", 3.0)


TRADE = "symbol string, user_id string, tx_type string, quantity double, total_value double, ts timestamp"
QUOTE = "symbol string, ts timestamp, price double, tie long"


def run_live(spark, trades, quotes, delay=None):
    """Trades and quotes step by step through resumed streams."""
    given = [spark.createDataFrame([(*t[:5], at(t[5])) for t in step], TRADE) for step in trades]
    prices = [spark.createDataFrame([(s, at(t), None if p is None else float(p), n) for s, t, p, n in step], QUOTE) for step in quotes]
    changes = sinks.replayed(given, lambda r: live_pnl.daily_changes(positions.sign(r), delay), "live", updates=True)
    return changes, sinks.replayed(prices, live_pnl.quotes, "quotes", updates=True)


def test_live_positions_follow_trades_and_prices(spark):
    changes, quotes = run_live(spark, [
        [("A", "u1", "buy", 2.0, 200.0, "2024-01-01 01:00:00"), ("A", "u2", "buy", 1.0, 90.0, "2024-01-01 02:00:00"),
         ("B", "u1", "buy", 5.0, 50.0, "2024-01-01 03:00:00"), ("C", "u1", "buy", 1.0, 1.0, "2024-01-01 03:00:00")],
        [("A", "u1", "sell", 1.0, 150.0, "2024-01-02 01:00:00")],
        [("A", "u3", "buy", 0.1, 13.0, "2024-01-02 01:00:00"), ("A", "u3", "buy", 0.2, 26.0, "2024-01-02 02:00:00"),
         ("A", None, "buy", 9.0, 9.0, "2024-01-02 02:00:00")],
        [("A", "u2", "sell", 1.0, 95.0, "2024-01-03 00:00:00")],
    ], [
        [("A", "2024-01-01 00:00:00", 100, 1)],
        [("A", "2024-01-02 00:00:00", 120, None), ("A", "2024-01-02 00:00:00", 130, 2), ("A", "2024-01-03 00:00:00", None, 3)],
        [("A", "2024-01-01 12:00:00", 999, 1), ("B", "2024-01-02 00:00:00", 11, 1)],
    ])
    view = live_pnl.valued(live_pnl.positions_of(changes), quotes)
    got = {(r["user_id"], r["symbol"]): (r["quantity_held"], r["price"], r["market_value"], r["unrealized_pnl"]) for r in rows(view)}
    assert got == {("u1", "A"): (1.0, 130.0, 130.0, 80.0), ("u2", "A"): (0.0, 130.0, 0.0, 0.0), ("u1", "B"): (5.0, 11.0, 55.0, 5.0),
                   ("u3", "A"): (0.3, 130.0, 39.0, 0.0)}
    # as of an earlier day, whatever came in since
    then = {(r["user_id"], r["symbol"]): r["quantity_held"] for r in rows(live_pnl.positions_of(changes, "2024-01-01"))}
    assert then == {("u1", "A"): 2.0, ("u2", "A"): 1.0, ("u1", "B"): 5.0, ("u1", "C"): 1.0}
    # a price is one row however many hold the asset, a trade one row of one day
    assert quotes.count() == 4 and changes.filter("user_id = 'u2'").count() == 2


def test_days_leave_the_live_state_after_their_delay(spark):
    changes, _ = run_live(spark, [
        [("A", "u", "buy", 1.0, 1.0, "2024-01-01 01:00:00")], [("A", "u", "buy", 2.0, 2.0, "2024-01-20 01:00:00")],
        [("A", "u", "buy", 4.0, 4.0, "2024-01-20 02:00:00"), ("A", "u", "buy", 100.0, 1.0, "2024-01-02 01:00:00")],
    ], [[("A", "2024-01-01 00:00:00", 1, 1)]], "7 days")
    assert [r["quantity_held"] for r in rows(live_pnl.positions_of(changes))] == [7.0]


def test_events_without_id_repeat_only_if_equal(spark):
    given = ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (1, "A", "2024-01-01 00:00:10", 1), (1, "A", "2024-01-01 00:00:10", 2))
    nameless = given.withColumn("event_id", F.lit(None).cast("long"))
    assert windows.once(given.unionByName(nameless), "event_id").count() == 3
    assert sinks.replayed([given.unionByName(nameless)], windows.dedup, "dedup").count() == 3  # one, and two nameless


def test_candles_are_given_again_for_late_ticks(spark):
    batches = [ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (2, "A", "2024-01-01 00:01:20", 2)),
               ticks(spark, (3, "A", "2024-01-01 00:00:50", 3))]
    log = sinks.replayed(batches, lambda t: windows.ohlcv(t, "1 minute"), "updates", updates=True)
    first = [r for r in rows(log, "version") if r["window_start"].strftime("%H:%M") == "00:00"]
    assert [(r["close"], r["num_ticks"]) for r in first] == [(1.0, 1), (3.0, 2)]


def test_landed_stream_is_laid_out_by_date(spark):
    path = new_path(spark, "in")
    ticks(spark, (1, "A", "2024-01-01 00:00:10", 1), (2, "A", "2024-01-02 00:00:10", 1)).write.parquet(path)
    raw = stream(spark, path).withColumn("date", F.to_date("ts"))
    landed = sinks.drained(raw, "raw", partition_by="date")
    assert [(r["event_id"], r["date"]) for r in rows(landed, "event_id")] == [(1, day("2024-01-01")), (2, day("2024-01-02"))]


def test_replay_equals_batch(spark):
    given = spark.range(3000).select(
        F.col("id").alias("event_id"), F.concat(F.lit("S"), F.pmod(F.xxhash64("id"), F.lit(3))).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64(F.col("id") + 1), F.lit(7200))).alias("ts"),
        F.round(F.rand(5) * 100, 2).alias("price"), F.lit(1.0).alias("volume"))
    path = new_path(spark, "in")
    given.repartition(5).write.parquet(path)
    got = sinks.drained(windows.ohlcv(stream(spark, path), "5 minutes", delay="3 hours"), "bars")
    stored = spark.read.parquet(path)
    # Nothing is late within three hours, and nothing is final before them either.
    assert got.count() == 0
    end = ticks(spark, (-1, "S9", "2024-01-02 00:00:00", 1))
    got = sinks.replayed([stored, end], lambda t: windows.ohlcv(t, "5 minutes", delay="3 hours"), "bars")
    assert bars(got) == bars(market.candles(stored, "5 minutes"))


def test_decode_flags_bad_payloads(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "no json"), (3, '{"k": "x"}'), (4, None), (5, "{}")], "id int, p string")
    got = decode(df, "p", "k INT")
    assert [(r["id"], r["k"], r["malformed"]) for r in rows(got, "id")] == [
        (1, 5, False), (2, None, True), (3, None, True), (4, None, True), (5, None, False)]
    assert well_formed(got).count() == 2 and malformed(got, "p").count() == 3


def test_messages(spark):
    got = rows(sinks.to_messages(spark.createDataFrame([("a", 1)], "k string, n int"), "k"))
    assert got == [{"key": "a", "value": '{"k":"a","n":1}'}]


@pytest.mark.parametrize("blocks", [1, 2, 3, None])
def test_correlation_matches_numpy(spark, blocks):
    import numpy as np
    rng = np.random.default_rng(1)
    closes = {s: 100 * np.cumprod(1 + rng.normal(0, 0.02, 60)) for s in ("A", "B", "C", "D")}
    given = [(s, day("2024-01-01").toordinal() + i, float(c)) for s, cs in closes.items() for i, c in enumerate(cs)]
    import datetime as dt
    df = spark.createDataFrame([(s, dt.date.fromordinal(o), c) for s, o, c in given], "symbol string, date date, close double")
    got = {(r["symbol_a"], r["symbol_b"]): r for r in rows(market.asset_correlation(df, blocks, days_per_task=16))}
    assert len(got) == 6
    for (a, b), r in got.items():
        ra, rb = (np.diff(closes[s]) / closes[s][:-1] for s in (a, b))
        assert r["correlation"] == pytest.approx(np.corrcoef(ra, rb)[0, 1], abs=1e-9) and r["common_days"] == 59


def test_correlation_of_pegged_prices(spark):
    import numpy as np
    import datetime as dt
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1e-9, 40)
    closes = {"A": np.cumprod(1.5 + x), "B": np.cumprod(1.5 + 0.5 * x + rng.normal(0, 1e-9, 40))}
    df = spark.createDataFrame([(s, dt.date(2024, 1, 1) + dt.timedelta(i), float(c)) for s, cs in closes.items()
                                for i, c in enumerate(cs)], "symbol string, date date, close double")
    a, b = (np.diff(c) / c[:-1] for c in closes.values())
    assert market.asset_correlation(df).first()["correlation"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-3)


def test_a_user_who_returns_after_a_pause_has_the_new_tier(spark):
    batches = [spend(spark, ("a", "2024-01-01 10:00:00", 300)), spend(spark, ("b", "2024-02-20 10:00:00", 1)),
               spend(spark, ("b", "2024-02-25 10:00:00", 1)), spend(spark, ("a", "2024-03-01 10:00:00", 60000))]
    log = sinks.replayed(batches, tiers.reward_tier_now, "tiers")
    a = [(r["version"], r["rolling_spend"]) for r in rows(log.filter("user_id = 'a'"), "version")]
    assert a[0] == (1, 300.0) and a[1] == (2, 0.0) and a[-1] == (len(a), 60000.0)
    now = {r["user_id"]: (str(r["date"]), r["rolling_spend"], r["tier"]) for r in rows(tiers.current(log))}
    assert now["a"] == ("2024-03-01", 60000.0, "diamond")


def test_a_folded_log_shows_the_same_view(spark):
    """Folded between arrivals, with a version that is not finished yet; the stream goes on as if nothing had been."""
    from tidefolio.operators import layout, serving
    from tidefolio.sources.streams import stream
    path = new_path(spark, "fold")
    schema = "user_id string, kind string, n long"

    def arrive(*given):
        spark.createDataFrame(given, schema).write.mode("append").parquet(f"{path}/in")
        counted = stream(spark, f"{path}/in", spark.createDataFrame([], schema).schema).groupBy("user_id").agg(
            F.sum("n").alias("n"), F.max("kind").alias("kind"))
        sinks.land_changes(counted, f"{path}/log", f"{path}/checkpoint").awaitTermination()

    def view():
        log = spark.read.parquet(f"{path}/log")
        return sorted((r["user_id"], r["n"], r["kind"]) for r in rows(serving.latest_view(log, ["user_id"], ["version"])))
    for i in range(3):
        arrive(*[(f"u{k}", "x", 1 + i) for k in range(4 + i)])
    before = view()
    spark.createDataFrame([("u0", 999, "z")], "user_id string, n long, kind string").write.parquet(f"{path}/log/version=7")  # not committed
    assert sinks.fold(spark, f"{path}/log", f"{path}/checkpoint", ["user_id"]) == {"versions": 3, "rows": 6}
    assert layout.stored_days(spark, f"{path}/log", "version") == ["2", "7"]
    assert [r for r in view() if r[0] != "u0"] == [r for r in before if r[0] != "u0"] and ("u0", 999, "z") in view()
    layout.remove_days(spark, f"{path}/log", ["7"], "version")
    assert view() == before and spark.read.parquet(f"{path}/log").count() == 6
    arrive(("u0", "y", 10), ("new", "x", 1))
    assert view() == sorted([("u0", 16, "y"), ("new", 1, "x"), *before[1:]])
    assert sinks.fold(spark, f"{path}/log", f"{path}/checkpoint", ["user_id"])["rows"] == 7
    assert sinks.fold(spark, f"{path}/log", f"{path}/checkpoint", ["user_id"]) == {"versions": 0, "rows": 0}


def test_views_are_published_on_demand(spark, monkeypatch):
    from tidefolio.plans import realtime
    from tidefolio.plans.lake import Lake

    class Done:
        def awaitTermination(self):
            pass
    sent, lake = [], Lake(new_path(spark, "publish"))
    for table in ("ticks", "transactions"):
        spark.createDataFrame([], f"{realtime.INCOMING[table][0]}, date date").write.parquet(lake.raw(table))
    monkeypatch.setattr(realtime, "_landing", lambda *given: [])
    for name in ("land", "land_changes"):
        monkeypatch.setattr(sinks, name, lambda *given, **named: Done())
    monkeypatch.setattr(sinks, "publish", lambda rows, *given: sent.append((rows.isStreaming, *given)) or Done())
    realtime.run(spark, lake.base)
    assert sent == []
    realtime.run(spark, lake.base, servers="broker:9092")
    assert [(s[0], s[1], s[2], s[3]) for s in sent] == [(True, key, "broker:9092", name) for name, key in realtime.PUBLISHED.items()]
    assert len({s[4] for s in sent}) == 3


def test_replayed_streams_leave_their_table_only(spark):
    """Nor do they leave shuffle files inside of scratch."""
    from tests.test_incremental import shuffle_files
    before = shuffle_files(spark)
    batches = [spark.createDataFrame([("a", n), ("b", n)], "k string, n int") for n in range(3)]
    for updates, build in ((True, lambda r: r.groupBy("k").agg(F.sum("n").alias("n"))), (False, lambda r: r.filter("n > 0"))):
        with scratch(spark):
            left = sinks.replayed(batches, build, "kept", updates=updates)
            assert left.count() == (6 if updates else 4)
        folder = left.inputFiles()[0].removeprefix("file://").split("/table/")[0]
        assert os.listdir(folder) == ["table"]
    for _ in range(50):  # blocks are removed in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
