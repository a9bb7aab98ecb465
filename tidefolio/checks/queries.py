"""One query per operator, over the whole test tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.functions.amounts import as_decimals, as_doubles, exact_sum, split_sum, to_decimal, to_double
from tidefolio.functions.keys import surrogate_key
from tidefolio.operators import accruals, layout, market, positions, quality, repeats, rewards, serving
from tidefolio.plans import portfolio, realtime
from tidefolio.plans import reconciliation as reconciliation_job
from tidefolio.plans.lake import Lake
from tidefolio.sources import dimensions, streams, tables
from tidefolio.sources.testtables import TestTables
from tidefolio.storage import new_path, scratch, written
from tidefolio.streaming import live_pnl, sinks, tiers, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Days the queries cut the tables at.
BATCH_UNTIL = "2000-12-31"
ALIVE_SINCE = "2024-01-29 00:00:00"
AS_OF = "2024-01-31"


def query(build: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    """Register ``build`` under its name; results have doubles and zone-less times."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = as_doubles(build(TestTables(spark, folder)))
        zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df

    QUERIES[build.__name__] = run
    return build


def stored_prices(t: TestTables) -> DataFrame:
    """Prices as the table a lake has, not as a plan below each join."""
    return written(t.prices(), "prices")


def stored_assets(t: TestTables) -> DataFrame:
    return written(t.assets(), "assets")


# Scans and dimensions

@query
def scan_table(t: TestTables) -> DataFrame:
    return tables.scan(t.spark, f"{t.folder}/lineitem.parquet")


@query
def scan_partition_pruned(t: TestTables) -> DataFrame:
    path = new_path(t.spark, "rewards")
    layout.write_by_date(t.rewards(), path)
    return tables.scan(t.spark, path, "2024-01-10", "2024-01-19")


@query
def filter_by_type(t: TestTables) -> DataFrame:
    return tables.of_type(t.table("events"), "event_type", "purchase").select(
        "event_id", "user_id", "event_type", "value")


@query
def distinct_keys(t: TestTables) -> DataFrame:
    return tables.distinct_keys(t.transactions(), *positions.POSITION)


@query
def dim_date(t: TestTables) -> DataFrame:
    dates = t.table("orders").select(F.to_date("o_orderdate").alias("date"))
    return dimensions.calendar(dimensions.date_bounds(dates))


@query
def dim_asset(t: TestTables) -> DataFrame:
    return t.assets()


@query
def decode_props(t: TestTables) -> DataFrame:
    return streams.decode(t.table("events").select("event_id", "props"), "props", "k INT").drop("props")


@query
def stream_source_rows(t: TestTables) -> DataFrame:
    rows = sinks.drained(t.stream("events").select("event_type", "value"), "source")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("num_rows"), exact_sum("value").alias("total_value"))


# Positions

@query
def signed_transactions(t: TestTables) -> DataFrame:
    return positions.sign(t.transactions()).select(
        "tx_id", "user_id", "symbol", "date", "tx_type", "signed_quantity", "signed_cost", "fee")


@query
def daily_position_delta(t: TestTables) -> DataFrame:
    return positions.daily_delta(positions.sign(t.transactions()))


@query
def cumulative_holdings(t: TestTables) -> DataFrame:
    return positions.positions(t.transactions()).select(
        "user_id", "symbol", "date", *positions.RUNNING, "num_trades")


@query
def cumulative_incremental(t: TestTables) -> DataFrame:
    trades = t.transactions()
    old = positions.positions(trades.filter(F.col("date") <= F.lit(BATCH_UNTIL).cast("date")))
    old = written(old, "positions")
    new = positions.positions(trades.filter(F.col("date") > F.lit(BATCH_UNTIL).cast("date")), seed=old)
    return old.unionByName(new).select("user_id", "symbol", "date", *positions.RUNNING, "num_trades")


@query
def holdings_priced(t: TestTables) -> DataFrame:
    priced = positions.priced(positions.positions(t.transactions()), stored_prices(t))
    return priced.select("user_id", "symbol", "date", "quantity_held", "total_cost_basis", "market_price")


def _pnl(t: TestTables) -> DataFrame:
    held = positions.in_doubles(positions.positions(t.transactions()))
    return positions.pnl(positions.priced(held, stored_prices(t)))


@query
def avg_cost_basis(t: TestTables) -> DataFrame:
    held = positions.in_doubles(positions.positions(t.transactions()))
    return held.select("user_id", "symbol", "date", "avg_cost_basis")


@query
def market_value(t: TestTables) -> DataFrame:
    return _pnl(t).select("user_id", "symbol", "date", "market_value")


@query
def unrealized_pnl(t: TestTables) -> DataFrame:
    return _pnl(t).select("user_id", "symbol", "date", "unrealized_pnl", "unrealized_pnl_pct")


@query
def realized_pnl(t: TestTables) -> DataFrame:
    return _pnl(t).select("user_id", "symbol", "date", "realized_pnl")


@query
def portfolio_snapshot(t: TestTables) -> DataFrame:
    return positions.snapshot(t.transactions(), stored_prices(t))


@query
def surrogate_keys(t: TestTables) -> DataFrame:
    keys = tables.distinct_keys(t.transactions(), "user_id", "symbol", "date")
    return keys.withColumn("snapshot_id", surrogate_key("user_id", "symbol", "date"))


def _stored_snapshot(t: TestTables) -> DataFrame:
    """The fact table as a lake has it: in folders by date."""
    path = new_path(t.spark, "snapshot")
    layout.write_by_date(positions.snapshot(t.transactions(), stored_prices(t)), path)
    return tables.scan(t.spark, path)


@query
def latest_snapshot(t: TestTables) -> DataFrame:
    return positions.on_latest_date(_stored_snapshot(t))


@query
def latest_position(t: TestTables) -> DataFrame:
    return positions.latest(positions.snapshot(t.transactions(), stored_prices(t)), BATCH_UNTIL)


@query
def top_portfolios(t: TestTables) -> DataFrame:
    return positions.top_portfolios(_stored_snapshot(t))


@query
def snapshot_stats(t: TestTables) -> DataFrame:
    return positions.stats(positions.snapshot(t.transactions(), stored_prices(t)))


def _dense(t: TestTables, *by: str) -> DataFrame:
    """Every position on every day, valued and summed."""
    totals = positions.with_next(positions.positions(t.transactions())).select(
        *positions.POSITION, "date", "next_date", "quantity_held", "total_cost_basis")
    sums = positions.dense_snapshot(written(totals, "totals"), stored_prices(t), summed_by=by)
    return sums.withColumns({"quantity_held": to_double("quantity_held"), "market_value": to_double("market_value", 2),
                             "unrealized_pnl": to_double("unrealized_pnl", 2)})


@query
def dense_daily_snapshot(t: TestTables) -> DataFrame:
    """Every position on every day, summed per symbol and day."""
    return _dense(t, "symbol", "date")


@query
def dense_position_days(t: TestTables) -> DataFrame:
    """The same rows per position: how many days, which, and what they add up to."""
    return _dense(t, "user_id", "symbol")


@query
def exact_sum_small_amounts(t: TestTables) -> DataFrame:
    """Sums of amounts around 1e-9, counted in steps of 1e-14."""
    lines = t.transactions().select("symbol", (F.col("total_value") * 1e-12).alias("tiny"))
    sums = lines.groupBy("symbol").agg(split_sum("tiny").alias("s"))
    return sums.select("symbol", (to_decimal("s") * F.expr("100000000000000BD")).cast("bigint").alias("steps"))


@query
def asset_correlation(t: TestTables) -> DataFrame:
    pairs = market.asset_correlation(t.prices(), blocks=2)
    return pairs.withColumn("correlation", F.round("correlation", 6))


@query
def correlation_by_runs(t: TestTables) -> DataFrame:
    """The same from stored co-moments, which the last two years join later."""
    path, prices = new_path(t.spark, "moments"), written(t.prices(), "prices")
    last = prices.agg(F.max("date")).first()[0]
    since = f"{last.year - 1}-01-01"
    market.grow_moments(prices.filter(F.col("date") < F.lit(since).cast("date")), path, blocks=2)
    grown = market.correlation_of(market.grow_moments(prices, path, since, blocks=2))
    return grown.withColumn("correlation", F.round("correlation", 6))


@query
def ohlcv_batch(t: TestTables) -> DataFrame:
    return market.candles(t.ticks(), "5 minutes")


# Rewards

@query
def daily_cashback(t: TestTables) -> DataFrame:
    return rewards.daily_cashback(t.rewards())


@query
def daily_staking(t: TestTables) -> DataFrame:
    return rewards.daily_staking(t.rewards())


@query
def daily_rewards(t: TestTables) -> DataFrame:
    return rewards.daily_rewards(t.rewards())


@query
def daily_buy_spend(t: TestTables) -> DataFrame:
    return rewards.daily_buy_spend(t.spend())


def _rolling_spend(t: TestTables, days: int = 30) -> DataFrame:
    return rewards.rolling(rewards.daily_buy_spend(t.spend()), "daily_buy_spend", "rolling_30d_spend", days)


@query
def rolling_spend(t: TestTables) -> DataFrame:
    return _rolling_spend(t)


@query
def rolling_spend_7d(t: TestTables) -> DataFrame:
    return _rolling_spend(t, 7).withColumnRenamed("rolling_30d_spend", "rolling_7d_spend")


@query
def lifetime_spend(t: TestTables) -> DataFrame:
    return rewards.lifetime(rewards.daily_buy_spend(t.spend()), "daily_buy_spend", "lifetime_spend")


@query
def rolling_rewards(t: TestTables) -> DataFrame:
    daily = rewards.daily_rewards(t.rewards()).select("user_id", "date", "total_reward_value")
    return rewards.rolling(daily, "total_reward_value", "rolling_30d_rewards", digits=4)


@query
def lifetime_rewards(t: TestTables) -> DataFrame:
    daily = rewards.daily_rewards(t.rewards()).select("user_id", "date", "total_reward_value")
    return rewards.lifetime(daily, "total_reward_value", "lifetime_rewards", digits=4)


@query
def reward_spend_enriched(t: TestTables) -> DataFrame:
    joined = rewards.with_spend(rewards.daily_rewards(t.rewards()), _rolling_spend(t))
    return joined.select("user_id", "date", "total_reward_value", "daily_buy_spend", "rolling_30d_spend")


@query
def reward_with_user(t: TestTables) -> DataFrame:
    daily = rewards.daily_rewards(t.rewards()).select("user_id", "date", "total_reward_value")
    return rewards.with_user(daily, t.solvent_users())


@query
def suggested_tier(t: TestTables) -> DataFrame:
    return rewards.suggest_tier(_rolling_spend(t))


def _summary(t: TestTables, **options) -> DataFrame:
    return rewards.summary(t.rewards(), t.spend(), t.users(), **options)


@query
def tier_upgrade(t: TestTables) -> DataFrame:
    return _summary(t).select("user_id", "date", "user_tier", "suggested_tier", "tier_upgrade_eligible")


@query
def tier_upgrade_lexical(t: TestTables) -> DataFrame:
    return _summary(t, order="lexical").select(
        "user_id", "date", "user_tier", "suggested_tier", "tier_upgrade_eligible")


@query
def reward_summary(t: TestTables) -> DataFrame:
    return _summary(t)


@query
def reward_summary_by_reward_day(t: TestTables) -> DataFrame:
    return _summary(t, days=7, spend_on="reward_day").select(
        "user_id", "date", F.col("rolling_30d_spend").alias("rolling_spend"),
        F.col("rolling_30d_rewards").alias("rolling_rewards"), "suggested_tier", "tier_upgrade_eligible")


@query
def reward_by_tier(t: TestTables) -> DataFrame:
    return rewards.by_tier(_summary(t))


@query
def upgrade_eligible_users(t: TestTables) -> DataFrame:
    return rewards.upgrade_eligible_users(_summary(t))


# Accruals

@query
def price_lookup_default(t: TestTables) -> DataFrame:
    trades = t.transactions().select("tx_id", "symbol", "date", "quantity")
    return accruals.with_price(trades, stored_prices(t), stored_assets(t))


@query
def trade_valuation(t: TestTables) -> DataFrame:
    trades = t.transactions().select("tx_id", "symbol", "date", "quantity")
    return accruals.value_trades(trades, stored_prices(t), stored_assets(t))


@query
def cashback_accrual(t: TestTables) -> DataFrame:
    spend = tables.of_type(t.table("events"), "event_type", "purchase").select(
        F.col("event_id").alias("reward_id"), "user_id", F.col("value").alias("spend_amount"))
    return accruals.accrue_cashback(spend, t.users())


@query
def staking_accrual(t: TestTables) -> DataFrame:
    stakes = streams.decode(tables.of_type(t.table("events"), "event_type", "signup"), "props", "k INT")
    return accruals.accrue_staking(stakes.select(
        F.col("event_id").alias("reward_id"), "user_id", F.col("value").alias("staked_value"),
        (F.col("k") / 1000).alias("apy")))


# Quality

def _warehouse(t: TestTables) -> dict[str, DataFrame | None]:
    """The checked tables: stored facts, two with faults, one that is missing."""
    return {
        "dim_user": t.suspect_users(),
        "dim_asset": t.assets(),
        "dim_date": tables.scan_if_present(t.spark, f"{t.folder}/no_such_table.parquet"),
        "fact_portfolio_daily": written(positions.snapshot(t.transactions(), stored_prices(t)), "snapshot"),
        "fact_reward_daily": written(_summary(t), "rewards"),
        "raw_transactions": t.suspect_transactions(),
        "raw_prices": t.prices(),
        "raw_rewards": t.rewards(),
    }


@query
def dq_row_counts(t: TestTables) -> DataFrame:
    checked = {"raw_transactions": t.transactions(), "raw_prices": t.prices(),
               "raw_rewards": t.rewards(), "dim_user": t.users(), "dim_asset": t.assets()}
    floors = {name: quality.ROW_FLOORS[name] for name in checked}
    return quality.run_checks(t.spark, checked, quality.row_floors(floors))


@query
def dq_null_checks(t: TestTables) -> DataFrame:
    checked = {"raw_transactions": t.suspect_transactions(), "dim_user": t.suspect_users().drop("tier")}
    required = {name: quality.REQUIRED[name] for name in checked}
    return quality.run_checks(t.spark, checked, quality.required_columns(required))


@query
def dq_range_checks(t: TestTables) -> DataFrame:
    checks = [c for c in quality.ranges() if c.table == "raw_transactions"]
    return quality.run_checks(t.spark, {"raw_transactions": t.suspect_transactions()}, checks)


@query
def dq_enum_checks(t: TestTables) -> DataFrame:
    checked = {"raw_transactions": t.suspect_transactions(), "dim_user": t.suspect_users()}
    return quality.run_checks(t.spark, checked, quality.allowed_values())


@query
def dq_orphan_users(t: TestTables) -> DataFrame:
    return quality.orphans(t.transactions(), t.solvent_users(), "user_id")


@query
def dq_orphan_assets(t: TestTables) -> DataFrame:
    mean = t.table("part").agg(
        (exact_sum("p_retailprice") / F.count("p_retailprice")).alias("mean"))
    dear = t.assets().filter(F.col("base_price") >= mean.scalar())
    return quality.orphans(t.transactions(), dear, "symbol")


@query
def dq_report(t: TestTables) -> DataFrame:
    return quality.report(t.spark, _warehouse(t))


@query
def dq_summary(t: TestTables) -> DataFrame:
    return quality.summary(quality.report(t.spark, _warehouse(t)))


@query
def dq_freshness(t: TestTables) -> DataFrame:
    checked = {"raw_transactions": t.transactions(), "raw_prices": t.prices(), "raw_rewards": t.rewards(),
               "dim_user": t.users()}
    return quality.freshness(t.spark, checked, AS_OF)


@query
def dq_cross_table(t: TestTables) -> DataFrame:
    def only(kind: str, column: str):
        return F.when(F.col("reward_type") == kind, F.col(column))

    measures = {
        "cashback_earned": (exact_sum("cashback_earned"), exact_sum("CASE WHEN reward_type = 'cashback' THEN reward_amount END")),
        "cashback_count": (F.sum("cashback_count"), F.count(only("cashback", "reward_id"))),
        "staking_earned": (exact_sum("staking_earned"), exact_sum("CASE WHEN reward_type = 'staking' THEN reward_amount END")),
        "staking_count": (F.sum("staking_count"), F.count(only("staking", "reward_id"))),
        "cashback_only_spend": (exact_sum("cashback_spend"), exact_sum("spend_amount")),
    }
    return quality.cross_table(_summary(t), t.rewards(), measures, "fact_reward_daily", "raw_rewards")


@query
def stage_transactions(t: TestTables) -> DataFrame:
    staged = quality.stage(t.suspect_transactions(), quality.transaction_rules())
    return staged.select("tx_id", "user_id", "tx_type", "quantity", "price", "reasons")


# Layout

@query
def roundtrip_partitioned(t: TestTables) -> DataFrame:
    path = new_path(t.spark, "rewards")
    layout.write_by_date(t.rewards(), path)
    return tables.scan(t.spark, path)


@query
def incremental_new_dates(t: TestTables) -> DataFrame:
    return layout.new_dates(t.transactions(), t.prices())


@query
def compact_rows(t: TestTables) -> DataFrame:
    small = new_path(t.spark, "prices")
    t.prices().repartition(40).write.parquet(small)
    return layout.compact(t.spark.read.parquet(small), new_path(t.spark, "compacted"))


@query
def clustered_layout(t: TestTables) -> DataFrame:
    rows = t.transactions().select("tx_id", "user_id", "symbol", "date", "total_value")
    return written(layout.cluster(rows, "user_id", "symbol"), "clustered")


# Serving

MONEY = ["quantity_held", "total_cost_basis"]


def _both_views(t: TestTables) -> tuple[DataFrame, DataFrame]:
    """Positions as of a day, and what changed since."""
    trades = t.transactions()
    batch = as_decimals(positions.latest(positions.positions(trades), BATCH_UNTIL)).select(
        *positions.POSITION, "quantity_held", "total_cost_basis", F.col("date").alias("updated_on"))
    since = positions.sign(trades.filter(F.col("date") > F.lit(BATCH_UNTIL).cast("date")))
    realtime = as_decimals(since.groupBy(*positions.POSITION).agg(
        split_sum("signed_quantity").alias("quantity_held"),
        split_sum("signed_cost").alias("total_cost_basis"),
        F.max("date").alias("updated_on")))
    return batch, realtime


@query
def merge_batch_realtime(t: TestTables) -> DataFrame:
    merged = serving.merge(*_both_views(t), positions.POSITION, add=MONEY, replace=["updated_on"])
    return merged.withColumns({c: F.col(c).cast("double") for c in MONEY})


@query
def merge_of_one_user(t: TestTables) -> DataFrame:
    """The merged view of the user with the most trades, from tables stored by user."""
    top = t.transactions().groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first().user_id
    views = []
    for df in _both_views(t):
        name = f"by_user_{uuid.uuid4().hex}"
        views.append(serving.store_by_key(df, name, new_path(t.spark, name), buckets=16))
    merged = serving.merge_of_one(*views, "user_id", top, positions.POSITION, add=MONEY, replace=["updated_on"])
    return merged.withColumns({c: F.col(c).cast("double") for c in MONEY})


@query
def curve_layout(t: TestTables) -> DataFrame:
    rows = t.transactions().select("tx_id", "user_id", "symbol", "date", "total_value")
    return written(layout.cluster_by_curve(rows, "user_id", "date"), "curve")


@query
def compact_small_files(t: TestTables) -> DataFrame:
    """Prices of each year in many small files, merged where they lie."""
    path = new_path(t.spark, "small")
    yearly = t.prices().withColumn("year", F.trunc("date", "year"))
    yearly.repartition(12).write.partitionBy("year").parquet(path)
    layout.compact_small(t.spark, path, 1 << 20, "year")
    return t.spark.read.parquet(path).select("symbol", "date", "close")


@query
def fingerprint_check(t: TestTables) -> DataFrame:
    """Cashback per day as stored, less one user's, against what the rewards give again."""
    fact = written(rewards.daily_cashback(t.rewards()), "cashback")
    least = fact.agg(F.min("user_id")).first()[0]
    found = quality.same_days(fact.filter(F.col("user_id") != least), rewards.daily_cashback(t.rewards()), "cashback")
    return found.select("check", "status", "value")


@query
def trades_once(t: TestTables) -> DataFrame:
    """Trades of which a third arrives a second time, 200 days later."""
    own = F.concat_ws("-", "tx_id", "quantity", "total_value")
    trades = repeats.equal_once(written(t.transactions().withColumn("tx_id", own), "trades"))
    again = trades.filter(F.pmod(F.xxhash64("tx_id"), F.lit(3)) == 0).withColumn("date", F.date_add("date", 200))
    return repeats.once(trades.unionByName(again), "tx_id").drop("tx_id")


@query
def reconciliation(t: TestTables) -> DataFrame:
    """Batch knows all trades up to a day; real time only buys, of all days."""
    trades = t.transactions()
    keys = ("user_id", "date")

    def totals(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(exact_sum("total_value").alias("total_value"))

    batch = totals(trades.filter(F.col("date") <= F.lit(BATCH_UNTIL).cast("date")))
    realtime = totals(trades.filter(F.col("tx_type") == "buy"))
    return serving.reconcile(batch, realtime, keys, "total_value")


@query
def messages_of_candles(t: TestTables) -> DataFrame:
    """Candlesticks as messages, read back."""
    bars = market.candles(t.ticks(), "5 minutes")
    sent = sinks.to_messages(bars, "symbol")
    return sent.select("key", F.from_json("value", bars.schema).alias("v")).select("key", "v.*")


@query
def latest_view_upsert(t: TestTables) -> DataFrame:
    changes = t.stream("events").select("user_id", "event_id", "event_type", "value", "ts")
    log = sinks.drained(changes, "changes")
    return serving.latest_view(log, ["user_id"], ["ts", "event_id"], "ts", ALIVE_SINCE)


# Streams

@query
def stream_to_raw(t: TestTables) -> DataFrame:
    rows = t.stream("events").withColumn("date", F.to_date("ts"))
    return sinks.drained(rows, "raw", partition_by="date")


@query
def stream_ohlcv_1m(t: TestTables) -> DataFrame:
    return sinks.drained(windows.ohlcv(t.ticks(t.stream("events")), "1 minute"), "ohlcv")


@query
def stream_ohlcv_5m(t: TestTables) -> DataFrame:
    return sinks.drained(windows.ohlcv(t.ticks(t.stream("events")), "5 minutes"), "ohlcv")


@query
def stream_late_data(t: TestTables) -> DataFrame:
    """Errors arrive ten days after they happened; the rest arrives at once."""
    ticks = t.ticks()
    arrival = F.when(F.col("symbol") == "error", F.col("ts") + F.expr("interval 10 days")).otherwise(F.col("ts"))
    third = F.floor(F.datediff(F.to_date(arrival), F.lit("2024-01-01").cast("date")) / 10)
    arriving = ticks.withColumn("_third", third)
    batches = [arriving.filter(F.col("_third") == n).drop("_third") for n in range(4)]
    return sinks.replayed(batches, lambda rows: windows.ohlcv(rows, "5 minutes"), "late")


@query
def stream_dedup(t: TestTables) -> DataFrame:
    events = t.events(t.stream("events")).drop("props")
    return sinks.drained(windows.dedup(events.unionByName(events)), "dedup")


@query
def stream_reward_tier(t: TestTables) -> DataFrame:
    spend = t.events(t.spend(t.stream("events")))
    return sinks.drained(tiers.reward_tier(spend), "tiers")


@query
def stream_reward_tier_now(t: TestTables) -> DataFrame:
    """Each user's tier on the day of the last purchase; days arrive one third after the other."""
    spend = t.events(t.spend(t.table("events")))
    first, last = spend.agg(F.min("date"), F.max("date")).first()
    third = F.floor(F.datediff("date", F.lit(first)) * 3 / ((last - first).days + 1))
    log = sinks.replayed([spend.filter(third == n) for n in range(3)], tiers.reward_tier_now, "tiers")
    return tiers.current(log).drop("version")


def _with_pauses(spend: DataFrame) -> DataFrame:
    """Purchases with 45 quiet days after every 20 days, which no rolling sum outlasts."""
    pause = F.floor(F.unix_date("date") / 20) * 45
    return spend.withColumns({"ts": F.col("ts") + F.make_dt_interval(pause.cast("int")), "date": F.date_add("date", pause.cast("int"))})


@query
def stream_reward_tier_after_pauses(t: TestTables) -> DataFrame:
    """Each user's spend and tier now, after falling to nothing and coming back; blocks of days arrive one by one."""
    spend = _with_pauses(t.events(t.spend(t.table("events"))))
    first, last = spend.agg(F.min("date"), F.max("date")).first()
    fifth = F.floor(F.datediff("date", F.lit(first)) * 5 / ((last - first).days + 1))
    log = sinks.replayed([spend.filter(fifth == n) for n in range(5)], tiers.reward_tier_now, "tiers")
    return tiers.current(log).drop("version", "date")


def _thirds(rows: DataFrame, key: str) -> list[DataFrame]:
    """All rows in three arrivals, by a hash."""
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(3)) == n) for n in range(3)]


def _position_log(t: TestTables, *arrivals: DataFrame) -> DataFrame:
    def build(lines: DataFrame) -> DataFrame:
        trades = positions.sign(t.transactions(lines)).withColumn("ts", F.col("date").cast("timestamp"))
        return live_pnl.daily_changes(trades)

    return sinks.replayed(arrivals, build, "changes", updates=True)


@query
def live_pnl_view(t: TestTables) -> DataFrame:
    """Positions and prices that arrive in three steps, each resuming the streams."""
    lines = t.table("lineitem")
    prices = sinks.replayed(_thirds(lines, "l_partkey"), lambda rows: live_pnl.quotes(t.price_ticks(rows)), "quotes", updates=True)
    view = live_pnl.valued(live_pnl.positions_of(_position_log(t, *_thirds(lines, "l_orderkey"))), prices)
    return view.select(
        "user_id", "symbol", "quantity_held", F.round("total_cost_basis", 2).alias("total_cost_basis"),
        "price", F.round("market_value", 2).alias("market_value"),
        F.round("unrealized_pnl", 2).alias("unrealized_pnl"))


def _monthly_prices(t: TestTables) -> DataFrame:
    """Prices by month, which makes a lake of fewer folders."""
    return t.prices().groupBy("symbol", F.trunc("date", "month").alias("date")).agg(F.max("close").alias("close"))


def _own_id(number: str | Column, quantity: str, value: str) -> Column:
    return F.concat_ws("-", number, quantity, value)  # some lines share all their numbers


def _lake(t: TestTables, late: Column) -> Lake:
    """A lake whose job ran, then got the ``late`` trades and ran again for what changed."""
    lake = Lake(new_path(t.spark, "lake"))
    lines = t.lines().withColumn("date", F.trunc("date", "month"))
    named = lines.withColumn("tx_id", _own_id(t.trade_number(), "l_quantity", "l_extendedprice"))

    def trades(rows: DataFrame) -> DataFrame:
        return t.as_transactions(rows).withColumn("tx_id", _own_id("tx_id", "quantity", "total_value"))

    with scratch(t.spark):
        layout.write_by_date(_monthly_prices(t), lake.raw("prices"))
        layout.write_by_date(named.filter(~late).drop("tx_id"), lake.raw("transactions"), finish=trades)
        portfolio.run(t.spark, lake.base, incremental=True)
        again = trades(named.filter(late).drop("tx_id").hint("rebalance", F.col("date")))
        again.write.mode("append").partitionBy("date").parquet(lake.raw("transactions"))
        portfolio.run(t.spark, lake.base, incremental=True)
    return lake


@query
def incremental_after_late_trades(t: TestTables) -> DataFrame:
    late = F.pmod(F.xxhash64("tx_id"), F.lit(7)) == 0
    return tables.scan(t.spark, _lake(t, late).warehouse("fact_portfolio_daily"))


@query
def reconcile_positions(t: TestTables) -> DataFrame:
    """Batch closing against the stream's log, which lacks the lines numbered 6: those are planted faults."""
    lake = _lake(t, F.lit(False))
    lines = t.table("lineitem").filter("l_linenumber <> 6")
    reconciliation_job.run(t.spark, lake.base, _stored_log(t, lines))
    return tables.scan(t.spark, lake.warehouse("fact_reconciliation"))


def _stored_log(t: TestTables, lines: DataFrame) -> str:
    path = new_path(t.spark, "log")
    with scratch(t.spark):
        _position_log(t, *_thirds(lines, "l_orderkey")).write.parquet(path)
    return path


@query
def realtime_raw_complete(t: TestTables) -> DataFrame:
    """Events in three arrivals, the second with repeats of the first, the last older than any delay."""
    events = t.events().drop("props")
    days = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(days[0]) + (F.lit(days[1]) - F.lit(days[0])) / 2
    early, rest = events.filter(F.col("ts") < middle), events.filter(F.col("ts") >= middle)
    repeats = rest.filter(F.pmod("event_id", F.lit(2)) == 0)
    landed = sinks.replayed([rest, repeats, early], realtime.landed, "raw")
    return windows.once(landed, "event_id").drop("date")


@query
def daily_prices_from_ticks(t: TestTables) -> DataFrame:
    return portfolio.closes(t.ticks())


@query
def stream_ohlcv_updates(t: TestTables) -> DataFrame:
    """Candles that are given again when late ticks come: the newest version of each."""
    ticks = t.ticks()
    days = ticks.agg(F.max("ts")).first()[0]
    arrivals = [ticks.filter(F.col("symbol") != "error"), ticks.filter(F.col("symbol") == "error")]
    log = sinks.replayed(arrivals, lambda rows: market.candles(rows, "5 minutes"), "updates", updates=True)
    view = serving.latest_view(log, ["symbol", "window_start"], ["version"])
    return view.filter(F.col("window_start") <= F.lit(days)).drop("version")


# The survey's names for two queries whose operators are modules of that name.
QUERIES["surrogate_key"] = QUERIES.pop("surrogate_keys")
QUERIES["live_pnl"] = QUERIES.pop("live_pnl_view")
