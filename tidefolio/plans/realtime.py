"""Job: the streams, from incoming events to raw tables and real-time views.

Whatever comes in is landed in the raw zone by date as it came, repeated, late or without an
id: nothing is lost between arrival and the batch jobs, which remove repeats where they read.
The views follow the landed tables, so a view can be rebuilt from raw data by giving it a new
checkpoint; they give up on events that are later than their delay, which the batch view then shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefolio.operators import positions
from tidefolio.plans.lake import Lake
from tidefolio.sources.streams import stream
from tidefolio.sources.tables import of_type
from tidefolio.streaming import live_pnl, sinks, tiers, windows

TICK = "event_id bigint, symbol string, ts timestamp, price double, volume double"
TRADE = ("tx_id string, user_id string, symbol string, tx_type string, quantity double, price double, "
         "total_value double, fee double, ts timestamp")
REWARD = ("reward_id string, user_id string, reward_type string, reward_amount double, spend_amount double, "
          "tier_at_time string, ts timestamp")
INCOMING = {"ticks": (TICK, "event_id"), "transactions": (TRADE, "tx_id"), "rewards": (REWARD, "reward_id")}
# How late a trade may be, and how long after the first a repeat is known as one.
TRADE_DELAY = "7 days"


def _raw(spark: SparkSession, lake: Lake, table: str) -> DataFrame:
    return stream(spark, lake.raw(table), f"{INCOMING[table][0]}, date date")


def views(ticks: DataFrame, trades: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The real-time views of a stream of ticks and one of trades: those that append, and logs of changes."""
    ticks = windows.dedup(ticks, ["event_id"])
    soon, trades = windows.dedup(trades, ["tx_id"]), windows.dedup(trades, ["tx_id"], TRADE_DELAY)
    appended = {
        "ohlcv_1m": windows.ohlcv(ticks, "1 minute"),
        "ohlcv_5m": windows.ohlcv(ticks, "5 minutes"),
        "reward_tier": tiers.reward_tier(of_type(soon, "tx_type", positions.BUY)),
        "reward_tier_now": tiers.reward_tier_now(of_type(soon, "tx_type", positions.BUY)),
    }
    return appended, {
        "ohlcv_1m_updates": windows.ohlcv(ticks, "1 minute"),
        "position_changes": live_pnl.daily_changes(positions.sign(trades), TRADE_DELAY),
        "quotes": live_pnl.quotes(ticks.withColumnRenamed("event_id", "tie")),
    }


def portfolio_pnl(spark: SparkSession, base: str) -> DataFrame:
    """Every position at its newest price, from the logs that the views left."""
    lake = Lake(base)
    read = spark.read.parquet
    return live_pnl.valued(live_pnl.positions_of(read(lake.realtime("position_changes"))), read(lake.realtime("quotes")))


def tiers_now(spark: SparkSession, base: str) -> DataFrame:
    """Every user's rolling spend and tier now, those who went quiet included."""
    return tiers.current(spark.read.parquet(Lake(base).realtime("reward_tier_now")))


# Change log -> the keys of its rows.
LOGS = {"ohlcv_1m_updates": ("symbol", "window_start"), "position_changes": ("user_id", "symbol", "date"), "quotes": ("symbol",)}


def fold(spark: SparkSession, base: str) -> dict[str, dict[str, int]]:
    """Fold the logs of changes, while no stream of theirs runs or while it does: unfinished versions are left alone."""
    lake = Lake(base)
    return {name: sinks.fold(spark, lake.realtime(name), lake.checkpoint(name), keys) for name, keys in LOGS.items()}


# View -> the column that keys its messages.
PUBLISHED = {"ohlcv_1m": "symbol", "ohlcv_5m": "symbol", "reward_tier": "user_id"}


def run(spark: SparkSession, base: str, every: str | None = None, servers: str | None = None) -> list[StreamingQuery]:
    """Land what came in, then bring the views up to date.

    With ``servers`` the views that append are also sent to Kafka, each to the topic of its name.

    Without ``every`` each stream stops when it has used up its input. With it,
    for example ``"60 seconds"``, all keep running and are returned.
    """
    lake = Lake(base)
    # Also with ``every``: the views can only follow tables that exist.
    _finish(_landing(spark, lake, None))
    running = _landing(spark, lake, every) if every else []
    appended, changed = views(_raw(spark, lake, "ticks"), _raw(spark, lake, "transactions"))
    running += [sinks.land(rows, lake.realtime(name), lake.checkpoint(name), every=every)
                for name, rows in appended.items()]
    running += [sinks.land_changes(rows, lake.realtime(name), lake.checkpoint(name), every)
                for name, rows in changed.items()]
    if servers is not None:
        running += [sinks.publish(appended[name], key, servers, name, lake.checkpoint(f"published_{name}"), every)
                    for name, key in PUBLISHED.items()]
    if every is None:
        _finish(running)
    return running


def _landing(spark: SparkSession, lake: Lake, every: str | None) -> list[StreamingQuery]:
    return [sinks.land(landed(stream(spark, lake.incoming(table), schema)), lake.raw(table),
                       lake.checkpoint(f"raw_{table}"), "date", every)
            for table, (schema, _) in INCOMING.items() if _arrived(spark, lake.incoming(table))]


def landed(events: DataFrame) -> DataFrame:
    """Events as the raw zone keeps them: all of them, with their day."""
    return events.withColumn("date", F.to_date("ts"))


def _arrived(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _finish(queries: list[StreamingQuery]) -> None:
    for query in queries:
        query.awaitTermination()
