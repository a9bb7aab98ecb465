"""The generated test tables seen as trades, prices, users and rewards.

Plain projections and joins, the same for batches and for streams of the fact
table (``lineitem``, ``events``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.functions.tiers import CASHBACK_RATES, TIERS
from tidefolio.sources.dimensions import assets
from tidefolio.sources.streams import stream

# The market segment that stands for each tier.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


class TestTables:
    """Domain views over the Parquet tables of one folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream; the glob fits a single file and a folder of files."""
        return stream(self.spark, f"{self.folder}/{name}.parquet*", self.table(name).schema)

    def users(self) -> DataFrame:
        tier = F.element_at(F.create_map(*[F.lit(x) for pair in zip(SEGMENTS, TIERS) for x in pair]),
                            F.col("c_mktsegment"))
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))
        return (self.table("customer")
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .select(F.col("c_custkey").alias("user_id"), tier.alias("tier"), "country", "c_acctbal"))

    def _lines(self, lineitem: DataFrame) -> DataFrame:
        orders = self.table("orders").select(
            "o_orderkey", F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"))
        part = self.table("part").select("p_partkey", F.col("p_type").alias("symbol"), "p_retailprice")
        return (lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey")))

    def transactions(self, lineitem: DataFrame | None = None) -> DataFrame:
        return self.as_transactions(self.lines(lineitem))

    def lines(self, lineitem: DataFrame | None = None) -> DataFrame:
        """What :meth:`as_transactions` makes trades of: no texts and no figures that follow from others."""
        return self._lines(self.table("lineitem") if lineitem is None else lineitem).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "user_id", "symbol", "l_returnflag", "l_quantity", "l_extendedprice", "l_tax",
            "date")

    def trade_number(self) -> Column:
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def as_transactions(self, lines: DataFrame) -> DataFrame:
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        percent = F.rint(F.col("l_tax") * 100).cast("bigint")
        return lines.select(
            self.trade_number().alias("tx_id"),
            "user_id", "symbol",
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("tx_type"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("total_value"),
            (F.floor((cents * percent + 50) / 100) / 100).alias("fee"),
            "date")

    def suspect_transactions(self) -> DataFrame:
        """Trades as a careless source might send them, faults by their own values."""
        lines = self._lines(self.table("lineitem"))
        kind = (F.when(F.col("l_returnflag") == "R", "sell")
                .when(F.col("l_returnflag") == "A", "buy")
                .when(F.col("l_linestatus") == "O", "hold"))
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tx_id"),
            F.when(F.col("l_linenumber") != 7, F.col("user_id")).alias("user_id"),
            "symbol", kind.alias("tx_type"),
            F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("quantity"),
            F.when(F.col("l_tax") == 0.08, -price).otherwise(price).alias("price"),
            "date")

    def suspect_users(self) -> DataFrame:
        overdrawn = F.col("c_acctbal") < 0
        return self.users().withColumn("tier", F.when(overdrawn, "wood").otherwise(F.col("tier")))

    def solvent_users(self) -> DataFrame:
        return self.users().filter(F.col("c_acctbal") >= 0)

    def assets(self) -> DataFrame:
        return assets(self.table("part"), "p_type", "p_retailprice")

    def prices(self) -> DataFrame:
        quoted = self.table("lineitem").filter(F.col("l_linestatus") == "O")
        return self._lines(quoted).groupBy("symbol", "date").agg(F.max("p_retailprice").alias("close"))

    def price_ticks(self, lineitem: DataFrame) -> DataFrame:
        """The lines behind :meth:`prices` as ticks; a day's highest comes last."""
        quoted = self._lines(lineitem.filter(F.col("l_linestatus") == "O"))
        return quoted.select(
            "symbol", F.col("date").cast("timestamp").alias("ts"), F.col("p_retailprice").alias("price"),
            F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("tie"))

    def events(self, events: DataFrame | None = None) -> DataFrame:
        """Events with a time-zoned ``ts``, which watermarks need."""
        events = self.table("events") if events is None else events
        return events.withColumn("ts", F.col("ts").cast("timestamp"))

    def ticks(self, events: DataFrame | None = None) -> DataFrame:
        return self.events(events).select(
            "event_id", "ts", F.col("event_type").alias("symbol"),
            F.col("value").alias("price"), F.col("value").alias("volume"))

    def rewards(self) -> DataFrame:
        users = self.users().select("user_id", F.col("tier").alias("tier_at_time"))
        kind = F.when(F.col("event_type") == "purchase", "cashback").otherwise("staking")
        cashback = F.round(F.col("value") * _rate(F.col("tier_at_time")), 4)
        staking = F.round(F.col("value") * 0.08 / 365, 6)
        return (self.table("events")
                .filter(F.col("event_type").isin("purchase", "signup"))
                .join(users, "user_id", "left")
                .withColumn("reward_type", kind)
                .select(F.col("event_id").alias("reward_id"), "user_id", "reward_type",
                        F.when(F.col("reward_type") == "cashback", cashback).otherwise(staking)
                        .alias("reward_amount"),
                        F.col("value").alias("spend_amount"), "tier_at_time",
                        F.to_date("ts").alias("date")))

    def spend(self, events: DataFrame | None = None) -> DataFrame:
        events = self.table("events") if events is None else events
        return events.filter(F.col("event_type") == "click").select(
            F.col("event_id").alias("tx_id"), "user_id", F.lit("buy").alias("tx_type"),
            F.round(F.col("value") * 100, 2).alias("total_value"), "ts", F.to_date("ts").alias("date"))


def _rate(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CASHBACK_RATES.items() for x in pair]), tier)
