"""Dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.functions.amounts import exact_sum

# Symbol, name, category, base price of the listed assets.
LISTED_ASSETS = [
    ("BTC", "Bitcoin", "layer1", 42000.0),
    ("ETH", "Ethereum", "layer1", 2200.0),
    ("BNB", "BNB", "layer1", 310.0),
    ("SOL", "Solana", "layer1", 95.0),
    ("ADA", "Cardano", "layer1", 0.55),
    ("DOT", "Polkadot", "layer1", 7.80),
    ("AVAX", "Avalanche", "layer1", 35.0),
    ("LINK", "Chainlink", "oracle", 14.50),
    ("MATIC", "Polygon", "layer2", 0.85),
    ("CRO", "Cronos", "exchange", 0.088),
]


def listed_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED_ASSETS, "symbol string, name string, category string, base_price double")


def assets(items: DataFrame, symbol: str, price: str) -> DataFrame:
    """One row per symbol with its mean price as base price."""
    return (
        items.groupBy(F.col(symbol).alias("symbol"))
        .agg((exact_sum(price) / F.count(price)).alias("base_price"),
             F.count(F.lit(1)).alias("num_items"))
    )


def calendar(bounds: DataFrame) -> DataFrame:
    """Calendar rows from ``first_date`` to ``last_date`` of a one-row frame."""
    days = bounds.select(
        F.explode(F.sequence("first_date", "last_date", F.expr("interval 1 day"))).alias("date_id"))
    return days.select(
        "date_id",
        F.year("date_id").alias("year"),
        F.month("date_id").alias("month"),
        F.dayofmonth("date_id").alias("day"),
        F.quarter("date_id").alias("quarter"),
        F.date_format("date_id", "EEEE").alias("day_of_week"),
        (F.weekday("date_id") >= 5).cast("int").alias("is_weekend"),
    )


def date_bounds(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))
