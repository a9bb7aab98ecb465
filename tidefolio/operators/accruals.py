"""Valuation of trades and accrual of rewards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.functions.tiers import CASHBACK_RATES

FEE_RATE = 0.001


def with_price(trades: DataFrame, prices: DataFrame, assets: DataFrame) -> DataFrame:
    """Add the close of the trade's symbol and date, else the symbol's base price.

    Trades are joined unreduced, so ``prices`` and ``assets`` should be stored
    tables: broadcast below Catalyst's threshold, and above it joined by shuffles
    whose hot symbols AQE splits.
    """
    close = prices.select("symbol", "date", "close")
    base = assets.select("symbol", "base_price")
    return (trades.join(close, ["symbol", "date"], "left")
            .join(base, "symbol", "left")
            .withColumn("price", F.coalesce("close", "base_price"))
            .drop("close", "base_price"))


def value_trades(trades: DataFrame, prices: DataFrame, assets: DataFrame,
                 fee_rate: float = FEE_RATE) -> DataFrame:
    """Add price, total value (2 digits) and fee (on the rounded total, 2 digits)."""
    return (with_price(trades, prices, assets)
            .withColumn("total_value", F.round(F.col("price") * F.col("quantity"), 2))
            .withColumn("fee", F.round(F.col("total_value") * fee_rate, 2)))


def accrue_cashback(spend: DataFrame, users: DataFrame,
                    rates: Mapping[str, float] = CASHBACK_RATES) -> DataFrame:
    """Add tier, rate and cashback of each purchase.

    The rate table has one row per tier, a fixed size, and is broadcast; the
    user table is left to Catalyst.
    """
    rate_table = spend.sparkSession.createDataFrame(
        list(rates.items()), "tier string, cashback_rate double")
    return (spend.join(users.select("user_id", "tier"), "user_id", "left")
            .join(F.broadcast(rate_table), "tier", "left")
            .withColumn("reward_amount", F.round(F.col("spend_amount") * F.col("cashback_rate"), 4)))


def accrue_staking(stakes: DataFrame) -> DataFrame:
    """Add one day's staking reward of ``staked_value`` at yearly rate ``apy``."""
    return stakes.withColumn(
        "reward_amount", F.round(F.col("staked_value") * (F.col("apy") / 365), 6))
