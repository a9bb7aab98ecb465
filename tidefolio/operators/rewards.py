"""From reward events and purchases to daily summaries and tier suggestions.

Rewards: reward_id, user_id, reward_type, reward_amount, spend_amount, date
Trades:  user_id, tx_type, total_value, date
Users:   user_id, tier, country
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.functions import tiers
from tidefolio.functions.amounts import split_sum, sum_of_splits, to_double, with_exact_sum, with_sums_over
from tidefolio.functions.keys import surrogate_key
from tidefolio.operators.positions import BUY

CASHBACK, STAKING = "cashback", "staking"
USER_DAY = ("user_id", "date")


# Daily figures -> kind of reward, what is summed, digits.
FIGURES = {
    "cashback_earned": (CASHBACK, "reward_amount", 4), "cashback_spend": (CASHBACK, "spend_amount", 2),
    "staking_earned": (STAKING, "reward_amount", 6), "staked_value": (STAKING, "spend_amount", 2),
}
COUNTS = {"cashback_count": CASHBACK, "staking_count": STAKING}


def _rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """The split sums among the columns of ``df`` as rounded doubles."""
    return df.select(*[to_double(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _per_user_day(rewards: DataFrame, kind: str) -> DataFrame:
    own = {name: (amount, digits) for name, (k, amount, digits) in FIGURES.items() if k == kind}
    sums = rewards.filter(F.col("reward_type") == kind).groupBy(*USER_DAY).agg(
        *[split_sum(amount).alias(name) for name, (amount, _) in own.items()],
        *[F.count("reward_id").alias(name) for name, k in COUNTS.items() if k == kind])
    return _rounded(sums, {name: digits for name, (_, digits) in own.items()})


def daily_cashback(rewards: DataFrame) -> DataFrame:
    return _per_user_day(rewards, CASHBACK)


def daily_staking(rewards: DataFrame) -> DataFrame:
    return _per_user_day(rewards, STAKING)


def daily_rewards(rewards: DataFrame) -> DataFrame:
    """Cashback and staking of each user and day side by side, gaps as 0.

    The result of a full outer join of :func:`daily_cashback` and
    :func:`daily_staking`, from one scan and one shuffle. Such a join never
    matches NULL keys, so rows without user or date keep their kind in the key.
    """
    keyless = "user_id IS NULL OR date IS NULL"
    own = rewards.filter(F.col("reward_type").isin(CASHBACK, STAKING)).selectExpr(
        *USER_DAY, f"CASE WHEN {keyless} THEN reward_type END AS _alone",
        *[f"CASE WHEN reward_type = '{kind}' THEN {amount} END AS {name}" for name, (kind, amount, _) in FIGURES.items()],
        *[f"CASE WHEN reward_type = '{kind}' THEN reward_id END AS {name}" for name, kind in COUNTS.items()])
    sums = own.groupBy(*USER_DAY, "_alone").agg(
        *[split_sum(name).alias(name) for name in FIGURES], *[F.count(name).alias(name) for name in COUNTS]).drop("_alone")
    daily = _rounded(sums, {name: digits for name, (*_, digits) in FIGURES.items()}).fillna(0.0, subset=list(FIGURES))
    whole = with_exact_sum(daily, "total_reward_value", "cashback_earned", "staking_earned", 4)
    return whole.select(*USER_DAY, "cashback_earned", "cashback_spend", "cashback_count", "staking_earned", "staked_value",
                        "staking_count", "total_reward_value")


def daily_buy_spend(trades: DataFrame) -> DataFrame:
    bought = trades.filter(F.col("tx_type") == BUY).groupBy(*USER_DAY).agg(split_sum("total_value").alias("daily_buy_spend"))
    return _rounded(bought, {"daily_buy_spend": 2})


def _running(days: int, keys: tuple[str, ...]) -> tuple[str, str]:
    """Windows over all days up to this one, and over those more than ``days`` before it."""
    by_day = f"PARTITION BY {', '.join(keys)} ORDER BY unix_date(date) RANGE BETWEEN UNBOUNDED PRECEDING AND "
    return by_day + "CURRENT ROW", by_day + f"{days + 1} PRECEDING"


def rolling(daily: DataFrame, value: str, name: str, days: int = 30, digits: int = 2,
            keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Add the sum of ``value``, rounded to 8 digits or fewer, over the last ``days`` days and the day itself.

    ``daily`` holds one row per key and day, so a key's window is bounded by the
    calendar and not by its number of events.
    """
    return with_sums_over(daily, {name: (value, digits, *_running(days, keys))})


def lifetime(daily: DataFrame, value: str, name: str, digits: int = 2,
             keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Add each key's all-time sum to every row.

    What existing reports show under their "30 day" columns: their window key
    is NULL on every row, so all days of a user are peers.
    """
    return with_sums_over(daily, {name: (value, digits, f"PARTITION BY {', '.join(keys)}", None)})


def with_spend(daily: DataFrame, spend: DataFrame) -> DataFrame:
    """Add spend of the same user and day; 0 on days without a purchase."""
    joined = daily.join(spend, list(USER_DAY), "left")
    return joined.fillna(0.0, subset=[c for c in spend.columns if c not in USER_DAY])


def with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Add tier and country; rows of unknown users stay, with NULLs.

    Not hinted: a user table can be large. Rows are per user and day here and
    mostly already partitioned by user, so even the shuffled join moves only users.
    """
    known = users.select("user_id", F.col("tier").alias("user_tier"), "country")
    return rows.join(known, "user_id", "left")


def suggest_tier(rows: DataFrame, ladder: Mapping[str, float] = tiers.LADDER,
                 spend: str = "rolling_30d_spend") -> DataFrame:
    return rows.withColumn("suggested_tier", tiers.suggested_tier(F.col(spend), ladder))


def upgrade(rows: DataFrame, order: str = "ordinal") -> DataFrame:
    flag = tiers.is_upgrade(F.col("user_tier"), F.col("suggested_tier"), order)
    return rows.withColumn("tier_upgrade_eligible", flag)


# Columns of the fact table, in order.
SUMMARY_COLUMNS = (
    "reward_summary_id", "user_id", "user_tier", "country", "date",
    "cashback_earned", "cashback_spend", "cashback_count",
    "staking_earned", "staked_value", "staking_count",
    "total_reward_value", "daily_buy_spend", "rolling_30d_spend", "rolling_30d_rewards",
    "suggested_tier", "tier_upgrade_eligible",
)


def summary(rewards: DataFrame, trades: DataFrame, users: DataFrame, days: int = 30,
            order: str = "ordinal", spend_on: str = "buy_day") -> DataFrame:
    """Daily reward summary of every user who earned something that day.

    ``spend_on="buy_day"`` shows rolling spend only on days with a purchase and
    0 on others; ``"reward_day"`` evaluates it on every reward day.

    Reward days and purchase days are stacked and go to the user's partition
    once; one window there gives both rolling sums and the day's own spend. The
    join by (user, date) and a second window shuffle are not needed, and the
    user join finds the rows already partitioned by user.
    """
    if spend_on not in ("buy_day", "reward_day"):
        raise ValueError(f"unknown spend_on: {spend_on}")
    keyed = F.col("user_id").isNotNull() & F.col("date").isNotNull()
    stacked = daily_rewards(rewards).withColumn("_reward", F.lit(True)).unionByName(
        daily_buy_spend(trades).filter(keyed), allowMissingColumns=True)

    now, before = _running(days, ("user_id",))
    _, until_yesterday = _running(0, ("user_id",))
    summed = with_sums_over(stacked, {
        "_bought": ("daily_buy_spend", 2, now, until_yesterday),
        "_spent": ("daily_buy_spend", 2, now, before),
        "rolling_30d_rewards": ("total_reward_value", 4, now, before),
    }).filter(F.col("_reward"))
    bought, spent = (F.when(keyed, F.col(c)) for c in ("_bought", "_spent"))
    if spend_on == "buy_day":
        spent = F.when(bought.isNotNull(), spent)
    rows = summed.withColumns({"daily_buy_spend": F.coalesce(bought, F.lit(0.0)), "rolling_30d_spend": F.coalesce(spent, F.lit(0.0))}) \
        .drop("_bought", "_spent")
    facts = upgrade(suggest_tier(with_user(rows, users)), order)
    return facts.withColumn("reward_summary_id", surrogate_key(*USER_DAY)).select(*SUMMARY_COLUMNS)


def by_tier(summary: DataFrame) -> DataFrame:
    """Totals and distinct users per tier.

    Summed per user first: five tiers alone would leave five busy tasks.
    """
    per_user = summary.groupBy("user_tier", "user_id").agg(
        split_sum("cashback_earned").alias("cashback"), split_sum("staking_earned").alias("staking"))
    totals = per_user.groupBy("user_tier").agg(
        sum_of_splits("cashback").alias("total_cashback"), sum_of_splits("staking").alias("total_staking"),
        F.count("user_id").alias("unique_users"))
    return _rounded(totals, {"total_cashback": 2, "total_staking": 2}).orderBy("user_tier")


def upgrade_eligible_users(summary: DataFrame) -> DataFrame:
    return summary.filter("tier_upgrade_eligible").agg(
        F.countDistinct("user_id").alias("eligible_users"))
