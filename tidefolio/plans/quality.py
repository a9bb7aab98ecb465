"""Job: check all tables of a lake and leave a report."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.functions.amounts import exact_sum
from tidefolio.operators import positions, quality, rewards
from tidefolio.plans import portfolio, staging
from tidefolio.plans.lake import Lake
from tidefolio.sources.tables import scan_if_present, why_not
from tidefolio.storage import written

DATED = ("fact_portfolio_daily", "fact_reward_daily", "raw_transactions", "raw_prices", "raw_rewards")


class QualityError(Exception):
    """At least one check failed."""


def reward_measures() -> dict[str, tuple[Column, Column]]:
    """What the reward facts and the raw rewards must agree in."""
    def only(kind: str, column: str) -> Column:
        return F.when(F.col("reward_type") == kind, F.col(column))

    return {
        "cashback_earned": (exact_sum("cashback_earned"), exact_sum("CASE WHEN reward_type = 'cashback' THEN reward_amount END")),
        "cashback_count": (F.sum("cashback_count"), F.count(only("cashback", "reward_id"))),
        "staking_earned": (exact_sum("staking_earned"), exact_sum("CASE WHEN reward_type = 'staking' THEN reward_amount END")),
        "staking_count": (F.sum("staking_count"), F.count(only("staking", "reward_id"))),
    }


def _consistency(tables: dict[str, DataFrame | None]) -> DataFrame | None:
    """Reward facts against raw rewards, as result rows."""
    fact, raw = tables["fact_reward_daily"], tables["raw_rewards"]
    if fact is None or raw is None:
        return None
    found = quality.cross_table(fact, raw, reward_measures(), "fact_reward_daily", "raw_rewards")
    gap = F.concat(F.lit("fact "), F.col("fact_total"), F.lit(", raw "), F.col("raw_total"))
    none = F.lit(None).cast("bigint")
    return found.select("check", "table", "status", none.alias("value"), none.alias("threshold"), gap.alias("details"))


def _derived(spark: SparkSession, lake: Lake, tables: dict[str, DataFrame | None]) -> DataFrame | None:
    """Fingerprints of both fact tables against the same rows derived from the staged events again, as result rows."""
    found = []
    if tables["fact_portfolio_daily"] is not None:
        again = positions.snapshot(staging.rows(spark, lake, "transactions"), written(portfolio.daily_prices(spark, lake), "prices"))
        found.append(quality.same_days(tables["fact_portfolio_daily"], again, "fact_portfolio_daily"))
    if tables["fact_reward_daily"] is not None and tables["dim_user"] is not None:
        again = rewards.summary(staging.rows(spark, lake, "rewards"), staging.rows(spark, lake, "transactions"), tables["dim_user"])
        found.append(quality.same_days(tables["fact_reward_daily"], again, "fact_reward_daily"))
    return reduce(DataFrame.unionByName, found) if found else None


def run(spark: SparkSession, base: str, run_name: str | None = None, as_of: str | None = None,
        max_age_days: int = 1, derive: bool = False, **bounds) -> dict:
    """Write ``checks``, ``summary`` and ``not_loaded`` as JSON; raise if a check failed.

    With ``derive`` both fact tables are derived from the staged events again and compared with what is stored,
    every row and column of every day: as dear as a full run.

    ``as_of`` adds the age of each dated table on that day. Tables that cannot be opened fail
    their checks, and their reasons are in ``not_loaded``. The checks run once: the summary
    reads the rows just written.
    """
    lake = Lake(base)
    folder = lake.report(run_name or f"dq_report_{datetime.now():%Y%m%d_%H%M%S}")
    paths = lake.checked_tables()
    tables = {name: scan_if_present(spark, path) for name, path in paths.items()}
    missing = [(name, why_not(spark, paths[name])) for name, df in tables.items() if df is None]
    spark.createDataFrame(missing, "table string, reason string").write.mode("overwrite").json(f"{folder}/not_loaded")
    results = quality.report(spark, tables, **bounds)
    consistency = _consistency(tables)
    if consistency is not None:
        results = results.unionByName(consistency)
    derived = _derived(spark, lake, tables) if derive else None
    if derived is not None:
        results = results.unionByName(derived)
    if as_of is not None:
        results = results.unionByName(quality.freshness(spark, {t: tables[t] for t in DATED}, as_of, max_age_days))
    results.coalesce(1).write.mode("overwrite").json(f"{folder}/checks")
    stored = spark.read.schema(results.schema).json(f"{folder}/checks")
    totals = quality.summary(stored)
    totals.write.mode("overwrite").json(f"{folder}/summary")
    summary = spark.read.schema(totals.schema).json(f"{folder}/summary").first().asDict()
    if summary["failed"]:
        raise QualityError(f"{summary['failed']} of {summary['total_checks']} checks failed, see {folder}")
    return summary
