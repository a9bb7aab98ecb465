"""Job: daily reward summary, in full or from a day on."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidefolio.operators import layout, rewards
from tidefolio.plans import staging
from tidefolio.plans.lake import Lake, span
from tidefolio.sources.tables import scan
from tidefolio.storage import written


def run(spark: SparkSession, base: str, days: int = 30, since: str | None = None) -> dict:
    """Write ``fact_reward_daily``; returns row count and date range.

    With ``since`` only days from then on are replaced, those without rewards any more are
    removed, and only the staged days that their rolling sums reach back to are read: both
    tables are staged first, each from the raw days that changed (``staging.refresh``).
    """
    lake = Lake(base)
    for table in staging.TABLES:
        staging.refresh(spark, lake, table)
    reach = None if since is None else str(date.fromisoformat(since) - timedelta(days=days))
    earned, trades = (staging.rows(spark, lake, table, reach) for table in ("rewards", "transactions"))
    facts = rewards.summary(earned, trades, scan(spark, lake.warehouse("dim_user")), days)
    if since is not None:
        facts = facts.filter(F.col("date") >= F.lit(since).cast("date"))
    facts = written(facts, "facts")
    layout.replace_since(facts, lake.warehouse("fact_reward_daily"), since)
    return span(facts)
