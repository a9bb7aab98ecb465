"""Tier of each user from a stream of purchases, falling again as spend ages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.functions import amounts, tiers
from tidefolio.functions.amounts import exact_sum
from tidefolio.operators.serving import latest_view
from tidefolio.streaming.windows import LATENESS, watermarked


def reward_tier(spend: DataFrame, days: int = 30, delay: str = LATENESS,
                ladder: Mapping[str, float] = tiers.LADDER, time: str = "ts") -> DataFrame:
    """Rolling spend and tier per user and day, for each day that is over.

    ``spend`` has user_id, total_value and an event time. Two windowed sums in a
    row: purchases into days, then days into sliding windows. Only the daily
    rows are spread over the windows they count in, and both sums combine on the
    map side, so a user with a third of all purchases is no single busy task.

    The sliding window is one day longer than the frame. On that last day the
    spend no longer counts, but the user still gets a row: this is how a user
    who went quiet falls back without any timer.
    """
    per_day = (
        watermarked(spend, time, delay)
        .groupBy(F.window(time, "1 day"), "user_id")
        .agg(F.round(exact_sum("total_value"), 2).alias("day_spend"))
        .select("user_id", "day_spend", F.col("window.start").alias("day"),
                F.window_time("window").alias("day_time"))
    )
    spread = per_day.withColumn("frame", F.window("day_time", f"{days + 2} days", "1 day"))
    counts = F.col("day") > F.col("frame.start")
    rolling = spread.withColumn("counted", F.when(counts, F.col("day_spend"))) \
        .groupBy("user_id", "frame").agg(exact_sum("counted").alias("spend"))
    amount = F.coalesce("spend", F.lit(0.0))
    return rolling.select(
        "user_id",
        F.to_date(F.col("frame.end") - F.expr("interval 1 day")).alias("date"),
        F.round(amount, 2).alias("rolling_spend"),
    ).withColumn("tier", tiers.suggested_tier(F.col("rolling_spend"), ladder))


PARTS = ("whole", "rest", "fine")
DAY_MS = 86_400_000


def _day_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Purchases of an Arrow batch summed per user and day, so that a hot user reaches the state in few rows."""
    for rows in batches:
        sums = rows.groupby(["user_id", "day"], as_index=False, sort=False, dropna=False).agg(
            {**{p: "sum" for p in PARTS}, "ts": "max"})
        yield sums[rows.columns]


def _follow(days: int, remembered: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, today, version = {}, None, 0
        if state.exists:
            held, *sums, today, version = state.get
            known = dict(zip(held, zip(*sums)))
        if state.hasTimedOut:
            if not known:  # nothing for so long that a new start is on a later date in any case
                state.remove()
                return
            today = state.getCurrentWatermarkMs() // DAY_MS
        else:
            for rows in batches:
                for day, *amount in rows[["day", *PARTS]].itertuples(index=False):
                    old = known.get(int(day), (0, 0, 0))
                    known[int(day)] = tuple(int(a) + int(b) for a, b in zip(old, amount))
            today = max([*known, *([] if today is None else [today])])
        known = {d: a for d, a in known.items() if d >= today - days}
        total = [sum(a[i] for a in known.values()) for i in range(len(PARTS))]
        version += 1
        order = sorted(known)
        state.update((order, *([known[d][i] for d in order] for i in range(len(PARTS))), today, version))
        # the first moment at which the oldest day no longer counts, or at which the mere version may go
        until = (order[0] + days + 1) * DAY_MS if known else (today + days + remembered) * DAY_MS
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "day": [today], **{p: [v] for p, v in zip(PARTS, total)}, "version": [version]})

    return step


def reward_tier_now(spend: DataFrame, days: int = 30, delay: str = LATENESS,
                    ladder: Mapping[str, float] = tiers.LADDER, time: str = "ts", remembered: int = 365) -> DataFrame:
    """Rolling spend and tier of a user today: a row for each micro-batch with purchases, and when spend falls out.

    State is at most ``days + 1`` day sums per user; a timer in event time gives the row of a
    user who went quiet. When nothing counts any more, date and version alone stay for another
    ``remembered`` days, so that a returning user's rows follow the earlier ones. The newest row of a
    user by (date, version) wins, see :func:`current`. Purchases of an Arrow batch are summed
    before the shuffle, unless the stream has a watermark from an operator before, which would be lost there.
    """
    marked = "spark.watermarkDelayMs" in spend.schema[time].metadata
    rows = spend.select("user_id", F.unix_date(F.to_date(time)).alias("day"),
                        *[F.expr(p).alias(n) for p, n in zip(amounts.parts("total_value"), PARTS)],
                        (F.col(time) if marked else F.col(time).cast("timestamp")).alias("ts")).filter(
        F.col("whole").isNotNull() & F.col("ts").isNotNull())
    reduced = rows if marked else rows.mapInPandas(_day_sums, rows.schema).withWatermark("ts", delay)
    user = spend.schema["user_id"].dataType.simpleString()
    sums = ", ".join(f"{p} bigint" for p in PARTS)
    state = "days array<int>, " + ", ".join(f"{p} array<bigint>" for p in PARTS) + ", today int, version bigint"
    out = reduced.groupBy("user_id").applyInPandasWithState(
        _follow(days, remembered), f"user_id {user}, day int, {sums}, version bigint", state, "append", "EventTimeTimeout")
    spent = amounts.to_double(f"named_struct({', '.join(f"'{p}', {p}" for p in PARTS)})", 2)
    return out.select("user_id", F.date_from_unix_date("day").alias("date"), spent.alias("rolling_spend"), "version").withColumn(
        "tier", tiers.suggested_tier(F.col("rolling_spend"), ladder))


def current(log: DataFrame) -> DataFrame:
    """Each user's tier now, from the rows of :func:`reward_tier_now`."""
    return latest_view(log, ["user_id"], ["date", "version"])
