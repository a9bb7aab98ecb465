"""Price series: candlesticks and correlation of returns."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefolio.functions.amounts import exact_sum
from tidefolio.operators import layout
from tidefolio.sources.tables import scan_if_present
from tidefolio.storage import written

TIE_SPAN = "10000000000000000000BD"


def tick_order(ticks: DataFrame, time: str | Column, tie: str) -> Column:
    """One value that orders ticks by time, then by ``tie``.

    For an integer ``tie`` it is a decimal, which a hash aggregate can keep in
    place. A struct, needed for other types, makes Spark sort before grouping.
    """
    if isinstance(ticks.schema[tie].dataType, (T.LongType, T.IntegerType)):
        micros = F.unix_micros(F.col(time) if isinstance(time, str) else time).cast("decimal(19,0)")
        return (micros * F.expr(TIE_SPAN) + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(time, tie)


def candles(ticks: DataFrame, width: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Open, high, low, close and volume per symbol and tumbling window.

    Works on batches and streams. The map side combines first, so ten symbols
    do not mean ten busy tasks.
    """
    ordered = ticks.withColumn("_order", tick_order(ticks, time, tie))
    bars = ordered.groupBy("symbol", F.window(time, width)).agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        exact_sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("num_ticks"))
    return bars.select(
        "symbol",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "open", "high", "low", "close", "volume", "num_ticks")


def daily_returns(prices: DataFrame) -> DataFrame:
    """Close over the symbol's previous close, minus 1."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return (prices.select("symbol", "date", "close", before.alias("_before"))
            .filter(F.col("_before").isNotNull() & (F.col("_before") != 0))
            .select("symbol", "date", (F.col("close") / F.col("_before") - 1).alias("daily_return")))


_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(rows: pd.DataFrame, block: int, dates: pd.Index) -> pd.DataFrame:
    of_block = rows[rows["block"] == block]
    return of_block.pivot(index="date", columns="symbol", values="daily_return").reindex(dates)


def _block_moments(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Moments of every symbol pair of one block pair over one run of dates."""
    left, right = key[0], key[1]
    dates = pd.Index(rows["date"].unique())
    a, b = _matrix(rows, left, dates), _matrix(rows, right, dates)
    seen_a, seen_b = a.notna().to_numpy(dtype=float), b.notna().to_numpy(dtype=float)
    x, y = a.fillna(0.0).to_numpy(dtype=float), b.fillna(0.0).to_numpy(dtype=float)
    sums = {
        "n": seen_a.T @ seen_b, "sx": x.T @ seen_b, "sy": seen_a.T @ y,
        "sxx": (x * x).T @ seen_b, "syy": seen_a.T @ (y * y), "sxy": x.T @ y,
    }
    out = pd.DataFrame({
        "symbol_a": np.repeat(a.columns.to_numpy(), len(b.columns)),
        "symbol_b": np.tile(b.columns.to_numpy(), len(a.columns)),
        **{m: sums[m].ravel() for m in _MOMENTS},
    })
    wanted = out["n"] > 0
    if left == right:
        wanted &= out["symbol_a"] < out["symbol_b"]
    return out[wanted]


SYMBOLS_PER_BLOCK = 500


def _blocks_for(prices: DataFrame) -> int:
    symbols = prices.agg(F.approx_count_distinct("symbol")).first()[0]
    return max(1, -(-symbols // SYMBOLS_PER_BLOCK))


def asset_correlation(prices: DataFrame, blocks: int | None = None, days_per_task: int = 512) -> DataFrame:
    """Pearson correlation of daily returns of every two symbols, on common dates.

    A blocked matrix product: symbols fall into ``blocks``, dates into runs, and
    each (block, block, run) multiplies its two return matrices. What leaves a
    task is one row of moments per pair of symbols, not one per pair and date,
    and a task never sees more than two blocks over one run of dates. Without
    ``blocks`` the symbols are counted first, which starts a job.
    """
    blocks = blocks or _blocks_for(prices)
    block = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    run = F.floor(F.unix_date("date") / days_per_task)
    # about their mean, which leaves the correlation as it is: raw moments of steady prices would cancel
    centred = F.col("daily_return") - F.avg("daily_return").over(Window.partitionBy("symbol"))
    returns = daily_returns(prices).filter(F.col("symbol").isNotNull()).select(
        "symbol", "date", centred.alias("daily_return"), block.alias("block"), run.alias("run"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    moments = returns.groupBy(
        F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), "run",
    ).applyInPandas(
        _block_moments,
        "symbol_a string, symbol_b string, " + ", ".join(f"{m} double" for m in _MOMENTS))
    total = moments.groupBy("symbol_a", "symbol_b").agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    n, sx, sy, sxx, syy, sxy = (F.col(m) for m in _MOMENTS)
    spread = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0)))
    return total.select(
        F.least("symbol_a", "symbol_b").alias("symbol_a"),
        F.greatest("symbol_a", "symbol_b").alias("symbol_b"),
        n.cast("bigint").alias("common_days"),
        F.when(spread > 0, (n * sxy - sx * sy) / spread).alias("correlation"))


_CO = ("n", "mean_a", "mean_b", "dev_aa", "dev_bb", "dev_ab")
DAYS_PER_RUN = 512


def _co_moments(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Count, means and co-deviations of every symbol pair of one block pair over one run of dates."""
    left, right, run = key
    dates = pd.Index(rows["date"].unique())
    a, b = _matrix(rows, left, dates), _matrix(rows, right, dates)
    at_a, at_b = a.mean().to_numpy(dtype=float), b.mean().to_numpy(dtype=float)
    seen_a, seen_b = a.notna().to_numpy(dtype=float), b.notna().to_numpy(dtype=float)
    # about each symbol's mean of the run: raw moments of steady prices would cancel
    x, y = (a - at_a).fillna(0.0).to_numpy(dtype=float), (b - at_b).fillna(0.0).to_numpy(dtype=float)
    n = seen_a.T @ seen_b
    part = np.maximum(n, 1)
    sx, sy = x.T @ seen_b, seen_a.T @ y
    figures = {"n": n, "mean_a": at_a[:, None] + sx / part, "mean_b": at_b[None, :] + sy / part,
               "dev_aa": (x * x).T @ seen_b - sx * sx / part, "dev_bb": seen_a.T @ (y * y) - sy * sy / part, "dev_ab": x.T @ y - sx * sy / part}
    out = pd.DataFrame({"run": run, "symbol_a": np.repeat(a.columns.to_numpy(), len(b.columns)),
                        "symbol_b": np.tile(b.columns.to_numpy(), len(a.columns)), **{m: figures[m].ravel() for m in _CO}})
    turned = out["symbol_a"] > out["symbol_b"]
    swap = {"symbol_a": "symbol_b", "mean_a": "mean_b", "dev_aa": "dev_bb"}
    for one, other in swap.items():
        out.loc[turned, [one, other]] = out.loc[turned, [other, one]].to_numpy()
    return out[(out["n"] > 0) & ((left != right) | ~turned) & (out["symbol_a"] != out["symbol_b"])]


def co_moments(returns: DataFrame, blocks: int, days_per_run: int = DAYS_PER_RUN) -> DataFrame:
    """``run, symbol_a, symbol_b`` and co-moments of daily returns that :func:`correlation_of` merges over runs."""
    spread = returns.filter(F.col("symbol").isNotNull()).select(
        "symbol", "date", "daily_return", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"),
        F.floor(F.unix_date("date") / days_per_run).cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    return spread.groupBy(F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), "run").applyInPandas(
        _co_moments, "run int, symbol_a string, symbol_b string, " + ", ".join(f"{m} double" for m in _CO))


def correlation_of(moments: DataFrame) -> DataFrame:
    """Correlation of each pair from its runs: deviations within runs, and of the runs' means from the mean of all."""
    n, a, b = F.col("n"), F.col("mean_a"), F.col("mean_b")
    pair = ["symbol_a", "symbol_b"]
    means = moments.groupBy(*pair).agg((F.sum(n * a) / F.sum(n)).alias("_a"), (F.sum(n * b) / F.sum(n)).alias("_b"))
    from_a, from_b = a - F.col("_a"), b - F.col("_b")
    total = moments.join(means, pair).groupBy(*pair).agg(
        F.sum(n).cast("bigint").alias("common_days"), F.sum(F.col("dev_ab") + n * from_a * from_b).alias("_ab"),
        F.sum(F.col("dev_aa") + n * from_a * from_a).alias("_aa"), F.sum(F.col("dev_bb") + n * from_b * from_b).alias("_bb"))
    spread = F.sqrt(F.greatest("_aa", F.lit(0.0)) * F.greatest("_bb", F.lit(0.0)))
    return total.select(*pair, "common_days", F.when(spread > 0, F.col("_ab") / spread).alias("correlation"))


def strongest(correlations: DataFrame, k: int | None = None, bound: float | None = None) -> DataFrame:
    """Pairs whose correlation is at least ``bound`` in size, or which are among the ``k`` strongest of either symbol."""
    size = F.abs("correlation")
    if bound is not None:
        correlations = correlations.filter(size >= bound)
    if k is None:
        return correlations
    ends = correlations.withColumn("_end", F.explode(F.array("symbol_a", "symbol_b")))
    order = Window.partitionBy("_end").orderBy(size.desc_nulls_last(), "symbol_a", "symbol_b")
    best = ends.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return best.select(*correlations.columns).distinct()


def grow_moments(prices: DataFrame, folder: str, since: str | None = None, blocks: int | None = None,
                 days_per_run: int = DAYS_PER_RUN) -> DataFrame:
    """Bring stored co-moments up to date from ``since`` on (None: all days); returns all of them.

    Only the runs of dates from that day on are computed: their prices are read, and one row per symbol and earlier
    run, its last price, with which the first return of a run begins. On prices laid out by date other days
    are not opened. ``folder`` must be used with one ``blocks`` and ``days_per_run``.
    """
    spark, paths = prices.sparkSession, {t: f"{folder}/{t}" for t in ("moments", "closes")}
    run = F.floor(F.unix_date("date") / days_per_run).cast("int")
    first, part = None, prices.select("symbol", "date", "close")
    if since is not None:
        first = (date.fromisoformat(since) - date(1970, 1, 1)).days // days_per_run
        start = F.date_from_unix_date(F.lit(first * days_per_run))
        known = scan_if_present(spark, paths["closes"])
        part = part.filter(F.col("date") >= start)
        if known is not None:
            part = part.unionByName(known.filter(F.col("run") < first).select(*part.columns))
    part = written(part, "prices")
    blocks = blocks or _blocks_for(part)
    returns, own = daily_returns(part), part.withColumn("run", run)
    if first is not None:
        returns, own = returns.filter(F.col("date") >= start), own.filter(F.col("run") >= first)
    closes = own.groupBy("symbol", "run").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    for name, rows in (("closes", closes), ("moments", co_moments(returns, blocks, days_per_run))):
        rows = written(rows, name)
        runs = None if first is None else sorted({*[r for r in layout.stored_days(spark, paths[name], "run") if int(r) >= first],
                                                  *[str(r.run) for r in rows.select("run").distinct().collect()]})
        layout.replace_days(rows, paths[name], runs, "run")
    return spark.read.parquet(paths["moments"])
