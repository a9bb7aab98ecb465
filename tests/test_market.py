"""Correlation that grows by days."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefolio.operators import layout, market
from tidefolio.storage import new_path


def series(days, symbols="ABCDE", seed=3):
    """Prices with gaps; E is steady."""
    rng, level = random.Random(seed), dict.fromkeys(symbols, 100.0)
    rows = []
    for i in range(days):
        shock = rng.gauss(0, 0.01)
        for k, s in enumerate(symbols):
            level[s] *= 1.01 if s == "E" else 1 + shock * (k - 1) + rng.gauss(0, 0.01)
            if rng.random() < 0.8:
                rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(i), level[s]))
    return rows


def brute(rows):
    returns = {}
    for s in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == s)
        returns[s] = pd.Series({d: b / a - 1 for (_, a), (d, b) in zip(own, own[1:])})
    out = {}
    for a in returns:
        for b in returns:
            both = pd.concat([returns[a], returns[b]], axis=1).dropna() if a < b else pd.DataFrame()
            if len(both):
                out[a, b] = len(both), np.corrcoef(both[0], both[1])[0, 1]
    return out


def got(moments):
    return {(r.symbol_a, r.symbol_b): (r.common_days, r.correlation) for r in market.correlation_of(moments).collect()}


def test_growing_correlation_equals_the_whole_one(spark):
    rows, folder, raw = series(60), new_path(spark, "moments"), new_path(spark, "prices")
    table = lambda given: spark.createDataFrame(given, "symbol string, date date, close double")
    cut = dt.date(2024, 2, 10)
    layout.write_by_date(table([r for r in rows if r[1] < cut]), raw)
    market.grow_moments(spark.read.parquet(raw), folder, blocks=2, days_per_run=10)
    before = layout._days(spark, f"{folder}/moments", None, "run")
    layout.write_by_date(table([r for r in rows if r[1] >= cut]), raw, only_given_dates=True)
    grown = market.grow_moments(spark.read.parquet(raw), folder, str(cut), blocks=2, days_per_run=10)
    after = layout._days(spark, f"{folder}/moments", None, "run")
    first = (cut - dt.date(1970, 1, 1)).days // 10
    assert {r for r in before if after[r] == before[r]} == {r for r in before if int(r) < first} and len(after) > len(before)
    mine, want = got(grown), brute(rows)
    assert mine.keys() == want.keys()
    for pair, (n, r) in want.items():
        assert mine[pair][0] == n
        if "E" not in pair:  # a steady price has no correlation but rounding's
            assert mine[pair][1] == pytest.approx(r, abs=1e-9)
    # a corrected price in an old run, which is computed again with those after it
    changed = [(s, d, c * (1.5 if (s, d) == rows[30][:2] else 1)) for s, d, c in rows]
    layout.write_by_date(table(changed), raw)
    again = got(market.grow_moments(spark.read.parquet(raw), folder, str(rows[30][1]), blocks=2, days_per_run=10))
    for pair, (n, r) in brute(changed).items():
        assert again[pair][0] == n and ("E" in pair or again[pair][1] == pytest.approx(r, abs=1e-9))


def test_strongest_pairs(spark):
    pairs = spark.createDataFrame([("A", "B", 9, 0.9), ("A", "C", 9, -0.95), ("B", "C", 9, 0.1), ("C", "D", 9, None)],
                                  "symbol_a string, symbol_b string, common_days long, correlation double")
    name = lambda df: {(r.symbol_a, r.symbol_b) for r in df.collect()}
    assert name(market.strongest(pairs, bound=0.5)) == {("A", "B"), ("A", "C")}
    assert name(market.strongest(pairs, k=1)) == {("A", "B"), ("A", "C"), ("C", "D")}
    assert name(market.strongest(pairs)) == name(pairs.filter(F.lit(True)))
