import functools
from decimal import Context, Decimal

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import settings as set_to
from tidefolio.functions.amounts import exact_add, exact_sum, exact_sum_over, split_sum, sum_of_splits, to_decimal, to_double

AMOUNTS = st.lists(
    st.one_of(st.none(), st.decimals(-10 ** 7, 10 ** 7, places=8, allow_nan=False)), min_size=1, max_size=40)


@given(AMOUNTS)
@settings(max_examples=15, deadline=None)
def test_sum_is_the_decimal_sum(spark, amounts):
    df = spark.createDataFrame([(None if a is None else float(a),) for a in amounts], "x double").repartition(3)
    got, near = df.agg(split_sum("x").alias("s"), exact_sum("x").alias("d")).select(to_decimal("s"), "d").first()
    # 8 decimals below 1e7 have 15 digits: the double stands for exactly this decimal.
    known = [a for a in amounts if a is not None]
    assert got == (sum(known, Decimal(0)) if known else None)
    assert near == (float(got) if known else None)


def test_sum_of_cents_does_not_drift(spark):
    df = spark.range(100_000).select(F.lit(0.1).alias("x"))
    assert df.agg(exact_sum("x")).first()[0] == 10000.0


def test_large_amounts_do_not_overflow(spark):
    df = spark.createDataFrame([(1e15,), (2e15,), (0.25,)], "x double")
    assert df.agg(exact_sum("x")).first()[0] == 3000000000000000.25


def test_addition_is_exact_before_rounding(spark):
    df = spark.createDataFrame([(3.0, 0.12345), (0.1, 0.2), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(exact_add("a", "b")).collect()]
    assert got == [3.12345, 0.3, None]


WIDE = st.lists(st.builds(lambda digits, power: Decimal(digits).scaleb(power), st.integers(-999_999, 999_999),
                          st.integers(-18, 12)), min_size=1, max_size=30)


@pytest.mark.parametrize("ansi", ["true", "false"])
@given(amounts=WIDE)
@settings(max_examples=8, deadline=None, phases=[Phase.generate])
def test_sums_from_1e18_down_to_1e_18(spark, ansi, amounts):
    with set_to(spark, **{"spark.sql.ansi.enabled": ansi}):
        df = spark.createDataFrame([(float(a),) for a in amounts], "x double").repartition(3)
        total, near = df.agg(split_sum("x").alias("s")).select(to_decimal("s"), to_double("s")).first()
        want = functools.reduce(Context(prec=60).add, amounts)
        assert total == want and near == float(want)
        again = df.groupBy(F.spark_partition_id()).agg(split_sum("x").alias("s")).agg(sum_of_splits("s").alias("s"))
        assert again.select(to_decimal("s")).first()[0] == total
        assert df.select(exact_sum_over("x", "").alias("w")).first()[0] == near


def test_tiny_amounts_are_not_lost(spark):
    df = spark.range(1_000_000).select(F.lit(4e-9).alias("x"), F.lit(1e-18).alias("wei"))
    assert tuple(df.agg(exact_sum("x"), exact_sum("wei")).first()) == (0.004, 1e-12)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("values", [[1e19], [float("nan")], [9e18, 9e18], [-9e18] * 3])
def test_beyond_the_bounds_is_an_error_in_any_mode(spark, ansi, values):
    with set_to(spark, **{"spark.sql.ansi.enabled": ansi}):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        with pytest.raises(Exception, match="beyond"):
            df.agg(exact_sum("x")).collect()


def test_both_ways_to_a_double_agree_around_their_borders(spark):
    rows = [(w + d, r, f) for w in (4 * 10 ** 6, 4 * 10 ** 7, -4 * 10 ** 6, -4 * 10 ** 7) for d in range(-2, 3)
            for r in (0, 5, 123_456_789, 999_999_990, -400_000_010) for f in (0, 1)]
    df = spark.createDataFrame(rows, "whole long, rest long, fine long").select(F.struct("whole", "rest", "fine").alias("s"))
    for near, exact in df.select(to_double("s"), to_decimal("s")).collect():
        assert near == float(exact)
