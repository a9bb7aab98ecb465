import pytest
from pyspark.sql import functions as F
from tests.conftest import day, rows

from tidefolio.functions import tiers
from tidefolio.operators import accruals, rewards


def earned(spark, *given):
    return spark.createDataFrame(
        [(f"r{i}", u, kind, a, s, d and day(d)) for i, (u, d, kind, a, s) in enumerate(given)],
        "reward_id string, user_id string, reward_type string, reward_amount double, spend_amount double, date date")


def bought(spark, *given):
    return spark.createDataFrame([(u, kind, float(v), d and day(d)) for u, d, kind, v in given],
                                 "user_id string, tx_type string, total_value double, date date")


@pytest.fixture
def golden(spark):
    return (
        earned(spark, ("u1", "2024-01-10", "cashback", 3.0, 100.0), ("u1", "2024-01-10", "staking", 0.123456, 1000.0),
               ("u1", "2024-02-09", "cashback", 1.0, 50.0), ("u1", "2024-02-10", "cashback", 2.0, 80.0)),
        bought(spark, ("u1", "2024-01-10", "buy", 12000), ("u1", "2024-02-09", "buy", 500), ("u1", "2024-02-09", "sell", 9)),
        spark.createDataFrame([("u1", "gold", "DE")], "user_id string, tier string, country string"))


def test_summary_golden(golden):
    got = rows(rewards.summary(*golden), "date")
    columns = ("total_reward_value", "rolling_30d_spend", "rolling_30d_rewards", "suggested_tier", "tier_upgrade_eligible")
    assert [tuple(r[c] for c in columns) for r in got] == [
        (3.1235, 12000.0, 3.1235, "gold", False),
        (1.0, 12500.0, 4.1235, "gold", False),
        (2.0, 0.0, 3.0, "bronze", False)]
    assert (got[0]["cashback_count"], got[0]["staking_count"], got[0]["staked_value"]) == (1, 1, 1000.0)
    assert (got[2]["staking_earned"], got[2]["staking_count"], got[2]["daily_buy_spend"]) == (0.0, 0, 0.0)


def test_spend_can_be_taken_on_the_reward_day(golden):
    got = rows(rewards.summary(*golden, spend_on="reward_day"), "date")
    assert [r["rolling_30d_spend"] for r in got] == [12000.0, 12500.0, 500.0]


def test_lifetime_is_the_sum_of_all_days(golden):
    spend = rewards.lifetime(rewards.daily_buy_spend(golden[1]), "daily_buy_spend", "lifetime_spend")
    assert [r["lifetime_spend"] for r in rows(spend, "date")] == [12500.0, 12500.0]


def test_window_edges_are_inclusive(spark):
    daily = rewards.daily_buy_spend(bought(
        spark, ("u", "2024-01-01", "buy", 1), ("u", "2024-01-31", "buy", 2), ("u", "2024-02-01", "buy", 4)))
    got = rows(rewards.rolling(daily, "daily_buy_spend", "s", days=30), "date")
    assert [r["s"] for r in got] == [1.0, 3.0, 6.0]


def mixed(spark):
    """Days with either, both or neither kind; NULL users and dates among them."""
    r = earned(
        spark, ("a", "2024-01-01", "cashback", 1.0, 10.0), ("a", "2024-01-02", "staking", 0.5, 20.0),
        ("a", "2024-01-02", "cashback", 0.25, 30.0), ("b", "2024-01-03", "staking", None, None),
        (None, "2024-01-01", "cashback", 1.0, 1.0), (None, "2024-01-01", "staking", 2.0, 2.0),
        ("c", None, "cashback", 4.0, 4.0), ("c", None, "staking", 8.0, 8.0), ("d", "2024-01-01", "referral", 9.0, 9.0))
    t = bought(spark, ("a", "2024-01-02", "buy", 100), ("a", "2023-12-31", "buy", 50), (None, "2024-01-01", "buy", 7),
               ("b", "2024-01-02", "buy", 60000), ("c", None, "buy", 5), ("e", "2024-01-01", "buy", 5))
    u = spark.createDataFrame([("a", "silver", "DE"), ("b", "bronze", "FR")], "user_id string, tier string, country string")
    return r, t, u


def test_one_aggregate_equals_the_full_outer_join(spark):
    r, _, _ = mixed(spark)
    joined = rewards.daily_cashback(r).join(rewards.daily_staking(r), ["user_id", "date"], "full_outer")
    measures = [c for c in joined.columns if c not in ("user_id", "date")]
    joined = joined.fillna(0.0, subset=measures)
    got = rewards.daily_rewards(r).select(*joined.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    assert got.count() == 7


def test_stacked_summary_equals_the_joins(spark):
    r, t, u = mixed(spark)
    spend = rewards.rolling(rewards.daily_buy_spend(t), "daily_buy_spend", "rolling_30d_spend")
    joined = rewards.with_user(rewards.with_spend(rewards.daily_rewards(r), spend), u)
    joined = rewards.rolling(joined, "total_reward_value", "rolling_30d_rewards", digits=4)
    columns = [c for c in rewards.SUMMARY_COLUMNS if c != "reward_summary_id"]
    joined = rewards.upgrade(rewards.suggest_tier(joined)).select(*columns)
    got = rewards.summary(r, t, u).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))


def test_tier_order(spark):
    pairs = spark.createDataFrame(
        [("silver", "platinum"), ("gold", "silver"), ("gold", "diamond"), (None, "gold"), ("wood", "gold")],
        "user_tier string, suggested_tier string")
    def flags(order):
        return [r["tier_upgrade_eligible"] for r in rows(rewards.upgrade(pairs, order))]
    assert flags("ordinal") == [True, False, True, False, False]
    assert flags("lexical") == [False, True, False, False, False]


@pytest.mark.parametrize("spend,tier", [
    (0.0, "bronze"), (2499.99, "bronze"), (2500.0, "silver"), (10000.0, "gold"), (25000.0, "platinum"),
    (50000.0, "diamond"), (None, "bronze")])
def test_ladder(spark, spend, tier):
    df = spark.createDataFrame([(spend,)], "s double")
    assert df.select(tiers.suggested_tier(F.col("s"))).first()[0] == tier


def test_by_tier_and_eligible(spark):
    r, t, u = mixed(spark)
    facts = rewards.summary(r, t, u)
    got = {x["user_tier"]: (x["total_cashback"], x["total_staking"], x["unique_users"]) for x in rows(rewards.by_tier(facts))}
    assert got == {None: (5.0, 10.0, 1), "bronze": (0.0, 0.0, 1), "silver": (1.25, 0.5, 1)}
    # b bought on 2024-01-02 only, its reward day is 2024-01-03.
    assert rows(rewards.upgrade_eligible_users(facts)) == [{"eligible_users": 0}]
    late = rewards.summary(r, t, u, spend_on="reward_day")
    assert rows(rewards.upgrade_eligible_users(late)) == [{"eligible_users": 1}]


def test_accruals(spark):
    spend = spark.createDataFrame([("u", 123.45), ("x", 10.0)], "user_id string, spend_amount double")
    users = spark.createDataFrame([("u", "platinum")], "user_id string, tier string")
    got = rows(accruals.accrue_cashback(spend, users), "user_id")
    assert [r["reward_amount"] for r in got] == [6.1725, None]
    stakes = spark.createDataFrame([(1000.0, 0.0730)], "staked_value double, apy double")
    assert accruals.accrue_staking(stakes).first()["reward_amount"] == 0.2


def test_trade_value_falls_back_to_the_base_price(spark):
    trades = spark.createDataFrame([("A", day("2024-01-01"), 3.0), ("A", day("2024-01-02"), 3.0), ("B", day("2024-01-01"), 1.0)],
                                   "symbol string, date date, quantity double")
    prices = spark.createDataFrame([("A", day("2024-01-01"), 33.335)], "symbol string, date date, close double")
    assets = spark.createDataFrame([("A", 10.0)], "symbol string, base_price double")
    got = rows(accruals.value_trades(trades, prices, assets), "symbol", "date")
    assert [(r["price"], r["total_value"], r["fee"]) for r in got] == [(33.335, 100.01, 0.1), (10.0, 30.0, 0.03), (None, None, None)]
