import pytest
from pyspark.sql import functions as F
from tests.conftest import day, rows

from tidefolio.operators import quality

FLOORS = dict.fromkeys(quality.ROW_FLOORS, 1)


def healthy(spark):
    d = day("2024-01-01")
    make = spark.createDataFrame
    return {
        "dim_user": make([("u1", "gold"), ("u2", "bronze")], "user_id string, tier string"),
        "dim_asset": make([("BTC",)], "symbol string"),
        "dim_date": make([(d,)], "date_id date"),
        "fact_portfolio_daily": make([("u1", "BTC", d, 1.0, 0.0)],
                                     "user_id string, symbol string, date date, quantity_held double, market_value double"),
        "fact_reward_daily": make([("u1", d, 0.0)], "user_id string, date date, total_reward_value double"),
        "raw_transactions": make([("t", "u1", "BTC", "buy", 1.0, 5.0), ("t2", "u1", "BTC", "sell", 1.0, 5.0)],
                                 "tx_id string, user_id string, symbol string, tx_type string, quantity double, price double"),
        "raw_prices": make([("BTC", d, 5.0)], "symbol string, date date, close double"),
        "raw_rewards": make([("r",)], "reward_id string"),
    }


def failing(spark, tables, floors=FLOORS):
    return {r["check"] for r in rows(quality.report(spark, tables, floors)) if r["status"] == "FAIL"}


def test_healthy_tables_pass_all_32_checks(spark):
    report = quality.report(spark, healthy(spark), FLOORS)
    assert rows(quality.summary(report)) == [{"total_checks": 32, "passed": 32, "failed": 0, "pass_rate": 100.0}]


def changed(column, value):
    return lambda df: df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


@pytest.mark.parametrize("table,fault,checks", [
    ("raw_transactions", changed("user_id", None), {"null_raw_transactions.user_id"}),
    ("raw_transactions", changed("tx_type", None), {"null_raw_transactions.tx_type"}),
    ("raw_transactions", changed("quantity", 0.0), {"range_positive_price_quantity"}),
    ("raw_transactions", changed("price", -1.0), {"range_positive_price_quantity"}),
    ("raw_transactions", changed("tx_type", "hold"), {"valid_tx_types"}),
    ("dim_user", changed("tier", "wood"), {"valid_user_tiers"}),
    ("dim_user", lambda df: df.filter("user_id <> 'u1'"), {"ref_integrity_portfolio_users"}),
    ("dim_asset", changed("symbol", "ETH"), {"ref_integrity_portfolio_assets"}),
    ("fact_portfolio_daily", changed("quantity_held", 0.0), {"range_positive_holdings"}),
    ("fact_portfolio_daily", changed("market_value", -0.5), {"range_non_negative_market_value"}),
    ("fact_reward_daily", changed("total_reward_value", -0.5), {"range_non_negative_rewards"}),
    ("fact_reward_daily", changed("total_reward_value", None), {"null_fact_reward_daily.total_reward_value"}),
    ("raw_prices", lambda df: df.limit(0), {"row_count_raw_prices"}),
])
def test_one_fault_fails_one_check(spark, table, fault, checks):
    tables = healthy(spark)
    tables[table] = fault(tables[table])
    assert failing(spark, tables) == checks


def test_missing_column_fails_instead_of_raising(spark):
    tables = healthy(spark)
    tables["dim_user"] = tables["dim_user"].drop("tier")
    assert failing(spark, tables) == {"null_dim_user.tier", "valid_user_tiers"}


def test_missing_table_keeps_its_checks(spark):
    tables = healthy(spark) | {"fact_portfolio_daily": None}
    assert failing(spark, tables) == {
        "row_count_fact_portfolio_daily", "null_check_fact_portfolio_daily", "range_positive_holdings",
        "range_non_negative_market_value", "ref_integrity_portfolio_users", "ref_integrity_portfolio_assets"}


def test_details_text(spark):
    df = spark.range(1234).select(F.lit(None).cast("string").alias("tier"))
    checks = quality.row_floors({"dim_user": 2000}) + quality.required_columns({"dim_user": ["tier"]})
    got = {r["check"]: (r["status"], r["details"]) for r in rows(quality.run_checks(spark, {"dim_user": df}, checks))}
    assert got == {"row_count_dim_user": ("FAIL", "Count: 1,234 (min: 2,000)"), "null_dim_user.tier": ("FAIL", "Nulls: 1,234")}


def test_orphans_treat_null_as_a_key(spark):
    fact = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert {r["k"] for r in rows(quality.orphans(fact, spark.createDataFrame([("a",)], "k string"), "k"))} == {"b", None}
    dim = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(quality.orphans(fact, dim, "k")) == []


def test_freshness(spark):
    dated = spark.createDataFrame([(day("2024-01-30"),)], "date date")
    tables = {"new": dated, "old": dated.select(F.date_sub("date", 5).alias("date")), "empty": dated.limit(0), "gone": None}
    got = {r["table"]: (r["status"], r["value"]) for r in rows(quality.freshness(spark, tables, "2024-01-31"))}
    assert got == {"new": ("PASS", 1), "old": ("FAIL", 6), "empty": ("FAIL", None), "gone": ("FAIL", None)}


def test_stage_splits_rows(spark):
    tx = healthy(spark)["raw_transactions"].unionByName(spark.createDataFrame(
        [("t3", None, "BTC", "hold", -1.0, 5.0)], healthy(spark)["raw_transactions"].schema))
    staged = quality.stage(tx, quality.transaction_rules())
    assert quality.clean(staged).count() == 2
    assert [r["reasons"] for r in rows(quality.quarantine(staged))] == ["missing_key,invalid_tx_type,non_positive_amount"]


def test_fingerprints_find_changed_missing_and_swapped_rows(spark):
    given = [("2024-01-0%d" % (1 + i % 4), f"u{i}", float(i), "x" if i % 2 else None) for i in range(40)]
    table = lambda rows: spark.createDataFrame([(day(d), *r) for d, *r in rows], "date date, user_id string, amount double, note string")
    judge = lambda rows: quality.same_days(table(rows).repartition(3), table(given), "fact").first()
    assert judge(given[::-1]).status == "PASS"
    changed = [(*r[:2], r[2] + (0.01 if i == 5 else 0), r[3]) for i, r in enumerate(given)]
    swapped = [(*r[:2], {2: 6.0, 6: 2.0}.get(i, r[2]), r[3]) for i, r in enumerate(given)]
    moved = [("2024-01-04", *r[1:]) if i == 0 else r for i, r in enumerate(given)]
    for rows_, days in ((changed, "2024-01-02"), (given[:7] + given[8:], "2024-01-04"), (swapped, "2024-01-03"), (given + given[:1], "2024-01-01"),
                        (moved, "2024-01-01, 2024-01-04"), ([r for r in given if r[0] != "2024-01-03"], "2024-01-03")):
        row = judge(rows_)
        assert row.status == "FAIL" and row.details.endswith("first " + days) and row.value == len(days.split(","))
