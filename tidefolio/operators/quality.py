"""Data-quality checks as aggregates.

All checks of one table are one aggregate over it: a single scan of just the
columns they name. A result row is (check, table, status, value, threshold,
details); nothing but those rows leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.functions.tiers import TIERS
from tidefolio.operators.keysets import only_in

RESULT = "check string, table string, status string, value bigint, threshold bigint, details string"
PASS, FAIL = "PASS", "FAIL"

# Least number of rows per table.
ROW_FLOORS = {
    "dim_user": 100, "dim_asset": 5, "dim_date": 30, "fact_portfolio_daily": 1000,
    "fact_reward_daily": 500, "raw_transactions": 10000, "raw_prices": 1000, "raw_rewards": 5000,
}
# Columns that must not be NULL.
REQUIRED = {
    "fact_portfolio_daily": ("user_id", "symbol", "date", "quantity_held", "market_value"),
    "fact_reward_daily": ("user_id", "date", "total_reward_value"),
    "dim_user": ("user_id", "tier"),
    "raw_transactions": ("tx_id", "user_id", "symbol", "tx_type", "quantity", "price"),
}


@dataclass(frozen=True)
class Check:
    """A figure of one table and the bound it must keep.

    ``kind`` is ``rows`` (at least ``threshold`` rows), ``nulls`` (of ``columns``)
    or ``violations`` (rows where ``bad`` holds; NULL is no violation).
    """

    name: str
    table: str
    kind: str
    label: str
    columns: tuple[str, ...] = ()
    bad: Column | None = None
    threshold: int = 0

    def figure(self) -> Column:
        if self.kind == "rows":
            return F.count(F.lit(1))
        if self.kind == "nulls":
            return F.count_if(F.col(self.columns[0]).isNull())
        return F.count_if(F.coalesce(self.bad, F.lit(False)))


def row_floors(floors: Mapping[str, int] = ROW_FLOORS) -> list[Check]:
    return [Check(f"row_count_{t}", t, "rows", "Count", threshold=n) for t, n in floors.items()]


def required_columns(required: Mapping[str, Iterable[str]] = REQUIRED) -> list[Check]:
    return [Check(f"null_{t}.{c}", t, "nulls", "Nulls", columns=(c,))
            for t, columns in required.items() for c in columns]


def ranges() -> list[Check]:
    col = F.col
    return [
        Check("range_positive_holdings", "fact_portfolio_daily", "violations",
              "Negative/zero holdings", ("quantity_held",), col("quantity_held") <= 0),
        Check("range_non_negative_market_value", "fact_portfolio_daily", "violations",
              "Negative market values", ("market_value",), col("market_value") < 0),
        Check("range_non_negative_rewards", "fact_reward_daily", "violations",
              "Negative reward values", ("total_reward_value",), col("total_reward_value") < 0),
        Check("range_positive_price_quantity", "raw_transactions", "violations",
              "Invalid price/quantity", ("price", "quantity"),
              (col("price") <= 0) | (col("quantity") <= 0)),
    ]


def allowed_values() -> list[Check]:
    return [
        Check("valid_tx_types", "raw_transactions", "violations", "Invalid tx_type values",
              ("tx_type",), ~F.col("tx_type").isin("buy", "sell")),
        Check("valid_user_tiers", "dim_user", "violations", "Invalid tiers",
              ("tier",), ~F.col("tier").isin(*TIERS)),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _judged(figures: DataFrame) -> DataFrame:
    """Status and details of (check, table, label, value, threshold, floor) rows.

    ``floor`` tells whether the threshold is the least or the greatest good value.
    """
    value, bound = F.col("value"), F.col("threshold")
    good = F.when(F.col("floor"), value >= bound).otherwise(value <= bound)
    text = F.concat(F.col("label"), F.lit(": "), F.format_number(value, 0))
    least = F.concat(F.lit(" (min: "), F.format_number(bound, 0), F.lit(")"))
    return figures.select(
        "check", "table", F.when(good, PASS).otherwise(FAIL).alias("status"), "value", "threshold",
        F.when(F.col("floor"), F.concat(text, least)).otherwise(text).alias("details"))


def _failures(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(
        [(check, table, FAIL, None, None, details) for check, table, details in rows], RESULT)


def _measured(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One aggregate for all ``checks``, one row per check."""
    row = df.agg(*[c.figure().alias(f"v{i}") for i, c in enumerate(checks)])
    figures = F.array(*[
        F.struct(F.lit(c.name).alias("check"), F.lit(c.table).alias("table"),
                 F.lit(c.label).alias("label"), F.col(f"v{i}").alias("value"),
                 F.lit(c.threshold).cast("bigint").alias("threshold"),
                 F.lit(c.kind == "rows").alias("floor"))
        for i, c in enumerate(checks)])
    return _judged(row.select(F.inline(figures)))


def run_checks(spark: SparkSession, tables: Mapping[str, DataFrame | None],
               checks: list[Check]) -> DataFrame:
    """Measure ``checks``. A missing table or column fails instead of raising.

    The null checks of a missing table are one row; its other checks are kept,
    each failing, so that the number of checks does not shrink unseen.
    """
    parts, failed = [], []
    for table in dict.fromkeys(c.table for c in checks):
        df = tables.get(table)
        measurable = []
        for check in (c for c in checks if c.table == table):
            missing = [] if df is None else [c for c in check.columns if c not in df.columns]
            if df is None:
                name = f"null_check_{table}" if check.kind == "nulls" else check.name
                failed.append((name, table, "Table not loaded"))
            elif missing:
                failed.append((check.name, table, f"Column '{missing[0]}' not found"))
            else:
                measurable.append(check)
        if measurable:
            parts.append(_measured(df, measurable))
    if failed:
        parts.append(_failures(spark, list(dict.fromkeys(failed))))
    return _union(parts)


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``fact`` that ``dim`` lacks; NULL counts as a key."""
    return only_in(fact, dim, key)


def integrity(spark: SparkSession, tables: Mapping[str, DataFrame | None], name: str,
              fact: str, dim: str, key: str, label: str) -> DataFrame:
    """Referential integrity of one key as a result row."""
    relation = f"{fact} → {dim}"
    sides = {t: tables.get(t) for t in (fact, dim)}
    if any(df is None for df in sides.values()):
        return _failures(spark, [(name, relation, "Table not loaded")])
    lacking = [t for t, df in sides.items() if key not in df.columns]
    if lacking:
        return _failures(spark, [(name, relation, f"Column '{key}' not found")])
    found = orphans(sides[fact], sides[dim], key).agg(F.count(F.lit(1)).alias("value"))
    return _judged(found.select(
        F.lit(name).alias("check"), F.lit(relation).alias("table"), F.lit(label).alias("label"),
        "value", F.lit(0).cast("bigint").alias("threshold"), F.lit(False).alias("floor")))


def freshness(spark: SparkSession, tables: Mapping[str, DataFrame | None], as_of: str,
              max_age_days: int = 1, column: str = "date") -> DataFrame:
    """Age of each table's last date, in days before ``as_of``; an empty table fails."""
    parts, failed = [], []
    for table, df in tables.items():
        name = f"freshness_{table}"
        if df is None:
            failed.append((name, table, "Table not loaded"))
        elif column not in df.columns:
            failed.append((name, table, f"Column '{column}' not found"))
        else:
            age = F.datediff(F.lit(as_of).cast("date"), F.max(column)).cast("bigint")
            parts.append(_judged(df.agg(age.alias("value")).select(
                F.lit(name).alias("check"), F.lit(table).alias("table"),
                F.lit("Age in days").alias("label"), "value",
                F.lit(max_age_days).cast("bigint").alias("threshold"), F.lit(False).alias("floor"))))
    if failed:
        parts.append(_failures(spark, failed))
    return _union(parts)


def cross_table(fact: DataFrame, raw: DataFrame, measures: Mapping[str, tuple[Column, Column]],
                fact_name: str, raw_name: str, tolerance: float = 0.01) -> DataFrame:
    """Totals of a fact table against the same totals re-derived from raw rows.

    ``measures`` maps a name to its aggregate over the fact and over the raw
    table. Each side is one row; they meet by measure name.
    """
    def totals(df: DataFrame, side: int, column: str) -> DataFrame:
        row = df.agg(*[pair[side].cast("double").alias(m) for m, pair in measures.items()])
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias(column)) for m in measures])
        return row.select(F.inline(pairs))

    both = totals(fact, 0, "fact_total").join(totals(raw, 1, "raw_total"), "measure", "full_outer")
    gap = F.abs(F.coalesce("fact_total", F.lit(0.0)) - F.coalesce("raw_total", F.lit(0.0)))
    return both.select(
        F.concat(F.lit("consistency_"), "measure").alias("check"),
        F.lit(f"{fact_name} → {raw_name}").alias("table"),
        F.when(gap <= tolerance, PASS).otherwise(FAIL).alias("status"),
        "fact_total", "raw_total")


def fingerprints(rows: DataFrame, column: str = "date") -> DataFrame:
    """``column, rows, total, mixed`` of each day: number, sum and exclusive or of the rows' hashes.

    Independent of order and of files; partial aggregates leave one row a day and task. A row that
    changed, is missing or came twice changes the sum; two rows that swapped a value change both.
    """
    names = sorted(rows.columns)
    hashed = rows.select(column, F.xxhash64(*names).alias("_h"), F.xxhash64(F.lit("again"), *names).alias("_g"))
    return hashed.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total"),
                                      F.expr("bit_xor(_g)").alias("mixed"))


def same_days(fact: DataFrame, derived: DataFrame, fact_name: str, column: str = "date") -> DataFrame:
    """Whether a fact table is, day by day, what its inputs give now, as one result row with the differing days."""
    names = sorted(fact.columns)
    one, other = (fingerprints(df.select(*names), column).select(
        F.col(column).alias("_day"), F.struct("rows", "total", "mixed").alias(side)) for df, side in ((fact, "a"), (derived, "b")))
    odd = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("_day").cast("string"))
    both = one.join(other, one["_day"].eqNullSafe(other["_day"]), "full_outer").select(
        F.coalesce(one["_day"], other["_day"]).alias("_day"), "a", "b")
    found = both.agg(F.count(odd).alias("value"), F.array_join(F.slice(F.sort_array(F.collect_list(odd)), 1, 10), ", ").alias("days"))
    return found.select(
        F.lit(f"fingerprint_{fact_name}").alias("check"), F.lit(fact_name).alias("table"),
        F.when(F.col("value") == 0, PASS).otherwise(FAIL).alias("status"), "value", F.lit(0).cast("bigint").alias("threshold"),
        F.when(F.col("value") == 0, "All days as derived").otherwise(
            F.concat(F.lit("Days that differ: "), F.col("value"), F.lit(", first "), F.col("days"))).alias("details"))


def stage(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks, empty for a clean row."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return rows.withColumn("reasons", F.concat_ws(",", *broken))


def clean(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("reasons") == "").drop("reasons")


def quarantine(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("reasons") != "")


def transaction_rules() -> dict[str, Column]:
    col = F.col
    return {
        "missing_key": col("tx_id").isNull() | col("user_id").isNull() | col("symbol").isNull(),
        "missing_tx_type": col("tx_type").isNull(),
        "invalid_tx_type": ~col("tx_type").isin("buy", "sell"),
        "missing_amount": col("quantity").isNull() | col("price").isNull(),
        "non_positive_amount": (col("quantity") <= 0) | (col("price") <= 0),
    }


def report(spark: SparkSession, tables: Mapping[str, DataFrame | None],
           floors: Mapping[str, int] = ROW_FLOORS,
           required: Mapping[str, Iterable[str]] = REQUIRED) -> DataFrame:
    """All checks: row floors, NULLs, ranges, allowed values, referential integrity."""
    checks = row_floors(floors) + required_columns(required) + ranges() + allowed_values()
    keys = [
        ("ref_integrity_portfolio_users", "fact_portfolio_daily", "dim_user", "user_id",
         "Orphan user_ids"),
        ("ref_integrity_portfolio_assets", "fact_portfolio_daily", "dim_asset", "symbol",
         "Orphan symbols"),
    ]
    return _union([run_checks(spark, tables, checks),
                   *[integrity(spark, tables, *key) for key in keys]])


def summary(results: DataFrame) -> DataFrame:
    """Totals and pass rate (percent, 1 digit) as one row."""
    passed = F.count_if(F.col("status") == PASS)
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("total_checks"), passed.alias("passed"), (total - passed).alias("failed"),
        F.round(passed / F.greatest(total, F.lit(1)) * 100, 1).alias("pass_rate"))
