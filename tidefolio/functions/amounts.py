"""Sums of amounts that do not depend on the order of the rows.

A double sum changes in its last digits with the task that happened to run
first, which flips the roundings at 2, 4 and 8 digits. A decimal sum is exact
but costs about fifteen times as much per row. Here every amount is split into
its nearest whole number, the rest in steps of 1e-8, and what these leave in
steps of 1e-18. All parts are bigints: they are summed in generated code,
combine on the map side and run through windows, and are put together at the
end. What is left of an amount and lies within the error of its double is taken
as noise of the representation, so 1234.56 counts as exactly that.

Amounts are given as SQL: the name of a column, or an expression. A figure is written as text and is then
one call to the JVM, where a plan holds dozens of them; what a plan repeats is bound as a column first.

A split amount is a ``struct<whole:bigint,rest:bigint,fine:bigint>``. Amounts and
their sums may have up to 9.2e18 whole units; the parts below bound a sum to 1.8e9
rows if every row carries the largest possible one, of one sign. Beyond that, and for NaN, an
error is raised, with ANSI mode on or off; nothing wraps. Amounts below 5e-19 count as 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 10 ** 8
FINE_STEPS = 10 ** 18
FINE_IN_STEP = FINE_STEPS // STEPS
SPLIT_FIELDS = ["whole", "rest", "fine"]
LARGEST = "9.2e18"


def _error(message: str, kind: str) -> str:
    return f"CAST(raise_error('{message}') AS {kind})"


def parts(amount: str) -> list[str]:
    """The three parts of an amount, as SQL."""
    x = f"CAST({amount} AS DOUBLE)"
    rest = f"rint(({x} - rint({x})) * {STEPS}D)"
    left = f"({x} - rint({x}) - {rest} / {STEPS}D)"
    whole = (f"CASE WHEN {x} IS NULL THEN NULL WHEN abs(rint({x})) < {LARGEST}D THEN CAST(rint({x}) AS BIGINT) "
             f"ELSE {_error('an amount is NaN or beyond 9.2e18', 'BIGINT')} END")
    fine = (f"CASE WHEN abs({left}) > abs({x}) * {2.0 ** -52!r}D THEN CAST(rint({left} * {FINE_STEPS}D) AS BIGINT) "
            f"WHEN {x} IS NOT NULL THEN 0L END")
    return [whole, f"CAST({rest} AS BIGINT)", fine]


def _split(whole: str, rest: str, fine: str) -> str:
    return f"named_struct('whole', {whole}, 'rest', {rest}, 'fine', {fine})"


def split(whole: str, rest: str, fine: str) -> Column:
    return F.expr(_split(whole, rest, fine))


def split_sum(amount: str) -> Column:
    """Sum of a numeric column as a split amount; NULLs are skipped."""
    return split(*[f"try_sum({part})" for part in parts(amount)])


def sum_of_splits(amount: str, window: str | None = None) -> Column:
    """Sum of split amounts, as an aggregate or over a window, ``PARTITION BY`` and so on."""
    over = "" if window is None else f" OVER ({window})"
    return split(*[f"try_sum({amount}.{part}){over}" for part in SPLIT_FIELDS])


def _steps(whole: str, rest: str, fine: str) -> str:
    """A split amount in steps of 1e-18 as text; NULL without rows, an error where a part overflowed to NULL."""
    total = (f"CAST({whole} AS DECIMAL(19,0)) * {FINE_STEPS}BD + CAST({rest} AS DECIMAL(19,0)) * {FINE_IN_STEP}BD "
             f"+ CAST({fine} AS DECIMAL(19,0))")
    known = f"coalesce(CAST({total} AS STRING), {_error('a sum of amounts is beyond its bounds', 'STRING')})"
    return f"CASE WHEN coalesce({whole}, {rest}, {fine}) IS NOT NULL THEN concat({known}, 'E-18') END"


def _double(whole: str, rest: str, fine: str) -> str:
    fits = f"{fine} = 0 AND abs({rest}) <= {4 * 10 ** 15}L AND abs({whole}) <= {4 * 10 ** 7}L"
    return (f"CASE WHEN {fits} THEN ({whole} * {STEPS}L + {rest}) / {STEPS}D "
            f"ELSE CAST({_steps(whole, rest, fine)} AS DOUBLE) END")


def _fields(amount: str) -> list[str]:
    return [f"{amount}.{part}" for part in SPLIT_FIELDS]


def to_decimal(amount: str) -> Column:
    return F.expr(f"CAST({_steps(*_fields(amount))} AS DECIMAL(38,18))")


def to_double(amount: str, digits: int | None = None) -> Column:
    """The double nearest to a split amount, rounded if ``digits`` are given.

    Below 4e7 with at most 8 decimals all steps fit the 53 bits of a double and one division
    rounds correctly; other amounts are read from their digits, with the same result, which is slow and rare.
    """
    near = _double(*_fields(amount))
    return F.expr(near if digits is None else f"round({near}, {digits})")


def exact_sum(amount: str) -> Column:
    """The double nearest to the exact sum of a numeric column."""
    return F.expr(_double(*[f"try_sum({part})" for part in parts(amount)]))


def exact_sum_over(amount: str, window: str) -> Column:
    """Like :func:`exact_sum`, over a window."""
    return F.expr(_double(*[f"try_sum({part}) OVER ({window})" for part in parts(amount)]))


def with_exact_sum(df: DataFrame, name: str, left: str, right: str, digits: int) -> DataFrame:
    """Add the rounded sum of two amounts of a row."""
    added = [f"try_add({a}, {b})" for a, b in zip(parts(left), parts(right))]
    return df.withColumn("_both", split(*added)).withColumn(name, to_double("_both", digits)).drop("_both")


def exact_add(left: str, right: str) -> Column:
    """The double nearest to the sum of two amounts."""
    return F.expr(_double(*[f"try_add({a}, {b})" for a, b in zip(parts(left), parts(right))]))


def with_sums_over(df: DataFrame, sums: Mapping[str, tuple[str, int, str, str | None]]) -> DataFrame:
    """Add exact window sums of amounts that are rounded to 8 digits or fewer.

    ``sums`` maps a name to the amount's column, the digits of the result, a window, and one whose rows are
    taken off again (or None). A rolling sum is the difference of two running sums, each of which Spark
    carries from row to row, where a sliding frame is added up anew for every row. Parts and sums become columns
    first, so that no expression repeats them.
    """
    columns = list(dict.fromkeys(column for column, *_ in sums.values()))
    bound = df.selectExpr("*", *[f"{part} AS _{kind}{i}" for i, c in enumerate(columns) for kind, part in zip(
        "nwr", (f"CASE WHEN {c} IS NOT NULL THEN 1L END", *parts(c)[:2]))])
    windows = [f"try_sum(_{kind}{columns.index(column)}) OVER ({over}) AS _{kind}{side}{k}"
               for k, (column, _, window, less) in enumerate(sums.values()) for side, over in (("now", window), ("less", less))
               if over is not None for kind in "nwr"]
    summed = bound.selectExpr("*", *windows)

    def left(kind: str, k: int, less: str | None) -> str:
        return f"_{kind}now{k}" if less is None else f"_{kind}now{k} - CASE WHEN _nless{k} IS NULL THEN 0L ELSE _{kind}less{k} END"
    rest = [f"{left(kind, k, less)} AS _{kind}{k}" for k, (*_, less) in enumerate(sums.values()) for kind in "nwr"]
    kept = [f"`{c}`" for c in df.columns if c not in sums]
    figures = [f"CASE WHEN _n{k} > 0 THEN round({_double(f'_w{k}', f'_r{k}', '0L')}, {digits}) END AS `{out}`"
               for k, (out, (_, digits, *_)) in enumerate(sums.items())]
    return summed.selectExpr(*kept, *rest).selectExpr(*kept, *figures)


def _converted(df: DataFrame, convert) -> DataFrame:
    return df.select(*[
        convert(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StructType)
        and f.dataType.fieldNames() == SPLIT_FIELDS else F.col(f"`{f.name}`") for f in df.schema.fields])


def as_doubles(df: DataFrame) -> DataFrame:
    """Every split amount of ``df`` as a double, the type of the interface."""
    return _converted(df, to_double)


def as_decimals(df: DataFrame) -> DataFrame:
    """Every split amount of ``df`` as a ``decimal(38,18)``."""
    return _converted(df, to_decimal)
