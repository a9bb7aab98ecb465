"""Difference of key sets, and the last row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def only_in(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks; NULL is a key like any other.

    One aggregate over both sides. As an anti join of distinct keys, Catalyst
    moves the join below the distinct and shuffles every row of ``left``, a hot
    key in one task; here the map side reduces each key to one row first.
    """
    sides = left.select(*columns, F.lit(False).alias("_known")).unionByName(
        right.select(*columns, F.lit(True).alias("_known")))
    known = sides.groupBy(*columns).agg(F.bool_or("_known").alias("_known"))
    return known.filter(~F.col("_known")).select(*columns)


# Types that a hash aggregate can keep in place; others make Spark sort every row before it groups.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _in_place(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(isinstance(f.dataType, FIXED_WIDTH) for f in kind)
    return isinstance(kind, FIXED_WIDTH)


def last_of_each(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Each key's row with the largest ``order``, a value of fixed width; NULL is a key like any other.

    Hash aggregates only. Columns of fixed width (and structs of such) are carried
    through the aggregate. If there are others, as texts, the aggregate finds the
    largest order of each key and the rows are joined back to it; of rows of a key
    that are equal in ``order`` the one with the least hash stays.
    """
    others = [f for f in rows.schema.fields if f.name not in keys]
    if all(_in_place(f.dataType) for f in others):
        figures = []
        for f in others:
            inner = [f"{f.name}.{x}" for x in f.dataType.fieldNames()] if isinstance(f.dataType, T.StructType) else [f.name]
            figures += [F.max_by(c, "_order").alias(c.replace(".", "__")) for c in inner]
        last = rows.withColumn("_order", order).groupBy(*keys).agg(*figures)
        back = [F.struct(*[F.col(f"{f.name}__{x}").alias(x) for x in f.dataType.fieldNames()]).alias(f.name)
                if isinstance(f.dataType, T.StructType) else F.col(f.name) for f in others]
        return last.select(*keys, *back).select(*rows.columns)
    ordered = rows.withColumn("_order", order)
    top = ordered.groupBy(*keys).agg(F.max("_order").alias("_top"))
    same = (F.col("r._order") == F.col("t._top"))
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    last = ordered.alias("r").join(top.alias("t"), same).select(*[F.col(f"r.{c}") for c in rows.columns])
    ties = Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns))
    return last.withColumn("_tie", F.row_number().over(ties)).filter("_tie = 1").drop("_tie")
