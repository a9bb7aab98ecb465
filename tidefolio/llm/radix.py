"""Ranks of all rows by a distributed radix sort, least significant digit first.

A row's place is a number, not its position in some task. A pass counts the rows of every
(digit, block of places), sums these counts to the place at which each such group starts,
and moves a row to that start plus the number of rows of its group that stood before it:
a stable counting sort. After the last digit the place is the rank.

Scale: groups are at most ``1 << BLOCK`` rows, however many rows share a digit; there are at most
``1 << DIGIT`` counts a block, and start places need one window over the blocks of each digit. Digits that
all rows share are skipped, so 18 significant bits take three passes. Each pass is a stored
table, from which a lost executor's work is redone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefolio.llm.common import discard, stored

DIGIT, BLOCK = 8, 14
SIGN = -(1 << 63)
_PRECEDING = (Window.unboundedPreceding, -1)


def _digit(key: str, shift: int, bits: int) -> Column:
    """Some bits of a bigint, of which -2**63 counts as the least."""
    return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(SIGN)), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _moved(rows: DataFrame, key: str, shift: int, bits: int, block: int) -> DataFrame:
    at = rows.select("*", _digit(key, shift, bits).alias("_digit"), F.shiftright("_place", block).alias("_block"))
    counts = at.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))  # at most 2**bits rows
    smaller = F.sum("_n").over(Window.orderBy("_digit").rowsBetween(*_PRECEDING))
    bases = digits.select("_digit", F.coalesce(smaller, F.lit(0)).alias("_base"))
    earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(*_PRECEDING))
    starts = counts.select("_digit", "_block", F.coalesce(earlier, F.lit(0)).alias("_earlier")).join(bases, "_digit").select(
        "_digit", "_block", (F.col("_base") + F.col("_earlier")).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_place")) - 1
    return at.withColumn("_local", local).join(starts, ["_block", "_digit"]).select(
        *(c for c in rows.columns if c != "_place"), (F.col("_start") + F.col("_local")).alias("_place"))


def ranked(rows: DataFrame, keys: Sequence[Column], digit_bits: int = DIGIT, block_bits: int = BLOCK) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... ascending by the bigint ``keys``, the first being most significant (jobs).

    Keys must not be null; rows equal in all keys follow each other in any order.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    now = stored(rows.select("*", *(k.cast("bigint").alias(n) for k, n in zip(keys, names)),
                             F.monotonically_increasing_id().alias("_place")), "unsorted")
    spread = now.agg(*(F.bit_or(n).bitwiseXOR(F.bit_and(n)).alias(n) for n in names)).first()
    varying = [(name, shift) for name in reversed(names) for shift in range(0, 64, digit_bits)
               if (spread[name] or 0) >> shift & ((1 << digit_bits) - 1)]
    for name, shift in varying or [(names[-1], 0)]:  # one pass at least: places have gaps before it
        before, now = now, stored(_moved(now, name, shift, digit_bits, block_bits), "sorted")
        discard(before)
    return now.select(*rows.columns, (F.col("_place") + 1).alias("rank"))
