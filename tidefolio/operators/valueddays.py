"""Holdings valued on each day they last, and the sums of these days; what a task does to one Arrow batch.

A batch has a row per holding and stretch of days: its key columns, ``quantity_held``, ``total_cost_basis``, ``_block``,
``_from`` (a day's number) and ``_closes``, the price of each of its days. Every day is valued by itself and counts as the
parts that ``functions.amounts`` splits an amount into, so sums are exact and equal to those of rows per day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidefolio.functions.amounts import FINE_STEPS, LARGEST, STEPS

# Days valued at once: their arrays stay in the processor's cache.
CHUNK_DAYS = 1 << 17
FIGURES = ("quantity_held", "market_value", "unrealized_pnl")
PARTS = ("whole", "rest", "fine")


def parts(amounts: np.ndarray) -> list[np.ndarray]:
    """``functions.amounts.parts`` of an array of doubles, as whole numbers in doubles."""
    whole = np.rint(amounts)
    if len(whole) and not (whole.max() < float(LARGEST) and whole.min() > -float(LARGEST)):
        raise ValueError(f"an amount is NaN or beyond {LARGEST}")
    part = amounts - whole
    rest = part * STEPS
    np.rint(rest, out=rest)
    left = rest / STEPS
    np.subtract(part, left, out=left)
    np.abs(amounts, out=part)
    part *= 2.0 ** -52  # the error of an amount's double
    counts = np.abs(left) > part
    return [whole, rest, np.where(counts, np.rint(left * FINE_STEPS), 0.0) if counts.any() else np.zeros_like(whole)]


def totals(code: np.ndarray, numbers: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Sums of whole numbers in doubles per code, as bigints: in doubles while these are exact, else in two halves.

    ``starts`` says where each code begins if all codes are there, in order.
    """
    largest = max(numbers.max(), -numbers.min()) if len(numbers) else 0
    if largest == 0:
        return np.zeros(size, np.int64)
    if largest * len(numbers) < 2 ** 53:
        return (np.bincount(code, numbers, size) if starts is None else np.add.reduceat(numbers, starts)).astype(np.int64)
    halves = numbers.astype(np.int64)
    high, low = (np.bincount(code, half, size).astype(np.int64) for half in (halves >> 32, halves & 0xFFFFFFFF))
    if (np.abs(high * 2.0 ** 32 + low) > float(LARGEST)).any():
        raise ValueError("a sum of amounts is beyond its bounds")
    return (high << 32) + low


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """A column with 0 for NULL, and what is not NULL (None: everything)."""
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False), None
    return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _both(one: np.ndarray | None, other: np.ndarray | None) -> np.ndarray | None:
    return one if other is None else other if one is None else one & other


class _Sums:
    """Split sums of one figure per code; NULL for codes without a known amount."""

    def __init__(self, size: int):
        self.size, self.parts, self.some = size, [np.zeros(size, np.int64) for _ in PARTS], np.zeros(size, bool)

    def add(self, code: np.ndarray, amounts: list[np.ndarray], at: slice, starts: np.ndarray | None,
            seen: np.ndarray | None) -> None:
        """Add amounts, as parts, to the sums of the codes ``at``; ``seen``: which of these have some (None: not known yet)."""
        size = at.stop - at.start
        for total, numbers in zip(self.parts, amounts):
            more = totals(code, numbers, size, starts)
            before = total[at].copy()
            total[at] += more
            if (((before ^ total[at]) & (more ^ total[at])) < 0).any():
                raise ValueError("a sum of amounts is beyond its bounds")
        self.some[at] |= np.bincount(code, minlength=size) > 0 if seen is None else seen

    def column(self, codes: np.ndarray) -> pa.StructArray:
        none = ~self.some[codes]
        return pa.StructArray.from_arrays([pa.array(s[codes], pa.int64(), mask=none) for s in self.parts], names=list(PARTS))


# Sums per symbol and day that a task holds at once.
MOST_SUMS = 1 << 20


def _valued(batch: pa.RecordBatch, keys: tuple[str, ...], block_days: int | None) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    first, block = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_from", "_block"))
    if block_days is not None:
        symbol = batch.column("symbol").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, group_row, group = np.unique(np.stack([symbol, block]), axis=1, return_index=True, return_inverse=True)
        if len(group_row) * block_days > MOST_SUMS and n > 1:
            for half in (batch.slice(0, n // 2), batch.slice(n // 2)):
                yield from _valued(half, keys, block_days)
            return
        opens = group.ravel() * block_days + first - block * block_days  # the code of a row's first day
    lists = batch.column("_closes")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    close, quoted = _doubles(lists.flatten())
    held, _ = _doubles(batch.column("quantity_held"))
    cost, paid = _doubles(batch.column("total_cost_basis"))
    ends = np.cumsum(lengths)
    size = n if block_days is None else len(group_row) * block_days
    sums, counts = [_Sums(size) for _ in FIGURES], np.zeros(size, np.int64)
    begin = 0
    while begin < n:
        day0 = ends[begin] - lengths[begin]
        end = max(begin + 1, int(np.searchsorted(ends, day0 + CHUNK_DAYS, "right")))
        rows, days, lasting = slice(begin, end), slice(day0, ends[end - 1]), lengths[begin:end]
        starts = ends[rows] - lasting - day0
        if block_days is None:
            code, at = np.repeat(np.arange(end - begin), lasting), rows
        else:
            code, at = np.repeat(opens[rows] - starts, lasting), slice(0, size)
            code += np.arange(len(code))
            starts = None
        more = lasting if block_days is None else np.bincount(code, minlength=size)
        counts[at] += more
        seen = more > 0
        value = np.repeat(held[rows], lasting) * close[days]
        known = None if quoted is None else quoted[days]
        gain = _both(known, None if paid is None else np.repeat(paid[rows], lasting))
        sums[0].add(code, [np.repeat(part, lasting) for part in parts(held[rows])], at, starts, seen)
        for into, amounts, there in ((sums[1], value, known), (sums[2], value - np.repeat(cost[rows], lasting), gain)):
            here, amounts, begins = (code, amounts, starts) if there is None else (code[there], amounts[there], None)
            into.add(here, parts(amounts), at, begins, seen if there is None else None)
        begin = end
    codes = np.flatnonzero(counts)
    if block_days is None:
        row, lo, hi = codes, first[codes], first[codes] + lengths[codes] - 1
    else:
        row = group_row[codes // block_days]
        lo = hi = block[row] * block_days + codes % block_days
    yield pa.RecordBatch.from_arrays(
        [*[batch.column(k).take(pa.array(row)) for k in keys], pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
         pa.array(counts[codes]), *[s.column(codes) for s in sums]],
        names=[*keys, "_first", "_last", "holders", *FIGURES])


def valued_sums(keys: tuple[str, ...], block_days: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: sums per row, or with ``block_days`` per symbol and day, as far as they are next to each other."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _valued(batch, keys, block_days)
    return run
