"""Packing token sequences by minimum bin slack.

Each document is tokenised whole, ended by ``end_id`` and cut at multiples of
``capacity``; a piece of full length is a sequence of its own. The rests (shorter than
``capacity``) are dealt by a hash into groups of about ``group_rows`` rows. In a group
only the multiset of rest lengths matters: the longest rest left opens a sequence, and a
bitset subset-sum over the other lengths, with counts split into powers of two, finds
the multiset that fills the window closest to ``capacity``. Backtracking gives how many
of each length it takes; the pattern is repeated as often as the counts allow.

Python is used because the tokenizer is a Python library. Only rows of fixed width are
shuffled: ids stay in the task that made them, as their crc32.

Defined results: null or empty text is the one id ``end_id``; repeated rows are packed one
by one; a null id is carried along; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import stored

CAPACITY = 2048
GROUP_ROWS = 20_000

# How byte-level vocabularies of this kind split a text, and a text that shows differences.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 1,234 naïve\tgrüße  here:\n\n  they'll \u00a0 say 日本語 — <|endoftext|> 🙂 x=y_z; "
# The quick library's matcher has room for about 1,000,000 steps back, one for each blank of a run.
LONGEST_RUN = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONGEST_RUN}}}")


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    ``ranks`` may name a file with the tokenizer's vocabulary as ranks: its library gives the same
    ids about four times faster, and is refused if a probe text comes out differently. Texts that
    it cannot take go to the tokenizer itself: those with a run of ``LONGEST_RUN`` blanks, and
    those that hold a token which the tokenizer finds before it splits a text.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        self.ids = self._by_tokenizer
        if ranks is not None:
            import tiktoken
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            quick = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            probe = self.added.sub("", PROBE)
            if quick.encode_ordinary(probe) != self._by_tokenizer(probe):
                raise ValueError("ranks and tokenizer give different ids")
            self.quick, self.ids = quick.encode_ordinary, self._by_ranks

    def _by_tokenizer(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _by_ranks(self, text: str) -> list[int]:
        if len(text) >= LONGEST_RUN and LONG_RUN.search(text):
            return self._by_tokenizer(text)
        return self._by_tokenizer(text) if self.added.search(text) else self.quick(text)

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


def cut(documents: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 1,
        key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens``: every id of a document in one piece of at most ``capacity``."""
    kind = documents.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer, ranks), struct.pack("<I", end_id)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(value.as_py() or "") + end)
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    at.append(i), start.append(s), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part)), total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))]
                + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(key, text).mapInArrow(pieces, schema)


def closest(counts: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is closest to ``room`` from below.

    ``lengths`` are those with a count, longest first. Stops as soon as ``room`` itself is reached.
    """
    reach, goal, steps = 1, 1 << room, []
    full = (goal << 1) - 1
    for length in lengths:
        if length > room:
            continue
        left, part = min(int(counts[length]), room // length), 1
        while left and not reach & goal:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << length * part) & full
            left -= part
            part *= 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return taken


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    place = np.concatenate([[0], np.cumsum(counts)])[:-1]
    bins, offsets, current = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    alive = [int(x) for x in np.flatnonzero(counts)[::-1]]
    while alive:
        seed = alive[0]
        counts[seed] -= 1
        taken = closest(counts, alive, capacity - seed)
        counts[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(int(counts[x]) // n for x, n in taken.items())
        at = 0
        for length, n in taken.items():
            rows = order[place[length]:place[length] + n * times]
            place[length] += n * times
            counts[length] -= n * times
            bins[rows] = current + np.repeat(np.arange(times), n)
            offsets[rows] = at + length * np.tile(np.arange(n), times)
            at += length * n
        current += times
        alive = [x for x in alive if counts[x]]
    return bins, offsets


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY,
         end_id: int = 1, group_rows: int = GROUP_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; starts jobs that write and count the pieces."""
    made = stored(cut(documents, tokenizer, ranks, capacity, end_id, key, text)
                  .withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    columns = [key, "start", "length", "ids_crc32", "doc_tokens"]
    full = made.filter(F.col("length") == capacity).select(
        *columns, (F.col("_piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = made.filter(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_rows))
    kind = made.schema[key].dataType.simpleString()

    def bins(group: pa.Table) -> pa.Table:
        group = group.sort_by("_piece")  # the arrival order of a shuffle may differ in a second attempt
        which, offset = fill(group.column("length").to_numpy(), capacity)
        first = group.column("_group")[0].as_py() << 32
        return group.select(columns).append_column("sequence_id", pa.array((first + which) * 2 + 1)) \
            .append_column("offset", pa.array(offset))

    packed = (rests.withColumn("_group", F.pmod(F.xxhash64("_piece"), F.lit(groups)))
              .groupBy("_group").applyInArrow(
                  bins, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                        "sequence_id long, offset long"))
    return full.unionByName(packed)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the padding ids that fill sequences whose length is no power of two."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pads = F.when(F.expr("bit_count(n) = 1"), 0).otherwise(F.lit(capacity) - F.col("n"))
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pads).alias("padding"))
