"""Removal of byte strings that already start in an earlier document, by external induced sorting.

Every window of ``window`` bytes has a minimizer: the least hash of the ``gram``-byte
strings in it. Equal windows have equal minimizers, so runs of windows with one minimizer
(segments, with the bytes they cover) can be sorted in separate shards. First all minimizers are
counted: one that a single document has cannot belong to a repeated window. The
others go into a Bloom filter of fixed size, which decides what the second read keeps; false
positives only cost time. Kept segments are stored as stretches of bytes. Equal segments combine
on the map side to one row with their smallest document. Shards of whole minimizers are then
sorted by induction with common-prefix values (``induced``): suffixes that share ``window``
bytes are neighbours, and the smallest document among them owns the window. (A segment
alone under its minimizer has nothing to be sorted with.) A window of a document is removed
if its owner is smaller: that is each window of a segment whose smallest document is another,
and else those that the sorting found.

Scale: memory of a task is bounded by ``shard_bytes`` and by its longest text; a minimizer
with more than ``hot_segments`` distinct segments has these cut into single windows, which
combine to one row each. Segments meet their verdicts in a join that AQE can split. Texts
cross the network once, at the end, to meet their spans.

Defined results: null is empty text. Rows that share an id are one document for "smaller",
each with its own result; a null id comes after all others. Texts shorter than a window lose
nothing. Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import discard, release, stored
from tidefolio.llm.induced import sorted_buckets
from tidefolio.llm.words import BASE, INVERSE, mix, powers, slices, text_bytes

WINDOW, GRAM = 50, 24
FILTER_BITS = 28
SHARD_BYTES = 1 << 20
HOT_SEGMENTS = 200_000
SLICE_BYTES = 2 << 20
LONGEST_RUN = 4096
LAST = (1 << 63) - 1


def minimizers(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each window of a buffer."""
    if len(data) < window:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[:len(data)], out=sums[1:])
    n = len(data) - gram + 1
    least = mix((sums[gram:] - sums[:-gram]) * powers(INVERSE, n)[:n])
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    return least


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, piece: int = 1 << 20):
    """Segments of all texts: minimizer, text, first window in it, number of windows.

    Works in pieces that overlap by a window, so a long text needs no more memory than its bytes.
    """
    keys, texts, starts, sizes = [], [], [], []
    for low in range(0, max(0, len(data) - window + 1), piece):
        high = min(len(data), low + piece + window - 1)
        key = minimizers(data[low:high], window, gram)
        place = np.arange(low, low + len(key))
        text = np.searchsorted(offsets, place, "right") - 1
        fits = place + window <= offsets[text + 1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        new[::LONGEST_RUN] = True
        at = np.flatnonzero(new & fits)
        # a run ends where another begins or where its text has no more windows
        stop = np.minimum(np.append(np.flatnonzero(new), len(key))[np.searchsorted(np.flatnonzero(new), at) + 1],
                          offsets[text[at] + 1] - window + 1 - low)
        keys.append(key[at])
        texts.append(text[at])
        starts.append(place[at] - offsets[text[at]])
        sizes.append(stop - at)
    if not keys:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in (keys, texts, starts, sizes))


def _places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [key & mask, ((key >> np.uint64(64 - bits)) ^ (key >> np.uint64(7))) & mask]


def repeated_windows(bodies: list[bytes], owner: np.ndarray, window: int = WINDOW,
                     memory: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start in a segment of a smaller owner: number of the segment, place in it (ascending)."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1)
    data[ends - 1] = 0
    begin = ends - sizes - 1
    found = []
    for place, shared in sorted_buckets(data, window, memory):
        same = shared >= window
        if not same.any():
            continue
        heads = np.flatnonzero(~same)
        heads = heads if len(heads) and heads[0] == 0 else np.concatenate([[0], heads])
        several = np.diff(np.append(heads, len(place))) > 1
        group = np.repeat(several, np.diff(np.append(heads, len(place))))
        segment = np.searchsorted(ends, place, "right")
        fits = place + window <= ends[segment] - 1
        own = np.where(fits, owner[segment], LAST)
        least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(place))))
        found.append(place[group & fits & (least < own)])
    place = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    segment = np.searchsorted(ends, place, "right")
    return segment, place - begin[segment]


def runs(segment: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places in one segment: segment, first, one past the last."""
    if not len(place):
        return segment, place, place
    new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(place)) - 1
    return segment[at], place[at], place[end] + 1


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS,
                   shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS, key: str = "doc_id",
                   text: str = "text", keep_text: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``, bytes) for every row; starts jobs."""
    spark = documents.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    docs = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(key).alias("_key"),
                            content.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                ids = batch.column(0).to_numpy()
                found, which, _, _ = segments(*text_bytes(batch.column(1)), window, gram)
                order = np.argsort(found)
                found, doc = found[order], ids[which[order]]
                at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                low, high = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (at, at)
                yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(low), pa.array(high)],
                                                 names=["m", "low", "high"])

    shared = stored(docs.select("doc", "text").mapInArrow(count, "m long, low long, high long")
                    .groupBy("m").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                    .filter("low < high").select("m"), "minimizers")
    release(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            place = np.concatenate(_places(found, filter_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))],
                                             names=["w", "b"])

    # at most 2**(filter_bits - 6) rows, whatever the corpus
    table = shared.mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bloom = np.zeros(1 << (filter_bits - 6), np.int64)
    bloom[table.column("w").to_numpy()] = table.column("b").to_numpy()
    del table
    sent = spark.sparkContext.broadcast(bloom)
    release(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for whole in batches:
            for batch in slices(whole, 2, SLICE_BYTES):
                data, offsets = text_bytes(batch.column(2))
                found, which, start, size = segments(data, offsets, window, gram)
                here = np.ones(len(found), bool)
                for place in _places(found, filter_bits):
                    place = place.astype(np.int64)
                    here &= (held[place >> 6] >> (place & 63)) & 1 == 1
                found, which, low, size = found[here], which[here], (offsets[which] + start)[here], size[here]
                high = low + size + window - 1
                # segments of a text whose bytes touch are one stretch
                new = np.ones(len(found), bool)
                new[1:] = (which[1:] != which[:-1]) | (low[1:] > high[:-1])
                at = np.flatnonzero(new)
                edges = np.append(at, len(found))
                first = low[at]
                raw = data.tobytes()
                last = high[edges[1:] - 1] if len(at) else at
                bodies = [raw[x:y] for x, y in zip(first.tolist(), last.tolist())]
                inside = low - first[np.cumsum(new) - 1] if len(found) else low
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x))
                         for x in (found.view(np.int64), inside.astype(np.int32), size.astype(np.int32))]
                owner = pa.array(which[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(first - offsets[which[at]]),
                     pa.array(bodies, pa.binary()), *lists], names=["doc", "mark", "start", "stretch", "ms", "ats", "ns"])

    mark = F.xxhash64("text").alias("mark")  # tells rows of one id apart
    stretches = docs.select("doc", mark, "text").mapInArrow(
        keep, "doc long, mark long, start long, stretch binary, ms array<long>, ats array<int>, ns array<int>")
    stretches = stored(stretches, "stretches")
    rows = stretches.select("doc", "mark", "start", "stretch", F.explode(F.arrays_zip("ms", "ats", "ns")).alias("s")).select(
        F.col("s.ms").alias("m"), "doc", "mark", (F.col("start") + F.col("s.ats")).alias("start"),
        F.substring(F.col("stretch"), F.col("s.ats") + 1, F.col("s.ns") + (window - 1)).alias("body"))

    def distinct(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("m", "body").agg(F.min("doc").alias("first")), "bodies")

    bodies = distinct(rows)
    hot = stored(bodies.groupBy("m").count().filter(F.col("count") > hot_segments).select("m"), "hot")
    if not hot.isEmpty():
        at = F.explode(F.sequence(F.lit(0), F.octet_length("body") - window)).alias("_at")
        single = rows.join(hot, "m").select("doc", "mark", "start", "body", at)
        single = single.select("doc", "mark", (F.col("start") + F.col("_at")).alias("start"),
                               F.substring(F.col("body"), F.col("_at") + 1, F.lit(window)).alias("body"))
        single = single.select(F.xxhash64("body").alias("m"), "doc", "mark", "start", "body")
        rows = rows.join(hot, "m", "left_anti").unionByName(single)
        discard(bodies)
        bodies = distinct(rows)
    release(spark)
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-total // (16 * shard_bytes)))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verdict(m, h, first, spans) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([m, h, first, spans], names=["m", "h", "first", "spans"])

        def settle(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            held = pa.concat_tables(parts).combine_chunks()
            which, low, high = runs(*repeated_windows(held.column("body").to_pylist(), held.column("first").to_numpy(), window))
            edges = np.searchsorted(which, np.arange(held.num_rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)
            columns = [held.column(c).combine_chunks() for c in ("m", "h", "first")]
            yield verdict(*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), lists)

        held, size, left = [], 0, None
        none = pa.array([], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        for batch in itertools.chain(batches, [None]):
            rows = left if batch is None else pa.Table.from_batches([batch])
            if batch is not None and left is not None:
                rows = pa.concat_tables([left, rows])
            if rows is None or not rows.num_rows:
                continue
            m = rows.column("m").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]]))
            if batch is not None:  # the last minimizer may go on in the next batch
                left = rows.slice(int(edges[-2]))
                rows, edges = rows.slice(0, int(edges[-2])), edges[:-1]
                if not rows.num_rows:
                    continue
            several = np.repeat(np.diff(edges) > 1, np.diff(edges))
            alone = rows.filter(pa.array(~several)).combine_chunks()
            for part in alone.to_batches():
                empty = pa.ListArray.from_arrays(pa.array(np.zeros(part.num_rows + 1, np.int32)), none.values)
                yield verdict(part.column("m"), part.column("h"), part.column("first"), empty)
            rows = rows.filter(pa.array(several))
            m = rows.column("m").to_numpy()
            sizes = np.cumsum(pc.binary_length(rows.column("body")).to_numpy() + 1) if len(m) else np.zeros(0, np.int64)
            ends = np.flatnonzero(np.concatenate([m[1:] != m[:-1], [True]])) if len(m) else np.zeros(0, np.int64)
            begin, before = 0, 0
            for end in ends.tolist():
                if size + int(sizes[end]) - before >= shard_bytes:
                    held.append(rows.slice(begin, end + 1 - begin))
                    yield from settle(held)
                    held, size, begin, before = [], 0, end + 1, int(sizes[end])
            if begin < len(m):
                held.append(rows.slice(begin))
                size += int(sizes[-1]) - before
        if held:
            yield from settle(held)

    verdicts = stored(bodies.select("m", "body", "first", F.xxhash64("body").alias("h"))
                      .repartition(shards, "m").sortWithinPartitions("m")
                      .mapInArrow(sort, "m long, h long, first long, spans array<struct<a:long,b:long>>"), "verdicts")
    discard(bodies)
    release(spark)
    # within a minimizer, 64 bits of hash tell the segments apart
    narrow = rows.select("m", F.xxhash64("body").alias("h"), "doc", "mark", "start",
                         (F.octet_length("body") - (window - 1)).cast("long").alias("n"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    ranges = (narrow.join(verdicts, ["m", "h"])
              .withColumn("spans", F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("spans")))
              .filter(F.size("spans") > 0)
              .select("doc", "mark", F.transform("spans", lambda s: F.struct(
                  (F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"] + window - 1).alias("b"))).alias("spans")))
    per_doc = stored(ranges.groupBy("doc", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(stretches, verdicts, shared)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                size, removed, parts, digest, left = [], [], [], [], []
                for value, spans in zip(batch.column(1), batch.column(2)):
                    raw = (value.as_py() or "").encode()
                    gone, kept, last, n = 0, [], 0, 0
                    at = spans.values.flatten() if spans.is_valid else []
                    a, b = (np.asarray(at[0]), np.asarray(at[1])) if len(at) else (np.zeros(0), np.zeros(0))
                    for i in np.argsort(a, kind="stable").tolist():
                        low, high = int(a[i]), int(b[i])
                        if low > last or n == 0:
                            kept.append(raw[last:low])
                            n, gone, last = n + 1, gone + high - low, high
                        elif high > last:
                            gone, last = gone + high - last, high
                    kept.append(raw[last:])
                    rest = b"".join(kept)
                    size.append(len(raw)), removed.append(gone), parts.append(n)
                    digest.append(hashlib.sha256(rest).hexdigest()), left.append(rest if keep_text else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, parts)), pa.array(digest, pa.string()),
                     pa.array(left, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    kind = documents.schema[key].dataType.simpleString()
    out = (docs.withColumn("mark", F.xxhash64("text")).join(per_doc, ["doc", "mark"], "left").select("_key", "text", "spans")
           .mapInArrow(cut, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"))
    return out if keep_text else out.drop("kept_text")
