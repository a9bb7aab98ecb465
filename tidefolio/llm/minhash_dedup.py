"""Near-duplicate texts by BagMinHash over word shingles, banded and verified as multisets.

A document is the bag of its five-word shingles. The weight axis of a shingle is cut into
the dyadic intervals [0,1), [1,2), [2,4), [4,8), ...; each carries a Poisson process
whose rate is its length, seeded by shingle and interval alone. A point has a time, one of ``SIZE``
components and a weight level inside its interval, drawn by further halving; it
counts for documents that hold the shingle more often than that level. A component keeps
the earliest time, so two documents agree in it with probability exactly their weighted
Jaccard similarity. Points come in order of time and stop once they are later than every
component's value, so heavy bags cost little more than their distinct shingles.

32 bands of 4 components miss a pair at similarity 0.8 with probability 5e-8. Documents of one
text are one class. In a bucket everyone is compared with its smallest document. Buckets that
then still span several components are compared tile by tile: first signatures alone say
which members have a partner in another component that agrees as pairs at the threshold do
(5 standard deviations below, the miss being under 1e-6), then these meet again with their
bags, and every such pair is verified inside the tile, which sends one row per linked member. All links
are verified on the bags themselves; no group is emitted as pairs.

Defined results: null counts as empty text; texts without words are near-duplicates of
equal texts only; 1 to 4 words are one shingle. Rows with a null id belong to no class
(class null, kept). Rows that share an id are judged by their own texts, each in the class of its text,
whose id is the smallest of its rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import discard, release, stored
from tidefolio.llm.components import components, local_heads
from tidefolio.llm.words import mix, shingle_hashes, slices, text_bytes, word_hashes

SIZE, ROWS = 128, 4
SHINGLE, SIMILARITY = 5, 0.8
TILE_BYTES = 32 << 20  # text of one side of a tile


def bags(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts and their text's number."""
    words, bounds = word_hashes(*text_bytes(texts))
    shingles, text = shingle_hashes(words, bounds, size)
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return shingles[at], np.diff(np.append(at, len(shingles))), text[at]


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(shingles: np.ndarray, counts: np.ndarray, text: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """texts x size earliest times; infinity for texts without shingles."""
    levels = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)  # intervals that begin below the count
    who = np.repeat(np.arange(len(counts)), levels)
    level = np.arange(len(who)) - (np.cumsum(levels) - levels)[who]
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    rate = np.maximum(low, 1.0)
    seed = mix(shingles[who] + np.uint64(0x632BE59BD9B4E019) * (level + 1).astype(np.uint64))
    owner, weight = text[who], counts[who].astype(np.float64)
    total = np.bincount(text, counts, minlength=texts)
    # no point later than this is looked at, until it shows that a component got none
    limit = size * (np.log(size) + 3) / np.maximum(total, 1)
    best = np.full(texts * size, np.inf)
    turn, time = np.zeros(len(who), np.uint64), np.zeros(len(who))

    def move(rows: np.ndarray) -> None:
        turn[rows] += np.uint64(1)
        time[rows] -= np.log(uniform(mix(seed[rows] + turn[rows] * np.uint64(0xD1B54A32D192ED03)))) / rate[rows]

    move(np.arange(len(who)))
    while True:
        alive = np.flatnonzero(time <= limit[owner])
        while len(alive):
            at = mix(mix(seed[alive] ^ np.uint64(0xA0761D6478BD642F)) + turn[alive] * np.uint64(0x8EBC6AF09C88C6E3))
            inside = low[alive] + np.floor(uniform(mix(at)) * rate[alive]) < weight[alive]
            hit = alive[inside]
            np.minimum.at(best, owner[hit] * size + (at[inside] % np.uint64(size)).astype(np.int64), time[hit])
            worst = best.reshape(texts, size).max(1)
            limit = np.where(np.isfinite(worst), np.minimum(limit, worst), limit)
            move(alive)
            alive = alive[time[alive] <= limit[owner[alive]]]
        open_texts = (total > 0) & ~np.isfinite(best.reshape(texts, size).max(1))
        if not open_texts.any():
            return best.reshape(texts, size)
        limit = np.where(open_texts, 2 * limit, 0)


def rounded(times: np.ndarray) -> np.ndarray:
    """Bits of the times in single precision: machines may differ in the last bit of a logarithm."""
    return times.astype(np.float32).view(np.uint32).astype(np.uint64)


def bands(times: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` components, with the band's number in it."""
    bits = rounded(times)
    out = np.tile(np.arange(1, times.shape[1] // rows + 1, dtype=np.uint64), (len(times), 1))
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, k::rows])
    return out.view(np.int64)


def short(times: np.ndarray) -> np.ndarray:
    """One byte of each component, for estimates."""
    return (mix(rounded(times)) & np.uint64(255)).astype(np.uint8)


def estimate_floor(similarity: float, size: int = SIZE) -> int:
    """Agreeing components that a pair at ``similarity`` reaches but for five standard deviations."""
    return max(1, int(size * (similarity - 5 * np.sqrt(similarity * (1 - similarity) / size))))


def bag(text: str, size: int = SHINGLE) -> Counter:
    words = ascii_words(text)
    if 0 < len(words) < size:
        return Counter([tuple(words)])
    return Counter(zip(*(words[k:] for k in range(size))))


def ascii_words(text: str) -> list[str]:
    """Words as the hashes see them: split at ASCII white space only."""
    return [w for w in text.translate(_BLANKS).split(" ") if w]


_BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / max(1, a.total() + b.total() - both)


class Bags:
    """The bags of the texts seen last, as sorted elements; at most ``most`` of them in all, beside one text."""

    def __init__(self, size: int, most: int = 8_000_000):
        self.size, self.most, self.held, self.known = size, most, 0, OrderedDict()

    def of(self, key: int, text: str) -> np.ndarray:
        if key in self.known:
            self.known.move_to_end(key)
        else:
            self.known[key] = np.sort(elements(pa.array([text], pa.large_string()), self.size)[0])
            self.held += len(self.known[key])
            while self.held > self.most and len(self.known) > 1:
                self.held -= len(self.known.popitem(last=False)[1])
        return self.known[key]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given as elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def elements(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each bag as a set: the k-th occurrence of a shingle is an element of its own."""
    shingles, counts, text = bags(texts, size)
    who = np.repeat(np.arange(len(counts)), counts)
    turn = np.arange(len(who)) - (np.cumsum(counts) - counts)[who]
    found = mix(shingles[who] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.split(found, np.cumsum(np.bincount(text, counts, minlength=len(texts)).astype(np.int64))[:-1])


def linked_rows(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, near: np.ndarray,
                similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs left x right marked in ``near`` those whose sets are similar enough, as two arrays of rows."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    across = np.concatenate([codes[begin[r]:begin[r + 1]] for r in right]) if len(right) else codes[:0]
    starts = np.cumsum(sizes[right]) - sizes[right]
    mark, found_a, found_b = np.zeros(len(codes) + 1, np.int64), [], []
    for i, row in enumerate(left):
        if not near[i].any():
            continue
        own = codes[begin[row]:begin[row + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[across], starts)
        mark[own] = 0
        hits = right[near[i] & (both >= similarity * (sizes[row] + sizes[right] - both))]
        found_a.append(np.full(len(hits), row))
        found_b.append(hits)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _matrix(column, size: int = SIZE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                    tile_rows: int = 1000, group_rows: int = 20_000, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``key, text_id, class_id, class_size, kept, text_sha256`` for every row; starts jobs.

    ``text_id`` is the smallest id with an equal text, ``class_id`` the smallest id linked
    over any number of near-duplicates, ``class_size`` the rows of the class.
    """
    spark, content = documents.sparkSession, F.coalesce(F.col(text), F.lit(""))
    docs = documents.select(F.col(key).cast("long").alias("id"), content.alias("text"))
    floor = estimate_floor(similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                times = signatures(*bags(batch.column(2), shingle), batch.num_rows)
                words = np.isfinite(times).all(1)
                buckets = bands(times)
                lists = pa.array([list(b) if w else [] for b, w in zip(buckets.tolist(), words)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), lists, pa.array([r.tobytes() for r in short(times)], pa.binary()),
                     pc.cast(pc.binary_length(batch.column(2)), pa.int64())],
                    names=["id", "sha", "bands", "sig", "n_bytes"])

    signed = stored(docs.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
                    .mapInArrow(sign, "id long, sha string, bands array<long>, sig binary, n_bytes long"), "signed")
    # from here on the node of a text, not its id: two texts may share one
    reps = stored(signed.groupBy("sha").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "reps")
    chosen = stored(signed.join(reps, (signed["sha"] == reps["sha"]) & (signed["id"] == reps["rep"])).select(
        F.col("node").alias("id"), reps["sha"], "rep", "bands", "sig", "n_bytes").dropDuplicates(["id"]), "chosen")

    keys = chosen.select("id", F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1")
    members = stored(keys.join(buckets, "bucket"), "members")
    first = stored(members.filter("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(),
                   "pivots")
    concerned = members.select("id").distinct()
    wanted = chosen.join(concerned, "id").select("id", "sha", "rep")
    texts = stored(docs.select(F.col("id").alias("rep"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
                   .join(wanted, ["rep", "sha"]).select("id", "text").dropDuplicates(["id"]), "texts")
    sigs = stored(chosen.join(concerned, "id").select("id", "sig"), "sigs")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= floor))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bags(shingle)
        for batch in batches:
            linked = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                linked.append(likeness(known.of(a.as_py(), x.as_py()), known.of(b.as_py(), y.as_py())) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        one = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
        two = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = stored(both(pairs, sigs, "sig").mapInArrow(similar, "a long, b long"), "likely")
        return stored(both(likely, texts, "text").mapInArrow(verified, "a long, b long"), "near")

    release(spark)
    links = links_of(first)
    release(spark)

    # buckets that still span components: rows of different components meet tile by tile
    part = components(links)
    labelled = members.join(part, members["id"] == part["node"], "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("part")).join(chosen.select("id", "n_bytes"), "id")
    labelled = stored(labelled, "labelled")
    mixed = (labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"),
                                            F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).filter("low < high AND n > 2")
             .select("bucket", F.ceil(F.greatest(F.col("n") / tile_rows, F.col("bytes") / TILE_BYTES)).cast("int").alias("k")))
    mixed = stored(mixed, "mixed")
    labelled = labelled.select("bucket", "id", "part")
    steps = F.sequence(F.lit(0), F.col("k") - 1)
    pair = F.transform(steps, lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))

    def in_tiles(rows: DataFrame, held: DataFrame, work, schema: str, at_once: int, texts_held: bool = False) -> DataFrame:
        """``work`` on rows (bucket, i, j, chunk, id, part, ...) of many tiles at a time, each tile whole.

        What ``held`` has of each id is joined to the rows that are already in their tiles. Groups of tiles
        are cut by rows and, where whole texts are held, by bytes.
        """
        rows = rows.join(mixed, "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        sizes = rows.join(chosen.select("id", "n_bytes"), "id") if texts_held else rows.withColumn("n_bytes", F.lit(0))
        n, size = sizes.agg(F.sum("k"), F.sum(F.col("k") * F.col("n_bytes"))).first()
        groups = max(1, -(-int(n or 0) // at_once), -(-int(size or 0) // (4 * TILE_BYTES)))
        rows = rows.withColumn("tile", F.explode(pair)).select("bucket", "id", "part", "chunk", "tile.*").join(held, "id")
        return rows.groupBy(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)).alias("g")).applyInArrow(work, schema)

    def tiles(group: pa.Table):
        """The rows of each tile's two sides, and which pairs have different components and similar signatures."""
        group = group.sort_by([(c, "ascending") for c in ("bucket", "i", "j", "id")])
        bucket, i, j, chunk, part_ = (group.column(c).to_numpy() for c in ("bucket", "i", "j", "chunk", "part"))
        sig = _matrix(group.column("sig"))
        new = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        edges = np.flatnonzero(np.concatenate([[True], new, [True]]))

        def each():
            for low, high in zip(edges, edges[1:]):
                rows = np.arange(low, high)
                left, right = rows[chunk[rows] == i[low]], rows[chunk[rows] == j[low]]
                for at in range(0, len(left), 64):
                    strip = left[at:at + 64]
                    near = part_[strip][:, None] != part_[right][None, :]
                    if near.any():
                        near &= (sig[strip][:, None, :] == sig[right][None, :, :]).sum(2) >= floor
                        yield strip, right, near
        return group, each()

    def partnered(group: pa.Table) -> pa.Table:
        group, each = tiles(group)
        has = np.zeros(group.num_rows, bool)
        for left, right, near in each:
            has[left[near.any(1)]] = True
            has[right[near.any(0)]] = True
        return group.select(["bucket", "id", "part"]).filter(pa.array(has))

    def verify(group: pa.Table) -> pa.Table:
        group, each = tiles(group)
        ids = group.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("bag").to_pylist()]
        found = []
        for left, right, near in each:
            rows, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            a, b = linked_rows([sets[r] for r in rows], place[:len(left)], place[len(left):], near, similarity)
            found.append((rows[a], rows[b]))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        # rows of one document are one node: let them share their smallest row
        _, first, same = np.unique(ids, return_index=True, return_inverse=True)
        head = local_heads(ids, np.concatenate([a, first[same]]), np.concatenate([b, np.arange(len(ids))]))
        met = np.flatnonzero(head != ids)
        return pa.table({"a": ids[met], "b": head[met]})

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                held = pa.array([s.tobytes() for s in elements(batch.column(1), shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["id", "bag"])

    paired = stored(in_tiles(labelled, sigs, partnered, "bucket long, id long, part long", group_rows).distinct(), "partnered")
    release(spark)
    held = texts.join(paired.select("id").distinct(), "id").select("id", "text").mapInArrow(bagged, "id long, bag binary")
    held = stored(held.join(sigs, "id"), "bags")
    more = stored(in_tiles(paired, held, verify, "a long, b long", group_rows // 8, True).distinct(), "across")
    discard(texts, sigs, held, labelled, members)
    release(spark)
    links = links.unionByName(more)

    whole = components(links)
    placed = reps.join(whole, "node", "left").select("sha", "rep", F.coalesce("component", "node").alias("component"))
    heads = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = stored(placed.join(heads, "component").select("sha", F.col("rep").alias("text_id"), "component", "class_id"), "classes")
    rows = stored(signed.select("id", "sha").join(named, "sha"), "classed")
    classed = rows.filter("id IS NOT NULL")
    sizes = classed.groupBy("component").agg(F.count("*").alias("class_size"))
    out = classed.join(sizes, "component").select(
        F.col("id").alias(key), "text_id", "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
    none = F.lit(None).cast("long")
    return out.unionByName(rows.filter("id IS NULL").select(
        F.col("id").alias(key), none.alias("text_id"), none.alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))
