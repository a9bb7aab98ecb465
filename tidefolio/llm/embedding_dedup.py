"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and cut into blocks of
dimensions. Cosine >= t means squared distance <= 2 - 2t, so at least one block holds at
most its proportional share of it. In each block a grid over its first ``grid``
coordinates, as wide as the block's radius, brings the vectors in range together:
everyone is at home in one cell and visits half of the cells around it. In a cell the
blocks' distances name the candidates, and the cosine of the vectors as given, in double
precision, decides. A pair is counted in the first block that names it, so the blocks'
candidates are united without emitting pairs.

Rotated coordinates are rounded to integers once: their squared distances are exact in
any order of summation, so all tasks agree on which block names a pair first. The
rounding error is added to the radius; no link is lost.

Scale: equal vectors are one row with a count. A cell above ``tile_rows`` rows is cut into
tiles of chunk against chunk, so a hot cell spreads over tasks; a task sends one row per
vector (links, smallest member of its local component), never pairs.

Defined results: a null label, a null, empty or zero vector, or one with null or
non-finite components links with nothing, and so does a null id (component null, kept).
Vectors of different length do not link. Each repeated row is a vector of its own. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefolio.llm.common import stored
from tidefolio.llm.components import components, local_heads

UNIT = 1 << 14
CELL_BASE = 1 << 12


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """The same orthogonal matrix for everyone, rounded so that it does not depend on the machine's QR."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return np.round(q * np.sign(np.diag(r)), 12)


def block_edges(dims: int, blocks: int) -> list[int]:
    blocks = max(1, min(blocks, dims))
    return [dims * i // blocks for i in range(blocks + 1)]


def radii(dims: int, edges: list[int], threshold: float) -> list[int]:
    """Whole-number radius of each block in rotated, rounded coordinates."""
    total = max(0.0, 2 - 2 * threshold) + 1e-9
    return [int(np.ceil(UNIT * np.sqrt(total * (b - a) / dims) + np.sqrt(b - a))) + 1
            for a, b in zip(edges, edges[1:])]


def half_of_neighbours(n: int) -> list[tuple[int, ...]]:
    return [d for d in itertools.product((-1, 0, 1), repeat=n) if d > (0,) * n]


def place(vectors: np.ndarray, blocks: int, grid: int, threshold: float):
    """Rotated integers, and for each block its number, cell of the home and of the visits per vector."""
    dims = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = np.rint(unit @ rotation(dims).T * UNIT).astype(np.int16)
    edges = block_edges(dims, blocks)
    placed = []
    for j, radius in enumerate(radii(dims, edges, threshold)):
        g = min(grid, edges[j + 1] - edges[j])
        home = np.floor_divide(turned[:, edges[j]:edges[j] + g].astype(np.int64), radius)
        for k, step in enumerate([(0,) * g, *half_of_neighbours(g)]):
            cell = np.zeros(len(vectors), np.int64)
            for axis in range(g):
                cell = cell * CELL_BASE + home[:, axis] + step[axis] + CELL_BASE // 2
            placed.append((j, int(k > 0), cell))
    return turned, placed


def tile_links(ids, mult, raw, turned, left, right, block, blocks, threshold):
    """Links counted per row, and the linked pairs, for the pairs of left x right that ``block`` names first.

    Where both sides are the same rows, each pair is met once.
    """
    dims, same = raw.shape[1], left is right
    edges = block_edges(dims, blocks)
    limits = [float(r) ** 2 for r in radii(dims, edges, threshold)]
    q = turned.astype(np.float64)
    norm = np.linalg.norm(raw, axis=1)

    def apart(rows, cols, j):
        x, y = q[rows, edges[j]:edges[j + 1]], q[cols, edges[j]:edges[j + 1]]
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)

    links, pairs = np.zeros(len(ids), np.int64), []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        near = apart(rows, right, block) <= limits[block]
        if same:
            near &= rows[:, None] < right[None, :]
        keep_r, keep_c = near.any(1), near.any(0)
        if not keep_r.any():
            continue
        rows, cols, near = rows[keep_r], right[keep_c], near[np.ix_(keep_r, keep_c)]
        for j in range(block):
            near &= apart(rows, cols, j) > limits[j]
        scale = norm[rows][:, None] * norm[cols][None, :]
        cosine = (raw[rows] @ raw[cols].T) / scale
        near &= cosine >= threshold - 1e-9
        r, c = np.nonzero(near)
        close = np.flatnonzero(np.abs(cosine[r, c] - threshold) < 1e-9)  # decide these by a plain dot product
        if len(close):
            i, k = rows[r[close]], cols[c[close]]
            exact = np.array([np.dot(raw[x], raw[y]) for x, y in zip(i, k)]) / (norm[i] * norm[k])
            wrong = close[exact < threshold]
            r, c = np.delete(r, wrong), np.delete(c, wrong)
        i, k = rows[r], cols[c]
        np.add.at(links, i, mult[k])
        np.add.at(links, k, mult[i])
        pairs.append((i, k))
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    return links, a, b


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 8, grid: int = 2,
                    tile_rows: int = 2000, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row; starts jobs."""
    given = vectors.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("_label"),
                           F.col(vector).alias("_vec"))
    bad = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (F.size("_vec") > 0) & ~bad
                      & F.exists("_vec", lambda x: x != 0), F.lit(False))
    classes = stored(given.filter(fine).groupBy("_label", "_vec")
                     .agg(F.min("_id").alias("_rep"), F.count("*").alias("_mult")), "classes")

    width = np.float32 if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else np.float64
    label_type = classes.schema["_label"].dataType.simpleString()
    at_home = f"_label {label_type}, _dims int, _block int, _cell long, _visits int, _rep long, _mult long, " \
              "_raw binary, _turned binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for dims in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dims)
                    raw = values[starts[rows][:, None] + np.arange(dims)]
                    turned, cells = place(raw, blocks, grid, threshold)
                    own = batch.take(pa.array(rows))
                    as_given = pa.array([x.tobytes() for x in raw.astype(width)], pa.binary())
                    as_turned = pa.array([x.tobytes() for x in turned], pa.binary())
                    for j, visits, cell in cells:
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [own.column(0), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, j, np.int32)),
                             pa.array(cell), pa.array(np.full(n, visits, np.int32)), own.column(2), own.column(3),
                             as_given, as_turned],
                            names=["_label", "_dims", "_block", "_cell", "_visits", "_rep", "_mult", "_raw", "_turned"])

    rows = stored(classes.select("_label", "_vec", "_rep", "_mult").mapInArrow(placed, at_home), "cells")
    cell = ["_label", "_dims", "_block", "_cell"]
    # a cell without a resident holds no pair; the others are cut into tiles of chunk against chunk
    crowd = (rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.min("_visits").alias("_least"))
             .filter("_least = 0 AND _n > 1").select(*cell, F.ceil(F.col("_n") / tile_rows).cast("int").alias("_k")))
    rows = rows.join(crowd, cell).withColumn("_chunk", F.pmod(F.xxhash64("_rep"), F.col("_k")).cast("int"))
    # tile (i, j): residents of chunk i against visitors of chunk j and, for i <= j, residents of chunk j
    steps, none = F.sequence(F.lit(0), F.col("_k") - 1), F.array().cast("array<struct<i:int,j:int,right:boolean>>")
    as_left = F.transform(steps, lambda j: F.struct(F.col("_chunk").alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.transform(F.filter(steps, lambda i: (F.col("_visits") == 1) | (i < F.col("_chunk"))),
                           lambda i: F.struct(i.alias("i"), F.col("_chunk").alias("j"), F.lit(True).alias("right")))
    rows = rows.withColumn("_tile", F.explode(F.concat(F.when(F.col("_visits") == 0, as_left).otherwise(none), as_right)))
    rows = rows.select(*cell, "_rep", "_mult", "_raw", "_turned", "_tile.*")

    def compare(group: pa.Table) -> pa.Table:
        ids, mult = group.column("_rep").to_numpy(), group.column("_mult").to_numpy()
        dims, block = group.column("_dims")[0].as_py(), group.column("_block")[0].as_py()
        raw = np.frombuffer(b"".join(group.column("_raw").to_pylist()), width).reshape(-1, dims).astype(np.float64)
        turned = np.frombuffer(b"".join(group.column("_turned").to_pylist()), np.int16).reshape(-1, dims)
        right = group.column("right").to_numpy(zero_copy_only=False).astype(bool)
        left, right = np.flatnonzero(~right), np.flatnonzero(right)
        sides = [(left, right)]
        if group.column("i")[0] == group.column("j")[0]:
            sides.append((left, left))
        done = [tile_links(ids, mult, raw, turned, x, y, block, blocks, threshold) for x, y in sides]
        links = sum(d[0] for d in done)
        head = local_heads(ids, np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done]))
        met = np.flatnonzero(links > 0)
        return pa.table({"id": ids[met], "links": links[met], "head": head[met]})

    found = stored(rows.groupBy("_label", "_dims", "_block", "_cell", "i", "j").applyInArrow(
        compare, "id long, links long, head long"), "met")
    counts = found.groupBy("id").agg(F.sum("links").alias("_links"))
    whole = components(found.select(F.col("id").alias("a"), F.col("head").alias("b")))
    known = stored(classes.join(counts, classes["_rep"] == counts["id"], "left")
                   .join(whole, classes["_rep"] == whole["node"], "left")
                   .select("_label", "_vec", (F.coalesce("_links", F.lit(0)) + F.col("_mult") - 1).alias("n_links"),
                           F.coalesce("component", "_rep").alias("component_id")), "known")
    linked = given.filter(fine).join(known, ["_label", "_vec"]).select("_id", "n_links", "component_id")
    alone = given.filter(~fine).select("_id", F.lit(0).cast("long").alias("n_links"),
                                       F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(key), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
