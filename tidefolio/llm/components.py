"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Join each neighbour above a node to the smallest node of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Join each node and its neighbours below to the smallest of them; links are (larger, smaller)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of a link, with the smallest node it can reach.

    Takes O(log² n) rounds; each writes its links and reads back their fingerprint, one
    row. The smallest node of a star is found by a partially combined aggregate, and its
    join is by equality, so AQE may split a node with very many links.
    """
    links = stored(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .distinct(), "links")
    before = None
    while True:
        mark = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == before:
            break
        before = mark
        links = stored(_small_star(_large_star(links)), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def local_heads(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component under the links a[i] - b[i]."""
    head = ids.copy()
    while True:
        low = np.minimum(head[a], head[b])
        new = head.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == head).all():
            return head
        head = new
