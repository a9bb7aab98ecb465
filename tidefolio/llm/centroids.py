"""Centroid clustering of integer vectors with JVM-native expressions.

Every component becomes ``floor(scale * x)``, so that distances, sums and centroids are exact
integers and no result depends on the order of rows. ``zip_with`` and ``aggregate`` take the
distance to each centroid, a literal array in the plan; ``array_min`` over structs (distance,
number) picks the nearest. New centroids come from one sum per component, in generated
code and combined before the shuffle.

Scale: the vectors are turned into integers once and read once a round; what is shuffled is one row of
sums per task and centroid, and what reaches the driver is ``k`` rows. A cluster that
holds most vectors costs no more than any other.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite
component are left out. Rows that repeat an id are vectors of their own; of equal hashes the smaller integer
vector seeds first, and a null id hashes as empty text. With fewer vectors than ``k``
there are fewer centroids, and with none there are no rows. A component of 2**27 or more after scaling
is an error, as squared distances might not fit a bigint. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import stored

LARGEST = 1 << 27

Centroid = tuple[int, ...]


def integers(vectors: DataFrame, size: int, scale: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, q``: the kept vectors as arrays of int."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(F.col(vector), lambda x: F.when(
        F.abs(x.cast("double") * scale) < LARGEST, F.floor(x.cast("double") * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint")).cast("int"))
    return vectors.filter((F.size(vector) == size) & finite).select(F.col(key), scaled.alias("q"))


def seeds(points: DataFrame, k: int, seed: int, key: str = "vec_id") -> list[Centroid]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return [tuple(r.q) for r in points.orderBy(F.sha2(name, 256), "q").limit(k).collect()]


def nearest(q: Column, centroids: Sequence[Centroid]) -> Column:
    """Struct of squared ``distance`` and number of the nearest ``cluster``; ties go to the smaller number."""
    def distance(centroid: Centroid) -> Column:
        squares = F.zip_with(q, F.split(F.lit(",".join(map(str, centroid))), ",").cast("array<bigint>"),
                             lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, square: total + square)
    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids))))


def assigned(points: DataFrame, centroids: Sequence[Centroid]) -> DataFrame:
    """``points`` with ``distance`` and ``cluster``."""
    return points.withColumn("_near", nearest(F.col("q"), centroids)).select(
        *points.columns, F.col("_near.distance").alias("distance"), F.col("_near.cluster").alias("cluster"))


def moved(points: DataFrame, centroids: Sequence[Centroid]) -> list[Centroid]:
    """Each centroid as the floored mean of its vectors; one without vectors stays."""
    size = len(centroids[0])
    sums = assigned(points, centroids).groupBy("cluster").agg(
        F.count("*").alias("n"), *(F.sum(F.col("q")[i].cast("bigint")).alias(f"s{i}") for i in range(size)))
    out = list(centroids)
    for row in sums.collect():  # at most one row per centroid
        out[row.cluster] = tuple(row[f"s{i}"] // row.n for i in range(size))
    return out


def fit(points: DataFrame, k: int, rounds: int, seed: int, key: str = "vec_id") -> list[Centroid]:
    """Centroids after ``rounds`` of moving; empty if there are no points."""
    centroids = seeds(points, k, seed, key)
    for _ in range(rounds if centroids else 0):
        centroids = moved(points, centroids)
    return centroids


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: float = 64.0,
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector (jobs)."""
    points = stored(integers(vectors, size, scale, key, vector), "points")
    centroids = fit(points, k, rounds, seed, key)
    if not centroids:
        return points.select(key, F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    found = stored(assigned(points, centroids).drop("q"), "assigned")
    total = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    own = F.array(*(F.lit(total.get(i, 0)).cast("bigint") for i in range(len(centroids))))
    digest = F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids))
    return found.select(key, "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"),
                        F.lit(sum(total.values())).cast("bigint").alias("inertia"),
                        digest[F.col("cluster")].alias("centroid_sha256"))


def cluster_sql(k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: int = 64) -> str:
    """The same for DuckDB, one pair of subqueries a round."""
    near = """SELECT row, vec_id, q, min(struct_pack(distance := CAST(list_sum([(q[i] - c[i]) * (q[i] - c[i])
                FOR i IN range(1, {end})]) AS BIGINT), cluster := cluster)) AS near
              FROM points, c{r} GROUP BY row, vec_id, q"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(end=size + 1, r=r)})")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (
                    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                        SELECT near.cluster AS cluster, i, count(*) AS n, sum(q[i]) AS s
                        FROM a{r}, range(1, {size + 1}) t(i) GROUP BY ALL) GROUP BY cluster) m USING (cluster))""")
    return f"""
        WITH points AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings WHERE len([x FOR x IN embedding IF isfinite(x)]) = {size} AND len(embedding) = {size}),
        seeds AS (SELECT q, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM points ORDER BY h, q LIMIT {k}),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q AS c FROM seeds),
        {', '.join(steps)}
        SELECT vec_id, near.cluster AS cluster, near.distance AS distance,
               CAST(sum(near.distance) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(near.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = near.cluster"""
