"""Importance resampling of documents toward a target: array-scored weights, then a radix sort.

Features are runs of one to ``longest`` words, repeats counted, hashed into buckets. A
bucket's gain compares its share of all target texts with its share of all documents; a
document's weight is the floored mean of the gains of its features, looked up in one array. With
the Gumbel noise of its id added, the highest scores are a sample without replacement in
proportion to the weights' exponentials. Ranks come from ``radix.ranked``.

Scale: texts are cut into words once; the buckets of a document are stored as small integers beside
it. Counts are partial aggregates over at most ``buckets`` keys, so what reaches the driver, and
goes into the plan, is one array of that length. Scores are sorted as narrow rows.

Defined results: null and empty texts have no features, weight 0 and, having too few words, no rank. Rows that
repeat an id have the same noise; rows equal in score and id are ranked in any order. A null id
is empty text for the noise and comes after all others on ties. Without target texts all gains
compare with nothing seen. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.asciiwords import bound, words
from tidefolio.llm.common import discard, stored
from tidefolio.llm.radix import ranked

BUCKETS = 10_000
HASHES = 1 << 32


def features(listed: Column, longest: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, as an array."""
    def run(words_: Column, n: int) -> Column:
        if n == 1:
            return F.transform(words_, lambda w: F.crc32(w))
        starts = F.sequence(F.lit(0), F.size(words_) - n)
        joined = lambda i: F.concat_ws(" ", *(words_[i + j] for j in range(n)))
        return F.when(F.size(words_) >= n, F.transform(starts, lambda i: F.crc32(joined(i)))).otherwise(F.array().cast("array<bigint>"))
    return bound(listed, lambda w: F.transform(F.concat(*(run(w, n) for n in range(1, longest + 1))),
                                               lambda c: (c % buckets).cast("int")))


def bucket_counts(featured: DataFrame) -> DataFrame:
    return featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of every bucket from the bucket counts of all documents and all target texts; one row per bucket is collected."""
    s, t = corpus.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(
        t, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    both = stored(both, "bucket-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def scored(documents: DataFrame, target: DataFrame, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, key: str = "doc_id",
           text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every row (jobs)."""
    small = "array<smallint>" if buckets <= 1 << 15 else "array<int>"
    listed = lambda df, column: df.select(words(F.col(column)).alias("_w"))
    docs = documents.select(F.col(key), words(F.col(text)).alias("_w")).select(
        key, F.size("_w").cast("bigint").alias("n_words"), features(F.col("_w"), longest, buckets).cast(small).alias("features"))
    docs = stored(docs, "features")
    wanted = listed(target, target_text).select(features(F.col("_w"), longest, buckets).alias("features"))
    array = F.split(F.lit(",".join(map(str, gains(bucket_counts(docs), bucket_counts(wanted), buckets)))), ",").cast("array<int>")
    total = F.aggregate("features", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + array[b.cast("int")])
    n = F.size("features").cast("bigint")
    summed = docs.select(key, "n_words", n.alias("n_features"), total.alias("_sum"))
    # exact division toward minus infinity
    mean = F.expr("CASE WHEN n_features > 0 THEN (_sum - pmod(_sum, n_features)) div n_features ELSE 0 END")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / float(HASHES))))
    out = stored(summed.select(key, "n_words", "n_features", mean.alias("weight"), (mean + noise).alias("score")), "scored")
    discard(docs)
    return out


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2,
             buckets: int = BUCKETS, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null where it is not drawn (jobs)."""
    rows = scored(documents, target, longest, buckets, seed, key, text, target_text)
    enough = F.col("n_words") >= least_words
    eligible = rows.filter(enough)
    order = [F.bitwise_not(F.col("score")), F.col(key).isNull().cast("int"), F.coalesce(F.col(key), F.lit(0))]
    ranks = ranked(eligible, order)
    drawn = eligible.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranks.withColumn("rank", rank).unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("bigint")))


def resample_sql(percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> str:
    """The same for DuckDB, runs of up to two words; crc32 by its table of 256 entries, once a distinct run."""
    listed = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    runs = "list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return f"""
        WITH steps AS (SELECT [list_reduce(list_prepend(CAST(n AS BIGINT), range(8)),
                                           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                               FOR n IN range(256)] AS steps),
        docs AS (SELECT row_number() OVER () AS row, doc_id, {listed} AS w FROM documents),
        target AS (SELECT {listed} AS w FROM benchmark),
        doc_runs AS MATERIALIZED (SELECT row, unnest({runs}) AS run FROM docs),
        target_runs AS MATERIALIZED (SELECT unnest({runs}) AS run FROM target),
        hashed AS MATERIALIZED (
            SELECT run, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h[i:i + 1] AS BIGINT) FOR i IN range(1, len(h), 2)]),
                                        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket
            FROM (SELECT run, hex(encode(run)) AS h FROM (SELECT run FROM doc_runs UNION SELECT run FROM target_runs)), steps),
        s AS (SELECT bucket, count(*) AS s FROM doc_runs JOIN hashed USING (run) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM target_runs JOIN hashed USING (run) GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln(
                      (coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_runs) + {buckets})::DOUBLE
                      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target_runs) + {buckets})::DOUBLE))) AS BIGINT) AS gain
                  FROM (SELECT unnest(range({buckets})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        weights AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total
                    FROM doc_runs JOIN hashed USING (run) JOIN gains USING (bucket) GROUP BY row),
        scored AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features,
                   coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
                   CAST('0x' || sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
            FROM docs LEFT JOIN weights USING (row)),
        drawn AS (
            SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) AS place,
                         count(*) OVER (PARTITION BY n_words >= {least_words}) AS n FROM drawn)
        SELECT doc_id, n_words, n_features, weight, score,
               CASE WHEN n_words >= {least_words} AND place <= {percent} * n // 100 THEN place END AS rank
        FROM ranks"""
