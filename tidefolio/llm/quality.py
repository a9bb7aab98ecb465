"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model over features of the whole text gives each document its evidence. Hosts
and the paths below them get posteriors by grouped aggregates: the mean evidence of a site,
shrunk toward its parent (path to host, host to all documents) by as many pseudo-documents
as the ratio of the variance within sites to that between them says (method of moments).
A document's score is its evidence with the site's posterior as prior in place of the
global one; its own evidence is left out of its path's mean.

Scale: texts are read once and leave as a row of features; site sums combine on the map
side; sites come back by a join on host and path that AQE splits on a hot host. The model is
fitted on the ``max_labelled`` labelled rows of smallest id hash, on the driver.

Defined results: null text is the empty text, null site parts are empty names; repeated rows
each count and are each scored; labels that disagree are averaged. Without labels of both
kinds evidence is 0.5 and everything is kept. Extra columns do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefolio.llm.common import stored
from tidefolio.llm.words import shingle_hashes, slices, text_bytes, word_hashes

MAX_LABELLED = 50_000
FEATURES = 18


def _mask(codes: bytes) -> np.ndarray:
    found = np.zeros(256, np.uint8)
    found[np.frombuffer(codes, np.uint8)] = 1
    return found


_KINDS = [_mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58))),
          _mask(b"#$%&*+=<>@^~\\_"), _mask(b"!?"), _mask(b"|"), _mask(b"\n"), _mask(b".,;:"), _mask(b" \t\r\n"),
          _mask(bytes(range(128, 192)))]


def _distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its commonest occurs."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, text[at], np.diff(np.append(at, len(hashes))))
    return np.bincount(text[at], minlength=texts), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    size = np.diff(offsets).astype(np.float64)
    rows = np.flatnonzero(size > 0)
    counts = np.zeros((n, len(_KINDS)))
    for k, kind in enumerate(_KINDS):
        if len(rows):
            counts[rows, k] = np.add.reduceat(kind[data], offsets[:-1][rows], dtype=np.int64)
    upper, lower, digit, symbol, loud, bar, line, stop, space, tail = counts.T
    words, bounds = word_hashes(data, offsets)
    per = np.diff(bounds).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(bounds))
    distinct, most = _distinct(words, of, n)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(words) else np.zeros(n)
    pairs, pair_of = shingle_hashes(words, bounds, 3)
    distinct3, _ = _distinct(pairs, pair_of, n)
    chars, solid = np.maximum(size - tail, 1), np.maximum(size - space - tail, 1)
    per1 = np.maximum(per, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(per), solid / per1, distinct / per1, most / per1, again / per1,
        distinct3 / np.maximum(np.bincount(pair_of, minlength=n), 1), upper / solid, lower / solid, digit / solid,
        symbol / solid, loud / per1, bar / per1, line / per1, stop / per1, space / chars, (symbol > 0), (per < 5)])


class Logistic:
    """Ridge logistic regression on standardised features and their bins; a few Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, bins: int = 8):
        self.constant = None
        if not len(y) or y.min() > 0.5 or y.max() <= 0.5:
            self.constant = 0.5
            return
        self.cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (p - y) + ridge * self.w
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(len(self.w)), grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -6, 6)]
        for c, cuts in zip(x.T, self.cuts):
            parts.append((c[:, None] >= cuts[None, :]).astype(np.float64))
        return np.hstack(parts)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -12, 12)))


def _by_slices(arrays: Iterator[pa.Array], work) -> Iterator[pa.Array]:
    for array in arrays:
        batch = pa.RecordBatch.from_arrays([array], names=["text"])
        done = [work(part.column(0)) for part in slices(batch, 0)]
        yield pa.concat_arrays(done) if done else work(array)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def rows(part: pa.Array) -> pa.Array:
        x = features(part)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
    yield from _by_slices(texts, rows)


def evidence_udf(model: Logistic):
    """Evidence straight from texts, for those who keep the texts in the row."""
    @F.arrow_udf("double")
    def evidence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _by_slices(texts, lambda part: pa.array(model.predict(features(part))))
    return evidence


def _from_features(model: Logistic):
    @F.arrow_udf("double")
    def evidence(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in rows:
            x = array.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.array(model.predict(x))
    return evidence


def fit(featured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        max_labelled: int = MAX_LABELLED) -> Logistic:
    """The model of the labelled rows; ``featured`` has ``_id`` and ``_x``."""
    known = (labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
             .groupBy("_id").agg(F.avg("_y").alias("_y")))
    rows = (featured.select("_id", "_x").join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
            .select("_x", "_y").toPandas())
    x = np.array(rows["_x"].tolist(), np.float64).reshape(-1, FEATURES)
    return Logistic(x, rows["_y"].to_numpy(np.float64))


def _strength(groups: DataFrame, parent_mean: Column) -> float:
    """Pseudo-documents of a parent: variance within sites over variance between them."""
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    row = groups.agg(F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(n * n).alias("nn"),
                     F.sum(q - s * s / n).alias("within"),
                     F.sum(n * F.pow(s / n - parent_mean, 2)).alias("between")).first()
    if not row.n or row.n <= row.g or row.g < 2:
        return 10.0
    within = max(row.within / (row.n - row.g), 1e-9)
    between = max((row.between - (row.g - 1) * within) / max(row.n - row.nn / row.n, 1e-9), 1e-9)
    return float(min(max(within / between, 1.0), 1e6))


def sites(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """Per (host, path): sums and the host's posterior; strength of a host over its paths; global mean.

    ``evidence`` has ``_host``, ``_path`` and ``_p``.
    """
    paths = stored(evidence.groupBy("_host", "_path").agg(
        F.count("*").alias("_n"), F.sum("_p").alias("_s"), F.sum(F.col("_p") * F.col("_p")).alias("_q")), "paths")
    hosts = stored(paths.groupBy("_host").agg(*(F.sum(c).alias(c) for c in ("_n", "_s", "_q"))), "hosts")
    total = hosts.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).first()
    mean = min(max((total.s or 0.0) / (total.n or 1), 1e-6), 1 - 1e-6)
    strong = _strength(hosts, F.lit(mean))
    host_mean = hosts.select("_host", ((F.col("_s") + strong * mean) / (F.col("_n") + strong)).alias("_above"))
    below = paths.join(host_mean, "_host")
    return stored(below, "sites"), _strength(below, F.col("_above")), mean


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def combined(evidence: DataFrame, below: DataFrame, strength: float, mean: float, threshold: float) -> DataFrame:
    """``evidence`` with ``host_posterior, path_posterior, score, kept`` in place of its site columns."""
    path = (F.col("_s") - F.col("_p") + strength * F.col("_above")) / (F.col("_n") - 1 + strength)
    joined = evidence.join(below, ["_host", "_path"])
    score = 1 / (1 + F.exp(-(logit(F.col("_p")) - logit(F.lit(mean)) + logit(path))))
    return (joined.withColumn("evidence", F.col("_p")).withColumn("host_posterior", F.col("_above"))
            .withColumn("path_posterior", path).withColumn("score", score)
            .withColumn("kept", F.col("score") >= threshold)
            .drop("_host", "_path", "_p", "_n", "_s", "_q", "_above"))


def site_of(source: Column, section: Column) -> tuple[Column, Column]:
    """Host: the source up to its first slash; path: what follows, then the section."""
    source = F.coalesce(source, F.lit(""))
    return F.substring_index(source, "/", 1), F.concat_ws("/", source, F.coalesce(section, F.lit("")))


def model_and_sites(documents: DataFrame, labels: DataFrame, host: Column, path: Column, max_labelled: int = MAX_LABELLED,
                    key: str = "doc_id", text: str = "text"):
    """Evidence of every row (``_id, _host, _path, _p``, stored), the model and the sites; starts jobs."""
    featured = stored(documents.select(F.col(key).alias("_id"), host.alias("_host"), path.alias("_path"),
                                       text_features(F.col(text)).alias("_x")), "features")
    model = fit(featured, labels, key, max_labelled=max_labelled)
    rows = stored(featured.select("_id", "_host", "_path", _from_features(model)(F.col("_x")).alias("_p")), "evidence")
    return rows, model, sites(rows)


def classify(documents: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5,
             max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, evidence, host_posterior, path_posterior, score, kept`` for every row."""
    rows, _, (below, strength, mean) = model_and_sites(documents, labels, host, path, max_labelled, key, text)
    return combined(rows, below, strength, mean, threshold).withColumnRenamed("_id", key)


def accepted(documents: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5,
             max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns they came with.

    Judges each row by itself: evidence is computed again beside the text, so no row is looked up by its id.
    """
    _, model, (below, strength, mean) = model_and_sites(documents, labels, host, path, max_labelled, key, text)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_doc"), host.alias("_host"),
                            path.alias("_path"), evidence_udf(model)(F.col(text)).alias("_p"))
    return combined(rows, below, strength, mean, threshold).filter("kept").select("_doc.*")
