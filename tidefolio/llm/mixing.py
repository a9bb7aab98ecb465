"""Mixing by soft membership: document rates whose expected domain tokens match targets.

DataFrame operations only. A naive Bayes model of word counts, learned from documents of a
labelled table whose domain is known, gives every document posteriors over the domains of
``targets``. With tokens n and posteriors p, rates r >= ``least`` are fitted so that for
each domain k the expected tokens, the sum of r * n * p_k, come to its share of the
budget: projected-gradient least squares with implicit steps, each look at the error one
aggregate over all documents. A step is found by K numbers, so rates are an expression of
the posteriors and equal posteriors have equal rates.

The model is bounded by parameters: at most ``max_labelled`` labelled documents (smallest
id hash) and ``vocabulary`` words, those whose counts differ most between domains; so
it may be broadcast. Texts are read once to score them. A document's words stay in the task
that reads it and combine there; everything later is narrow rows.

Defined results: null text is empty; rows that share an id, null ids too, are one document whose
words add up (and the prior, once a row); labelled rows of other domains teach nothing. A document without a word of the model
belongs to no domain: its posteriors are 0, its rate is ``least`` or 1, whichever is more. A domain of which no
document is labelled cannot be recognised: its posteriors are 0, its target stays unmet, and the others
share its part. A target that the documents cannot serve below the rate ``most`` stays unmet too (least squares);
``achieved`` says by how much. Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import stored

MAX_LABELLED = 5_000
VOCABULARY = 2_000
STEPS = 60  # aggregates over all documents
ENDED, LONGEST = 1e-3, 1e10  # part of the error that counts as none; longest step, in parts of the tokens
PRIOR_WORD = ""
UNSEEN = -1e300  # log prior of a domain without labelled documents


def words_of(text: Column) -> Column:
    """Lower-case words without the punctuation around them; tokens are counted by them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?|]+")


def word_model(documents: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text",
               domain: str = "lang", max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> DataFrame:
    """At most ``vocabulary + 1`` rows ``word, w_0 .. w_K-1``: log likelihoods, and the log prior under ``""``."""
    chosen = (labelled.select(F.col(key).alias("_id")).dropna().distinct()
              .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    docs = (documents.join(F.broadcast(chosen), documents[key] == chosen["_id"])
            .filter(F.col(domain).isin(domains)).select(F.col(domain).alias("_k"), words_of(F.col(text)).alias("_words")))
    docs = stored(docs, "labelled")
    per_domain = [F.sum(F.when(F.col("_k") == k, 1).otherwise(0)).cast("double").alias(f"c_{i}")
                  for i, k in enumerate(domains)]
    counts = (docs.select("_k", F.explode("_words").alias("word")).filter("word <> ''").groupBy("word").agg(*per_domain))
    counts = stored(counts, "words")
    totals = counts.agg(*(F.sum(f"c_{i}") for i in range(len(domains)))).first()
    totals = [float(t or 0) for t in totals]
    size = sum(totals) or 1.0
    every = sum((F.col(f"c_{i}") for i in range(len(domains))), F.lit(0.0))
    # how far a word's split over the domains is from that of all words (log likelihood ratio)
    ratio = sum((F.when(F.col(f"c_{i}") > 0, F.col(f"c_{i}") * F.log(F.col(f"c_{i}") * size / (every * max(t, 1.0))))
                 .otherwise(0.0) for i, t in enumerate(totals)), F.lit(0.0))
    best = counts.withColumn("_ratio", ratio).orderBy(F.desc("_ratio"), "word").limit(vocabulary)
    weights = best.select("word", *(F.log((F.col(f"c_{i}") + 0.5) / (t + 0.5 * vocabulary)).alias(f"w_{i}")
                                    for i, t in enumerate(totals)))
    found = docs.agg(*(F.sum(F.when(F.col("_k") == k, 1).otherwise(0)) for k in domains)).first()
    seen = [float(n or 0) for n in found]
    prior = [float(np.log((n + 1) / (sum(seen) + len(domains)))) if n else UNSEEN for n in seen]
    first = documents.sparkSession.range(1).select(
        F.lit(PRIOR_WORD).alias("word"), *(F.lit(x).alias(f"w_{i}") for i, x in enumerate(prior)))
    return stored(weights.unionByName(first).coalesce(1), "model")


def posteriors(documents: DataFrame, model: DataFrame, domains: list[str], key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``_id, _n, p_0 ..``: tokens and domain posteriors of each document."""
    words = F.filter(words_of(F.col(text)), lambda w: w != "")
    each = documents.select(F.col(key).alias("_id"), words.alias("_words"))
    each = each.select("_id", F.size("_words").alias("_n"), F.explode(F.concat(F.array(F.lit(PRIOR_WORD)), "_words")).alias("word"))
    sums = (each.join(F.broadcast(model), "word").groupBy("_id")
            .agg(F.sum(F.when(F.col("word") == PRIOR_WORD, F.col("_n"))).cast("long").alias("_n"),
                 F.count(F.when(F.col("word") != PRIOR_WORD, 1)).alias("_known"),
                 *(F.sum(f"w_{i}").alias(f"w_{i}") for i in range(len(domains)))))
    top = F.greatest(*(F.col(f"w_{i}") for i in range(len(domains)))) if len(domains) > 1 else F.col("w_0")
    odds = [F.exp(F.col(f"w_{i}") - top) for i in range(len(domains))]
    member = (F.col("_known") > 0) & (top > UNSEEN / 2)
    return sums.select("_id", "_n", *(F.when(member, o / sum(odds, F.lit(0.0))).otherwise(0.0).alias(f"p_{i}") for i, o in enumerate(odds)))


def fit_rates(rows: DataFrame, shares: list[float], budget: float | None = None, least: float = 0.0, most: float | None = None,
              steps: int = STEPS, tolerance: float = 1e-7) -> DataFrame:
    """``rows`` with their ``rate``. ``budget`` None: as many tokens as there are; 0: the smallest that cuts no domain.

    Rates are between ``least`` and ``most`` (None: unbounded). Domains to which no token belongs are left out: the others share their part.
    A document's gradient is its posteriors times the error of each domain. The projected step
    ``rate = max(least, start - p * push)`` is taken at the error where it ends, ``push = length * error``, so that no
    length is too long: ``push`` minimises a convex function of K numbers, by Newton's method with a line search.
    The length grows until the error no longer does with it; the rates of the least error seen are returned.
    """
    size, start = len(shares), max(1.0, least)
    p = [F.col(f"p_{i}") for i in range(size)]
    totals = [float(x or 0) for x in rows.agg(*(F.sum(F.col("_n") * x) for x in p)).first()]
    whole = max(sum(totals), 1.0)
    served = sum(s for t, s in zip(totals, shares) if t > 0) or 1.0
    shares = [s / served if t > 0 else 0.0 for t, s in zip(totals, shares)]
    if budget is None:
        budget = sum(totals)
    elif budget == 0:
        budget = max((t / s for t, s in zip(totals, shares) if s > 0), default=0.0)
    goal = np.array(shares) * budget

    def rate(pull: Column) -> Column:
        bounded = F.lit(start) - pull if most is None else F.least(F.lit(float(most)), F.lit(start) - pull)
        return F.greatest(F.lit(least), bounded)

    def look(push: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value of the convex function without its last term, error, and curvature over the rates that may move."""
        pull = sum((F.lit(float(y)) * x for x, y in zip(p, push)), F.lit(0.0))
        room, gap = start - least, (most or 0.0) - start
        above = F.lit(False) if most is None else F.col("_pull") < -gap
        free = (F.col("_pull") < room) & ~above
        value = (F.when(free, (F.col("_pull") / 2 - start) * F.col("_pull")).when(above, -(most or 0.0) * F.col("_pull") - gap * gap / 2)
                 .otherwise(-least * F.col("_pull") - room * room / 2))
        moves = F.when(free, F.col("_n")).otherwise(0.0)
        got = rows.withColumn("_pull", pull).agg(
            F.sum(F.col("_n") * value), *(F.sum(F.col("_n") * rate(F.col("_pull")) * x) for x in p),
            *(F.sum(moves * p[i] * p[j]) for i in range(size) for j in range(i, size))).first()
        got = [float(x or 0) for x in got]
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = got[1 + size:]
        return got[0] + float(push @ goal), np.array(got[1:1 + size]) - goal, matrix + np.triu(matrix, 1).T

    push = best = np.zeros(size)
    value, error, matrix = look(push)
    miss, length, looks = np.linalg.norm(error), 100 / whole, 1
    while looks < steps and np.abs(error).max() >= tolerance * max(budget, 1.0):
        slope = push / length - error
        if np.linalg.norm(slope) <= ENDED * np.linalg.norm(error):  # the projected gradient is 0 at this length
            if length * whole >= LONGEST:
                break
            length *= 100
            continue
        turn = np.linalg.solve(matrix + np.eye(size) / length, slope)
        held, part = value + float(push @ push) / (2 * length), 1.0
        while looks < steps:
            to = push - part * turn
            value, error, matrix = look(to)
            looks += 1
            if np.linalg.norm(error) < miss:
                best, miss = to, np.linalg.norm(error)
            if value + float(to @ to) / (2 * length) <= held - 1e-4 * part * float(slope @ turn) + 1e-13 * abs(held) or part < 1e-6:
                break
            part /= 4
        push = to
    return rows.withColumn("rate", rate(sum((F.lit(float(y)) * x for x, y in zip(p, best)), F.lit(0.0))))


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies with ``rate`` as their expected number, by a hash of the id."""
    spread = (F.xxhash64(key, F.lit("copies")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    return F.floor(rate + spread).cast("long")


def mix(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float | None = None,
        least: float = 0.0, most: float | None = None, key: str = "doc_id", text: str = "text", domain: str = "lang",
        max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> DataFrame:
    """``key, tokens, p_<domain> .., rate, copies`` for every document; starts jobs."""
    domains = sorted(targets)
    whole = sum(targets.values())
    model = word_model(documents, labelled, domains, key, text, domain, max_labelled, vocabulary)
    rows = stored(posteriors(documents, model, domains, key, text), "posteriors")
    rated = fit_rates(rows, [targets[k] / whole for k in domains], budget, least, most)
    return rated.select(F.col("_id").alias(key), F.col("_n").alias("tokens"),
                        *(F.col(f"p_{i}").alias(f"p_{k}") for i, k in enumerate(domains)), "rate",
                        copies_of(F.col("rate"), F.col("_id")).alias("copies"))


def achieved(mixture: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """``domain, target, expected_tokens, share, residual``: what the rates of :func:`mix` come to, as shares of all member tokens."""
    whole = sum(targets.values())
    sums = mixture.agg(*(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{k}")), F.lit(0.0)).alias(k) for k in targets))
    every = sum((F.col(k) for k in targets), F.lit(0.0))
    share = lambda k: F.when(every > 0, F.col(k) / every).otherwise(0.0)
    return sums.select(F.inline(F.array(*(F.struct(
        F.lit(k).alias("domain"), F.lit(t / whole).alias("target"), F.col(k).alias("expected_tokens"), share(k).alias("share"),
        (share(k) - t / whole).alias("residual")) for k, t in targets.items()))))


def mixed(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id",
          **options) -> DataFrame:
    """The documents with the columns they came with, each as often as its ``copies`` say."""
    rates = mix(documents, labelled, targets, key=key, **options).select(F.col(key).alias("_rated"), F.col("copies").alias("_copies"))
    rows = documents.select(F.col(key).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_doc"))
    joined = rows.join(rates.filter("_copies > 0"), rows["_key"].eqNullSafe(rates["_rated"]))
    return joined.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")
