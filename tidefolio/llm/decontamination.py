"""Benchmark passages in training documents, by a positional inverted index; DataFrame operations only.

The index holds one posting ``(term, doc, pos)`` per word of the documents, written as
segments: each task sorts the postings of its own documents by the hash of the term. Nothing is shuffled
for it, a posting list may be of any length, and copies or long documents add rows, never
larger rows.

Benchmark items are cut into windows of ``width`` consecutive words (a shorter item is one
window). The rarest ``anchors`` terms of each window, by postings in the corpus, have their lists
fetched and adjusted by their offsets: postings that agree on (document, place where the
item would start) intersect. What is left after the rarest lists is compared word by
word with the document. ``slop`` > 0 also finds proximity matches: every term of the window
within ``slop`` places of where the phrase would have it.

Scale: windows are distinct over all items, and belong to chunks of at most ``CHUNK`` starts,
so no group is longer than that. Terms are counted by partial aggregates. The anchors are
rare terms by choice; where they are many, they meet the postings in a shuffled join, which AQE splits
where a term is frequent all the same. A text travels at most once, beside its candidates.

Defined results: null and empty texts have no words; an item without words has no window and a
document without words no hit. Documents are told apart by (id, text), so that rows sharing an
id are judged by their own texts, and repeated rows alike. Items sharing an id count once. Null item ids are
left out of lists and counts of items, but what they hit is hit. Other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tidefolio.llm.asciiwords import bound, lowered, n_words, pieces, words
from tidefolio.llm.common import discard, named, stored

WIDTH = 10
ANCHORS = 2
CHUNK = 256


def _document(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``term, doc, pos`` of all words, stored in segments sorted by the terms' hashes (a job).

    A number sorts faster than a text, and the rows of a term stand together all the same.
    """
    docs = documents.select(_document(key, text).alias("doc"), pieces(F.col(text)).alias("_p"))
    return stored(docs.select("doc", (F.col("_p")[0] == "").cast("int").alias("_ahead"), F.posexplode("_p").alias("_at", "_w"))
                  .filter("_w != ''").select(lowered(F.col("_w")).alias("term"), "doc", (F.col("_at") - F.col("_ahead")).alias("pos"))
                  .sortWithinPartitions(F.xxhash64("term")), "postings")


def windows(benchmark: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``window, chunk, first, words``, and ``window, item`` (jobs).

    ``first`` is the window's place in its chunk, whose words are those of one item from one place on.
    """
    items = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - width))
    places = items.select("item", "_w", F.explode(starts).alias("_s"))
    cut = places.select("item", F.slice("_w", F.col("_s") + 1, F.lit(width)).alias("words"),
                        F.slice("_w", F.col("_s") - F.col("_s") % CHUNK + 1, F.lit(CHUNK + width - 1)).alias("_chunk"),
                        (F.col("_s") % CHUNK).cast("int").alias("first"))
    cut = stored(cut, "cut")
    chunks = named(cut.select(F.col("_chunk")), ["_chunk"], "chunks").withColumnRenamed("name", "chunk")
    names = named(cut, ["words"], "windows").withColumnRenamed("name", "window")
    owners = cut.join(chunks, "_chunk").groupBy("words").agg(F.min(F.struct("chunk", "first")).alias("_own"))
    distinct = names.join(owners, "words").select("window", "_own.chunk", "_own.first", "words")
    return stored(distinct, "windows"), stored(cut.join(names, "words").select("window", "item").distinct(), "window-items")


def _rarest(postings: DataFrame, distinct: DataFrame, anchors: int) -> DataFrame:
    """``window, chunk, first, offset, term`` of the rarest terms; windows with a term the corpus lacks are left out."""
    terms = distinct.select("window", "chunk", "first", F.posexplode("words").alias("offset", "term"))
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    counts = stored(counts.join(terms.select("term").distinct(), "term"), "term-counts")
    rare = Over.partitionBy("window").orderBy("n", "term", "offset")
    ranked = terms.join(counts, "term", "left").select(
        "*", F.row_number().over(rare).alias("_rank"), F.min(F.coalesce("n", F.lit(0))).over(Over.partitionBy("window")).alias("_least"))
    return stored(ranked.filter((F.col("_rank") <= anchors) & (F.col("_least") > 0)).drop("_rank", "_least", "n"), "anchors")


def candidates(postings: DataFrame, distinct: DataFrame, anchors: int = ANCHORS, slop: int = 0) -> DataFrame:
    """``doc, window, words, starts``: places where the lists of a window's rarest terms intersect (jobs).

    With ``slop``, a list agrees with a start if it has the term within ``slop`` places of its offset.
    """
    rarest = _rarest(postings, distinct, anchors)
    inside = rarest.select("chunk", (F.col("first") + F.col("offset")).alias("at"), "term").distinct()
    # offset-adjusted: where the chunk's first word would stand
    hits = postings.join(inside, "term").select("doc", "chunk", "at", (F.col("pos") - F.col("at")).alias("origin"))
    if slop:
        hits = hits.select("doc", "chunk", "at", F.explode(F.transform(
            F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.col("origin") + d)).alias("origin"))
    met = hits.groupBy("doc", "chunk", "origin").agg(F.collect_set("at").alias("at"))
    wanted = rarest.groupBy("chunk", "window", "first").agg(F.collect_list(F.col("first") + F.col("offset")).alias("need"))
    wanted = stored(wanted.groupBy("chunk").agg(F.collect_list(F.struct("window", "first", "need")).alias("all"),
                                                F.min(F.size("need")).alias("_least")), "wanted")
    whole = F.filter("all", lambda w: F.size(F.array_except(w["need"], F.col("at"))) == 0)
    # most groups hold one chance hit, which no window is content with
    starts = (met.join(wanted, "chunk").filter(F.size("at") >= F.col("_least")).select("doc", "origin", F.explode(whole).alias("w"))
              .groupBy("doc", F.col("w.window").alias("window"))
              .agg(F.collect_set(F.col("origin") + F.col("w.first")).alias("starts")))
    return starts.join(distinct.select("window", "words"), "window")


def _stands(text: Column, start: Column, phrase: Column, slop: int) -> Column:
    if not slop:
        return (start >= 0) & (F.slice(text, F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase)
    around = lambda at: F.slice(text, F.greatest(at - slop, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(
        F.lit(2 * slop + 1), at + slop + 1)))
    return F.forall(F.transform(phrase, lambda term, offset: F.struct(term.alias("term"), (start + offset).alias("at"))),
                    lambda t: F.array_contains(around(t["at"]), t["term"]))


def matches(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, anchors: int = ANCHORS, slop: int = 0,
            key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every document with its matches, and the items of each window (jobs).

    The first: ``key, doc, n_words, spans``, an array of ``window, start, length``; with ``slop`` a span
    is where the phrase would stand if nothing was put in or left out. The second: ``window, item``.
    """
    distinct, items = windows(benchmark, width, item, item_text)
    postings = index(documents, key, text)
    found = candidates(postings, distinct, anchors, slop).groupBy("doc").agg(
        F.collect_list(F.struct("window", "words", "starts")).alias("_found"))
    found = stored(found, "candidates")
    discard(postings)
    docs = documents.select(F.col(key), F.col(text).alias("_t"), _document(key, text).alias("doc"), n_words(F.col(text)).alias("n_words"))
    spans = lambda own: F.flatten(F.transform("_found", lambda c: F.transform(
        F.filter(c["starts"], lambda s: _stands(own, s, c["words"], slop)),
        lambda s: F.struct(c["window"].alias("window"), s.alias("start"), F.size(c["words"]).alias("length")))))
    checked = docs.join(found, "doc", "left").select(
        key, "doc", "n_words", F.when(F.col("_found").isNotNull(), bound(words(F.col("_t")), spans)).alias("spans"))
    return stored(checked.withColumn("spans", F.when(F.size("spans") > 0, F.col("spans"))), "spans"), items


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, anchors: int = ANCHORS,
                  key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every row (jobs)."""
    spans, items = matches(documents, benchmark, width, anchors, 0, key, text, item, item_text)
    hit = spans.filter("spans IS NOT NULL")
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    seen = F.array_distinct(F.transform("spans", lambda s: s["window"]))
    # rows that repeat id and text share `doc`: one of them stands for all
    pairs = hit.dropDuplicates(["doc", key]).select("doc", F.col(key).alias("_key"), F.explode(seen).alias("window"))
    listed = (pairs.join(items, "window").groupBy("doc", "_key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("_items"))
              .withColumnsRenamed({"doc": "_doc"}))
    none = F.array().cast("array<string>")
    out = spans.join(listed, (spans["doc"] == listed["_doc"]) & spans[key].eqNullSafe(listed["_key"]), "left")
    n_hit = F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long")
    listing = F.coalesce("_items", none)
    return out.select(key, "n_words", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
                      F.size(listing).cast("long").alias("n_items"), F.sha2(F.array_join(listing, ","), 256).alias("items_sha256"),
                      F.col("spans").isNotNull().alias("contaminated"))


def contamination_sql(width: int = WIDTH) -> str:
    """The same for DuckDB, by joining all runs of as many words as a window has."""
    listed = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {listed} AS w FROM documents),
        items AS (SELECT item_id, {listed} AS w FROM benchmark),
        cut AS (SELECT item_id, unnest([w[s:s + {width - 1}] FOR s IN range(1, greatest(1, len(w) - {width - 1}) + 1)]) AS phrase
                FROM items WHERE len(w) > 0),
        phrases AS (SELECT DISTINCT item_id, array_to_string(phrase, ' ') AS phrase, len(phrase) AS n FROM cut),
        places AS (SELECT doc, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n),
        hits AS (SELECT doc, s, p.n, item_id FROM places JOIN phrases p ON p.n = places.n AND p.phrase = array_to_string(w[s:s + places.n - 1], ' ')),
        counted AS (SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc),
        listed AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                   FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN counted USING (doc) LEFT JOIN listed USING (doc)"""
