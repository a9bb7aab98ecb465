"""Exact duplicates by deterministic block naming; DataFrame operations only.

Equal texts are found by naming, never by a digest. A first round names each pair of
(byte length, first block): a document alone under its name, or no longer than one
block, has its identity at once. All other texts are cut into blocks of
``block_bytes``; the distinct blocks are sorted and numbered, and then pairs of adjacent
names are named again and again until one name is left of each document. Length and
last name together are equal exactly for equal texts, as a name stands for one pair.

Scale: a document crosses the network once with its text, blocks of the open ones once
or twice more. Names come from a partially combined ``distinct``, so a group of copies
sends one row per task; names go back by a join that AQE can split on hot names.

Defined results: a null text is the empty text. Rows that repeat id and text are copies of
each other and share ``kept``; of rows with null ids the group's largest id stays, and if
all ids are null, ``keep_id`` is null and the rows are kept. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.common import named, stored

BLOCK_BYTES = 1024
HEAD_BYTES = 256


def identities(documents: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
               head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``key, text_sha256, n_bytes, kind, name``: equal (n_bytes, kind, name) exactly for equal texts; starts jobs."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = documents.select(F.col(key), content.alias("_b"))
    docs = docs.select(key, "_b", F.octet_length("_b").alias("n_bytes"), F.substring("_b", 1, head_bytes).alias("_head"))

    # sorted names of (length, first block), with the number of documents under each
    heads = (docs.groupBy("n_bytes", "_head").agg(F.count("*").alias("_rows"))
             .sortWithinPartitions("n_bytes", "_head").withColumn("name", F.monotonically_increasing_id()))
    heads = stored(heads, "heads")
    is_open = (F.col("_rows") > 1) & (F.col("n_bytes") > head_bytes)
    first = stored(docs.join(heads, ["n_bytes", "_head"]).select(
        F.monotonically_increasing_id().alias("_row"), key, F.sha2("_b", 256).alias("text_sha256"), "n_bytes", "name",
        F.when(is_open, F.col("_b")).alias("_open")), "opened")
    done = [first.filter("_open IS NULL").select(key, "text_sha256", "n_bytes", F.lit(0).alias("kind"), "name")]

    opened = first.filter("_open IS NOT NULL")
    longest = opened.agg(F.max("n_bytes")).first()[0] or 0
    blocks = opened.select("_row", F.col("n_bytes"), "_open", F.explode(
        F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / block_bytes).cast("int"))).alias("_pos"))
    blocks = blocks.select("_row", F.ceil(F.col("n_bytes") / block_bytes).alias("_left"), "_pos", F.substring(
        F.col("_open"), F.col("_pos") * block_bytes + 1, F.lit(block_bytes)).alias("_block"))
    names = blocks.join(named(blocks, ["_block"], "blocks"), "_block").select("_row", "_left", "_pos", "name")
    whole, left = [], -(-longest // block_bytes)
    while longest:
        names = stored(names, "names")
        whole.append(names.filter("_left = 1").select("_row", "name"))
        if left <= 1:
            break
        even = F.col("_pos") % 2 == 0
        pairs = (names.filter("_left > 1")
                 .groupBy("_row", ((F.col("_left") + 1) / 2).cast("long").alias("_left"),
                          (F.col("_pos") / 2).cast("int").alias("_pos"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("_a"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("_b")))
        names = pairs.join(named(pairs, ["_a", "_b"], "pairs"), ["_a", "_b"]).select("_row", "_left", "_pos", "name")
        left = -(-left // 2)
    if whole:
        last = reduce(DataFrame.unionByName, whole)
        done.append(opened.drop("name").join(last, "_row")
                    .select(key, "text_sha256", "n_bytes", F.lit(1).alias("kind"), "name"))
    return reduce(DataFrame.unionByName, done)


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
          head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row: of equal texts the largest id stays."""
    found = stored(identities(documents, key, text, block_bytes, head_bytes), "identities")
    identity = ["n_bytes", "kind", "name"]
    groups = found.groupBy(*identity).agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    return found.join(groups, identity).select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


DEDUP_SQL = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
