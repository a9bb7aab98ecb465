"""A training corpus out of ``documents``: five stages, each a Parquet table for the next.

Low quality goes, copies go, near copies go, documents repeat until the token shares of the
languages meet their targets, and what is left is tokenised and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from tidefolio.llm.common import table
from tidefolio.llm.queries import TARGETS, tokenizer_files
from tidefolio.storage import new_path

# SQL cannot express trained classifiers, MinHash, fitted rates or a tokenizer; tests compare with brute force.
ORACLE_SQL = None
# A document takes part in the mixture at most so often, even if its language stays short.
EPOCHS = 4.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; each row is judged by itself."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), *quality.site_of(docs["source"], docs["lang"]))


def _chosen(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (id, text) is kept by ``decisions``, once each.

    The text takes part by its sha256, since rows may share an id; nulls equal each other.
    """
    kept = decisions.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.col("doc_id").alias("_key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    same = rows["_key"].eqNullSafe(kept["_id"]) & (rows["_text"] == kept["_sha"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_key", "_text"]).select("_doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, in one row."""
    return _chosen(docs, exact_dedup.dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return _chosen(docs, minhash_dedup.near_duplicates(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the targets are met; none is dropped, so the budget is what the scarcest domain needs."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), TARGETS, budget=0, least=1.0, most=EPOCHS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, *tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
