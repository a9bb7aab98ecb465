import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import frame
from llm_fixtures import union_find
from tidefolio.llm import minhash_dedup, packing
from tidefolio.llm.queries import ORACLES, QUERIES, tokenizer_files

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_their_sql_or_return_every_row(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    if name in ORACLES:
        pd.testing.assert_frame_equal(frame(got), frame(db.sql(ORACLES[name]).df()), check_dtype=False, check_exact=True)
        return
    source, key = ("embeddings", "vec_id") if "vec_id" in got.columns else ("documents", "doc_id")
    ids = pq.read_table(f"{SMALL}/{source}.parquet").column(key).to_pylist()
    assert set(got[key]) == set(ids)
    assert name == "op1_packing" or len(got) == len(ids)


def test_near_duplicates_of_the_given_documents(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").sort_by("doc_id")
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    bags = [minhash_dedup.bag(t or "") for t in texts]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if texts[a] == texts[b] or minhash_dedup.overlap(bags[a], bags[b]) >= 0.8]
    heads = union_find(len(ids), links)
    got = {r.doc_id: r.class_id for r in QUERIES["op3_minhash_dedup"](spark, SMALL).collect()}
    assert [got[i] for i in ids] == [ids[h] for h in heads]


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == columns
    given, good, unique, apart, mixed, packed = tables
    text = lambda t: [r.text or "" for r in t.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    want = {}
    for r in good.collect():
        want[r.text or ""] = max(r.doc_id, want.get(r.text or "", -1))
    assert {r.doc_id for r in unique.collect()} == set(want.values()) and len(text(unique)) == len(set(text(good)))
    rows = sorted(unique.collect(), key=lambda r: r.doc_id)
    bags = [minhash_dedup.bag(r.text or "") for r in rows]
    heads = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if minhash_dedup.overlap(bags[a], bags[b]) >= 0.8])
    assert {r.doc_id for r in apart.collect()} == {rows[h].doc_id for h in heads}
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in apart.collect()}
    tokenizer = packing.Encoder(*tokenizer_files())
    tokens = sum(len(tokenizer.encode(t)) // 4 + 1 for t in text(mixed))
    assert sum(r.length for r in packed.collect()) == tokens


def test_stages_on_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            rows = [(r.doc_id, r.text or "") for r in out.collect()]
            if "copies" in stage.__name__:
                assert len(rows) == len(set(rows)) > 0 or docs is no_documents
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_the_pipeline_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
