import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import prose, sha, union_find
from tidefolio.llm import embedding_dedup, exact_dedup, minhash_dedup, suffix_dedup
from tidefolio.llm.components import components
from tidefolio.llm.induced import sorted_buckets


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 202), (202, 200)]
    links.append((5, 5))
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block,head", [(8, 4), (16, 16), (1024, 256)])
def test_exact_dedup_equals_grouping_by_text(spark, block, head):
    texts = [prose(i % 7, 40) for i in range(20)] + ["x" * n for n in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64)] * 2
    texts += [prose(1, 40)[:-1] + "!", "!" + prose(1, 40)[1:], None, "", "é" * 9, "é" * 9]
    got = exact_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4),
                            block_bytes=block, head_bytes=head).collect()
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), sha(t)) for t, g in same.items() for i in g}
    assert {tuple(r) for r in got} == want and len(got) == len(texts)


def test_exact_dedup_of_odd_rows(odd_documents, no_documents):
    got = exact_dedup.dedup(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].keep_id == 2 and not by_id[1].kept and by_id[2].kept
    assert by_id[5].keep_id == 5 and by_id[4].keep_id == 5 and by_id[4].group_size == 3  # "", null, and null of a null id
    assert by_id[7].group_size == 2 and by_id[7].kept
    assert [r.kept for r in got if r.doc_id is None and r.text_sha256 == sha(prose(3, 50))] == [True]
    assert exact_dedup.dedup(no_documents).count() == 0


def near_classes(texts):
    bags = [minhash_dedup.bag(t or "") for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a)
             if (texts[a] or "") == (texts[b] or "") or minhash_dedup.overlap(bags[a], bags[b]) >= 0.8]
    return union_find(len(texts), links)


def test_minhash_dedup_equals_comparing_all_pairs(spark):
    texts = []
    for i in range(30):
        words = prose(i, 120).split()
        texts.append(" ".join(words))
        for j in range(i % 4):
            changed = list(words)
            for k in range(1 + 2 * j):
                changed[(17 * i + 41 * k) % 120] = f"w{i}x{j}x{k}"
            texts.append(" ".join(changed))
    texts += ["the same line " * 40, "the same line " * 45, "the same line " * 80, "a b", "a b", "a c", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(rows).collect()}
    want = near_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(r.kept == (r.class_id == i) and r.class_size == want.count(r.class_id) for i, r in got.items())


@pytest.mark.parametrize("turned", [False, True])
def test_texts_that_share_an_id_are_judged_by_themselves(spark, turned):
    """Ids 5 and 5: one text is near that of 3, the other near that of 7; neither order of rows mixes them up."""
    near = lambda text: " ".join([*text.split()[:-1], "other"])
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(3, a), (5, near(a)), (5, b), (7, near(b)), (5, c), (9, c)]
    rows = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256): (r.class_id, r.class_size, r.kept) for r in minhash_dedup.near_duplicates(rows).collect()}
    assert got == {(3, sha(a)): (3, 2, True), (5, sha(near(a))): (3, 2, False), (5, sha(b)): (5, 2, True), (7, sha(near(b))): (5, 2, False),
                   (5, sha(c)): (5, 2, True), (9, sha(c)): (5, 2, False)}


def test_very_long_near_copies_are_compared_in_bounded_memory(spark):
    long = prose(4, 150_000)
    rows = spark.createDataFrame([(i, long + f" end {i}") for i in range(6)] + [(9, prose(8, 150_000))], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(rows, tile_rows=2).collect()} == {**dict.fromkeys(range(6), 0), 9: 9}
    held = minhash_dedup.Bags(5, most=200_000)
    for i in range(4):
        held.of(i, long)
    assert len(held.known) == 1 and minhash_dedup.likeness(held.of(3, long), held.of(3, long)) == 1.0


def test_buckets_with_several_classes_are_compared_across(spark):
    """A chain: neighbours are near, the ends are not, and the smallest id is at one end."""
    words = prose(5, 200).split()
    texts = []
    for i in range(8):
        words = [f"n{i}w{k}" if 12 * i <= k < 12 * i + 9 else w for k, w in enumerate(words)]
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(rows, tile_rows=2).collect()}
    assert [got[i] for i in range(len(texts))] == near_classes(texts)


def test_minhash_dedup_of_odd_rows(odd_documents, no_documents):
    got = minhash_dedup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[2].class_id == by_id[3].class_id == 1 and by_id[9].class_id == 8 and by_id[5].class_id == 4
    assert by_id[6].class_id == 6  # no words: near to equal texts only
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash_dedup.near_duplicates(no_documents).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    one, two = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    x = [(elements[c > 0], c[c > 0], np.full((c > 0).sum(), i)) for i, c in enumerate((one, two))]
    times = minhash_dedup.signatures(*(np.concatenate([a[k] for a in x]) for k in range(3)), 2, size=4096)
    assert abs((times[0] == times[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)
    alone = minhash_dedup.signatures(*x[1][:2], np.zeros(len(x[1][0]), int), 1, size=4096)
    assert (alone[0] == times[1]).all()  # whatever else is in the batch


def vectors_and_links(vectors, labels, threshold):
    n = len(vectors)
    links = []
    for a in range(n):
        for b in range(a):
            x, y = np.array(vectors[a], float), np.array(vectors[b], float)
            if labels[a] == labels[b] and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((a, b))
    return links


@pytest.mark.parametrize("tile", [2000, 5])
def test_embedding_dedup_equals_comparing_all_pairs(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    vectors = [(base[i % 12] + 0.1 * (i % 5) * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(150)]
    vectors[20] = vectors[32] = vectors[44]
    labels = [i % 12 % 3 for i in range(150)]
    links = vectors_and_links(vectors, labels, 0.93)
    assert 50 < len(links) < 2000
    rows = spark.createDataFrame([(i, v, k, "x") for i, (v, k) in enumerate(zip(vectors, labels))],
                                 "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(rows, tile_rows=tile).collect()}
    degree = np.bincount(np.array(links).ravel(), minlength=150)
    heads = union_find(150, links)
    assert [got[i].n_links for i in range(150)] == degree.tolist()
    assert [got[i].component_id for i in range(150)] == heads
    assert all(got[i].kept == (heads[i] == i) for i in range(150))


def test_embedding_dedup_of_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1),
            (7, [1.0, None, 2.0], 1), (8, [1.0, float("nan"), 0.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (None, v, 1),
            (10, [1.0, 0.0], 1), (11, v, 2), (12, [2.0, 0.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, True),
            *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_induced_order_and_shared_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        depth, letters = int(rng.integers(2, 12)), int(rng.integers(1, 5))
        parts = [rng.integers(1, letters + 1, rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        symbols = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        padded = symbols.tolist() + [0] * 60
        got = [(p, s) for places, shared in list(sorted_buckets(symbols, depth, memory=20))[::-1]
               for p, s in zip(places.tolist(), shared.tolist())]
        assert sorted(p for p, _ in got) == [i for i, x in enumerate(symbols) if x]
        for (a, _), (b, shared) in zip(got, got[1:]):
            x, y = padded[a:a + depth], padded[b:b + depth]
            assert x <= y and shared == next((i for i in range(depth) if x[i] != y[i]), depth)


def removed(texts, window):
    first, out = {}, {}
    for i, t in sorted(enumerate(texts), key=lambda x: x[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            first.setdefault(raw[k:k + window], i)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - window + 1):
            if first[raw[k:k + window]] < i:
                gone[k:k + window] = True
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [200_000, 3])
def test_suffix_dedup_equals_brute_force(spark, hot):
    passages = [prose(50 + i, 12) for i in range(5)]
    texts = [prose(i, 30) + " " + passages[i % 5] + (" " + passages[(i + 2) % 5] if i % 3 else "") + prose(i + 90, 10)
             for i in range(40)]
    texts += [texts[3], texts[3][10:200], "-" * 300, "-" * 120 + "x" + "-" * 80, "ab" * 100, None, "", "é" * 60, "zé" * 60,
              "q\0" * 40, passages[0][:49], passages[0][:50], "\0" * 200, "\0" * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(rows, shard_bytes=2000, hot_segments=hot, filter_bits=12).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == removed(texts, 50)


def test_suffix_dedup_of_odd_rows(odd_documents, no_documents):
    got = suffix_dedup.remove_repeats(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == by_id[2].n_bytes and by_id[3].n_spans == 1
    assert by_id[9].n_removed == by_id[8].n_bytes and by_id[8].n_removed == 0 and by_id[11].n_removed == 0
    assert by_id[4].n_bytes == 0 and by_id[4].kept_sha256 == sha("")
    assert suffix_dedup.remove_repeats(no_documents).count() == 0
    kept = suffix_dedup.remove_repeats(odd_documents, keep_text=True).filter(F.col("doc_id") == 3).first()
    assert hashlib.sha256(kept.kept_text).hexdigest() == kept.kept_sha256
