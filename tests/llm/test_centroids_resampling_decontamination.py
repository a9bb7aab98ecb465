import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from llm_fixtures import prose
from tidefolio.llm import asciiwords, centroids, decontamination, radix, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


ODD_TEXTS = [None, "", " ", "one", " Lead", "tail ", "a-b_c9D É日本 x\x00y\x7fz", "ÀB'c\U0001F642d", "\n\n", "x" * 50_000, "A B   c"]


def test_words_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, text string")
    got = {r.i: r for r in rows.select("i", asciiwords.words(F.col("text")).alias("w"), asciiwords.n_words(F.col("text")).alias("n")).collect()}
    assert [got[i].w for i in range(len(ODD_TEXTS))] == [words(t) for t in ODD_TEXTS]
    assert [got[i].n for i in range(len(ODD_TEXTS))] == [len(words(t)) for t in ODD_TEXTS]


# --- centroids

def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    seeds = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(seeds))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        for n, members in own.items():
            seeds[n] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *near(q)) for i, q in kept]
    total = Counter()
    for _, d, n in found:
        total[n] += d
    return Counter((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, seeds[n])).encode()).hexdigest()) for i, d, n in found)


def clusters(spark, rows, k, rounds, size):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, distance string, cluster int")
    return Counter(tuple(r) for r in centroids.cluster(df.repartition(3), k, rounds, size=size).collect())


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 1, 8)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (400, None), (401, []), (402, [1.0] * 7), (403, [None] + [1.0] * 7),
             (404, [float("nan")] * 8), (405, [float("inf")] + [0.0] * 7), (406, [-0.0] * 8), (407, [-1e-9] * 8)]
    assert clusters(spark, rows, 5, 3, 8) == brute_clusters(rows, 5, 3, 8)
    same = [(i, [0.5] * 8) for i in range(20)]  # ties: all in cluster 0, the others stay where they are
    assert clusters(spark, same, 3, 2, 8) == brute_clusters(same, 3, 2, 8)
    few = rows[:3]
    assert clusters(spark, few, 5, 3, 8) == brute_clusters(few, 5, 3, 8) and clusters(spark, [(1, None)], 5, 3, 8) == Counter()
    with pytest.raises(PySparkException, match="too large"):
        clusters(spark, [(1, [3e9] * 8)], 2, 1, 8)


# --- radix sort and resampling

def test_radix_ranks_equal_sorting(spark):
    rng = np.random.default_rng(5)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 4, 500), rng.integers(-2**63, 2**63 - 1, 500))]
    keys += [(-2**63, 2**63 - 1), (2**63 - 1, -2**63), (0, 0), (0, -1)]
    rows = spark.createDataFrame(keys, "a long, b long").repartition(5)
    got = radix.ranked(rows, [F.col("a"), F.col("b")], digit_bits=8, block_bits=5).orderBy("rank").collect()
    assert [(r.a, r.b) for r in got] == sorted(keys) and [r["rank"] for r in got] == list(range(1, len(keys) + 1))
    same = radix.ranked(spark.range(70).repartition(3), [F.lit(4)], block_bits=3)
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 71))
    assert radix.ranked(rows.limit(0), [F.col("a")]).count() == 0


def brute_resample(docs, target, percent, least, buckets):
    def features(text):
        w = words(text)
        runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return [zlib.crc32(r.encode()) % buckets for r in runs]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[:percent * len(eligible) // 100]):
        r[5] = place + 1
    return rows


def test_resampling_equals_a_plain_version(spark):
    docs = [(i, prose(i, 5 + i % 60) + (" ÉTÉ Zephyr-amber" if i % 3 else "")) for i in range(200)]
    docs += [(-5, prose(2, 40)), (3, prose(3, 44)), (None, prose(4, 40)), (900, None), (901, ""), (902, "one"), (903, prose(9, 20_000)), (904, "é " * 25)]
    target = [prose(1, 300), prose(77, 200), None, "", "amber"]
    rows = spark.createDataFrame([(i, t, 1.5, "r") for i, t in docs], "doc_id long, text string, score double, rank string").repartition(4)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(rows, wanted, percent=30, least_words=20, buckets=500).collect()
    plain = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    assert plain(got) == plain(brute_resample(docs, target, 30, 20, 500))
    none = resampling.resample(rows, wanted.limit(0), buckets=500).collect()
    assert plain(none) == plain(brute_resample(docs, [], 25, 20, 500))
    assert resampling.resample(rows.limit(0), wanted).count() == 0


# --- decontamination

def brute_windows(items, width):
    found = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            found.setdefault(tuple(w[s:s + width]), set()).add(i)
    return found


def brute_contamination(docs, items, width):
    windows = brute_windows(items, width)
    out = []
    for i, text in docs:
        w, hit, own = words(text), set(), set()
        for phrase, ids in windows.items():
            for s in range(len(w) - len(phrase) + 1):
                if tuple(w[s:s + len(phrase)]) == phrase:
                    hit.update(range(s, s + len(phrase)))
                    own |= ids - {None}
        listed = ",".join(sorted(map(str, own)))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, term string, n_words int").repartition(4),
            spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, window string"))


def contaminated_corpus():
    items = [(i, prose(1000 + i, 12 + 3 * i)) for i in range(12)] + [(50, "Solo"), (51, "two words"), (52, None), (53, " .. "), (54, "the " * 30),
             (55, prose(1003, 21)), (5, prose(1500, 15)), (None, prose(1600, 14)), (56, prose(1700, 700)), (57, "ÉTÉ à la Plage")]
    docs = [(i, prose(i, 30) + " " + prose(1000 + i % 12, 12 + i % 9).upper() + "! " + prose(i + 1, 20)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "solo"), (103, "x solo, SOLO"), (104, "two\nwords two words"), (105, "the " * 300), (106, prose(1700, 700)),
             (107, "- " + prose(1500, 15)), (3, prose(1600, 14)), (3, "the " * 9), (3, "the " * 9), (None, prose(1002, 18)), (None, "été à la plage"),
             (108, "été à la plage"), (109, " ".join(prose(1004, 24).split()[::-1])), (110, " ".join(["pad"] * 5000 + [prose(1001, 15)] + ["pad"] * 5000))]
    return docs, items


@pytest.mark.parametrize("width,anchors", [(10, 2), (3, 1), (10, 4)])
def test_contamination_equals_a_plain_version(spark, width, anchors):
    docs, items = contaminated_corpus()
    got = decontamination.contamination(*tables(spark, docs, items), width=width, anchors=anchors).collect()
    assert sorted(map(tuple, got), key=repr) == brute_contamination(docs, items, width)


def test_proximity_matches_allow_words_put_in_or_left_out(spark):
    passage = prose(1000, 10).split()
    docs = [(1, " ".join(passage)), (2, " ".join(passage[:5] + ["inserted"] + passage[5:])), (3, " ".join(passage[:4] + ["two", "more", "put", "in"] + passage[4:])),
            (4, " ".join(passage[:-1])), (5, " ".join(passage[1:] + passage[:1])), (6, "")]
    spans, items = decontamination.matches(*tables(spark, docs, [(9, " ".join(passage))]), slop=1)
    got = {r.doc_id: r.spans for r in spans.collect()}

    def near(text):
        w = words(text)
        return [s for s in range(-1, len(w)) if all(any(0 <= p < len(w) and w[p] == term for p in range(s + o - 1, s + o + 2)) for o, term in enumerate(passage))]
    assert {i: sorted(s.start for s in got[i] or []) for i, _ in docs} == {i: near(t) for i, t in docs}
    assert got[2] and not got[3] and [r.item for r in items.collect()] == [9]


def test_contamination_of_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, prose(1, 60)), (2, None)], "item_id long, text string")
    got = decontamination.contamination(odd_documents, items).collect()
    assert len(got) == odd_documents.count() and {r.doc_id for r in got if r.contaminated} == {1, 2, 3}
    assert decontamination.contamination(no_documents, items).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(odd_documents, items.limit(0)).collect())
