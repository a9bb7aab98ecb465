import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import prose
from tidefolio.llm import charlm, language_id, quality, toxicity, url_filter
from tidefolio.llm.common import crc_of_id
from tidefolio.llm.words import shingle_hashes, text_bytes, word_hashes

GERMAN = "der die das und ist nicht mit für auf schön größe über wasser straße gehen haben wir sie es ein".split()
ENGLISH = "the of and to in that it is was for with as his they be at one have this from word".split()


def line(words, seed, n=30):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


def test_kneser_ney_sums_to_one_and_matches_a_direct_version():
    texts = [line(ENGLISH, i) for i in range(5)]
    keys, counts = charlm.counted(language_id.text_grams(texts))
    model = charlm.KneserNey(keys, counts)
    contexts = list({int(k) >> 6 for k in keys[:40]}) + [0o777777]
    for c in contexts:
        assert abs(model.probability(np.arange(64) + c * 64).sum() - 1) < 1e-9
    # the direct version
    grams = {tuple(int(k) >> s & 63 for s in (18, 12, 6, 0)): int(n) for k, n in zip(keys, counts)}
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    cut = {n: charlm.discount(np.array(list(t.values()))) for n, t in levels.items()}

    def p(context, symbol):
        n = len(context) + 1
        lower = p(context[1:], symbol) if n > 1 else 1 / 64
        own = {g: c for g, c in levels[n].items() if g[:-1] == context}
        total = sum(own.values())
        if not total:
            return lower
        return max(own.get(context + (symbol,), 0) - cut[n], 0) / total + cut[n] * len(own) / total * lower
    for g in list(grams)[:30] + [(1, 2, 3, 4), (20, 8, 5, 0), (40, 41, 42, 43)]:
        key = sum(x << s for x, s in zip(g, (18, 12, 6, 0)))
        assert model.probability(np.array([key]))[0] == pytest.approx(p(g[:-1], g[-1]), rel=1e-9)
    both = charlm.Models([model, charlm.KneserNey(*charlm.counted(language_id.text_grams([line(GERMAN, 1)])))])
    some = np.random.default_rng(0).integers(0, 1 << 24, 500).astype(np.uint32)
    assert np.allclose(both.log_probabilities(some)[:, 0], np.log(model.probability(some)), atol=1e-4)


def test_symbols_keep_texts_apart():
    code, begin, end = charlm.symbols(["Ab  c!", "", "é1", "  x"])
    parts = [code[a:b].tolist() for a, b in zip(begin, end)]
    # a run of others counts once, also the one that a text begins with after the break before it
    assert parts == [[1, 2, 0, 3, 0], [], [28 + ord("é") % 36, 27], [24]]
    assert all(code[a - 3:a].tolist() == [0, 0, 0] for a in begin)


def test_language_id_on_held_out_rows(spark):
    rows = [(i, line(GERMAN if i % 2 else ENGLISH, i), "de" if i % 2 else "en", "x") for i in range(120)]
    rows += [(500, None, "en", "x"), (501, "", "de", "x"), (502, "123 !!", "de", "x"), (503, line(GERMAN, 7), None, "x"),
             (504, line(ENGLISH, 9) * 500, "fr", "x"), (None, line(ENGLISH, 3), "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    held = (crc_of_id(F.col("doc_id")) % 3 == 1) | (F.col("lang") == "fr")
    held = F.coalesce(held, F.lit(False))
    got = {r.doc_id: r for r in language_id.identify(docs, ~held, held).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") and 0 < got[i].score <= 1 for i in range(120))
    assert [got[i].lang_pred for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "de", "en"]
    assert got[500].score == 0 and not got[None].held_out and got[None].lang_pred == "en"
    # nothing in a language that was not learned, and nothing without letters, is accepted; what was learned is
    assert all(got[i].rejected for i in (500, 501, 502)) and sum(got[i].rejected for i in range(120)) <= 2
    alien = spark.createDataFrame([(1, "zzz qqq xxw wqx " * 30, "x"), (2, "\u0301\u0302 \u0303", "x")], "doc_id long, text string, lang string")
    far = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(alien.withColumn("doc_id", F.col("doc_id") + 7000)),
                               F.col("doc_id") < 500, F.lit(False))
    found = {r.doc_id: r for r in far.collect()}
    assert found[7001].rejected and (found[7002].lang_pred, found[7002].score) == ("und", 0.0)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    strict = language_id.identify(docs, ~held, held, reject=1.01)
    assert {r.lang_pred for r in strict.collect()} == {"und"}


def test_language_id_without_anything_to_learn(spark, odd_documents, no_documents):
    nothing = language_id.identify(odd_documents, F.lit(False), F.lit(True)).collect()
    assert len(nothing) == odd_documents.count() and {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(no_documents, F.lit(True), F.lit(False)).count() == 0
    assert language_id.identify(odd_documents, F.lit(True), F.lit(False)).count() == odd_documents.count()


def toxic_docs():
    insults = ["idiot", "moron", "stupid"]
    rows = [(i, prose(i, 60) + (f" {insults[i % 3]} " if i % 4 == 0 else " calm ") + prose(i + 999, 20)) for i in range(400)]
    return rows, [(i, int(i % 4 == 0)) for i, _ in rows]


def test_toxicity_sees_through_disguises(spark):
    rows, labels = toxic_docs()
    disguised = ["1d10t", "m0r0n", "s t u p i d", "i.d.i.o.t", "mooooron", "$tup1d", "IDIOT!!", "s-t-u-p-i-d", "m o r o n"]
    clean = ["window 7", "a b c", "route 66 x2", "harbor-island", "v1.0.2", "1,000", ""]
    probes = [(1000 + k, prose(k, 40) + f" {w} " + prose(k + 5, 30)) for k, w in enumerate(disguised + clean)]
    docs = spark.createDataFrame(rows + probes + [(2000, None), (2001, ""), (2002, prose(4, 40_000))],
                                 "doc_id long, text string").repartition(3)
    held = crc_of_id(F.col("doc_id")) % 5 == 0
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held, held).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert [got[1000 + k].predicted for k in range(len(disguised))] == [1] * len(disguised)
    assert [got[1000 + len(disguised) + k].predicted for k in range(len(clean))] == [0] * len(clean)
    assert [got[i].predicted for i in (2000, 2001, 2002)] == [0, 0, 0] and 0 <= got[2001].score < 0.5
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_sees_disguises_at_the_ends_doubled_letters_and_wide_spacing(spark):
    rows, labels = toxic_docs()
    disguised = ["morron", "iidiot", "stuppid", "sttupid", "idio7", "stupi6 idio+", '"1diot', "(1diot)", ",$tupid", "m  o  r  o  n",
                 "s   t   u   p   i   d", "i - d - i - o - t", "$tupid "]
    clean = ["coffee letter", "5 € each", "3€", "room7 (see 8)", "stop! go!", "a  b  c", "covid19", "ready!!"]
    texts = [w + prose(k, 60) if w.endswith(" ") else prose(k, 40) + f" {w} " + prose(k + 5, 30) for k, w in enumerate(disguised + clean)]
    probes = [(1000 + k, text) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    held = crc_of_id(F.col("doc_id")) % 5 == 0
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held, held).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert {w: got[1000 + k].predicted for k, w in enumerate(disguised)} == dict.fromkeys(disguised, 1)
    assert {w: got[1000 + len(disguised) + k].predicted for k, w in enumerate(clean)} == dict.fromkeys(clean, 0)


def test_every_place_of_a_disguise_is_decoded():
    read = []

    class Held:
        def read(self, span):
            read.append(span)
            return "*"
    forms = ["losser", "sccum", "traash", "cloown", "foo1", '"1diot', "los€r", "t  r  a  s  h", "t - r - a - s - h", "$tupid"]
    for text in (forms, [f"we saw {w} today" for w in forms]):
        read.clear()
        assert all("*" in t for t in toxicity.restored(text, Held()))
        assert read == forms


def test_scored_paths_give_the_readings_of_the_search():
    """Lattices with few paths are scored path by path: the same readings as Viterbi search finds."""
    rng = np.random.default_rng(8)
    model = charlm.KneserNey(*charlm.counted(language_id.text_grams([line(ENGLISH, i) for i in range(40)] + [line(GERMAN, 3), "été naïve Öl"])))
    decoder = toxicity.Decoder(charlm.Models([model]))
    spans = ["".join(rng.choice(list("abeelost0113$@.-_ é\U0001F642"), rng.integers(1, 12))) for _ in range(600)] + ["losser", "foo1", "1d10t", "ttthhhee"]
    wanted = [(t, end) for t in (toxicity._EDGE.sub("", s.lower()) for s in spans) if any(c.isalpha() for c in t) for end in (False, True)]
    few = [w for w in wanted if toxicity._paths(*w) is not None]
    assert 0.5 * len(wanted) < len(few) < len(wanted)
    scores = lambda reading, w: dict(toxicity._paths(*w))[reading]
    for w, reading in decoder.decode_all(wanted).items():
        other = decoder._decode(*w)
        if reading != other:  # only where both are equally likely
            total = [float(decoder._scores([r])[0]) - scores(r, w) for r in (reading, other)]
            assert total[0] == pytest.approx(total[1], abs=1e-6), (w, reading, other)
    decoder.prepare(spans)
    assert all(decoder.read(s) == toxicity.Decoder(decoder.models).read(s) for s in spans[:40])


def test_strengths_are_those_of_single_counts():
    table = {f"w{i}": (1 + i % 7, i % 5) for i in range(60)}
    evidence = toxicity.Evidence(table, 30, 90)

    def lower(a, b):
        n, z = a + b, toxicity.CERTAINTY
        if a <= 0:
            return 0.0
        p = a / n
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return max(0.0, np.log(low / (1 - low)) - np.log(30 / 90)) if low > 0 else 0.0
    for word, (a, b) in table.items():
        assert evidence.of(word) == pytest.approx(lower(a, b)) and evidence.of(word, 1) == pytest.approx(lower(a - 1, b))
        if b:
            assert evidence.of(word, 0) == pytest.approx(lower(a, b - 1))
    assert sorted(evidence.strengths({"w3", "w6", "zzz"}, None)) == sorted(e for e in map(evidence.of, ("w3", "w6")) if e > 0)


def test_toxicity_ignores_columns_with_inner_names(spark, odd_documents, odd_labels):
    more = odd_documents.withColumns({c: F.lit("x") for c in ("_y", "_id", "_t", "_learned", "_held", "score", "toxic")})
    plain = toxicity.score(odd_documents, odd_labels, F.lit(True), F.lit(False)).collect()
    assert sorted(map(tuple, toxicity.score(more, odd_labels, F.lit(True), F.lit(False)).collect()), key=repr) == sorted(map(tuple, plain), key=repr)


def test_toxicity_of_odd_rows(odd_documents, no_documents, odd_labels, no_labels):
    every, none = F.lit(True), F.lit(False)
    assert toxicity.score(odd_documents, odd_labels, every, none).count() == odd_documents.count()
    assert {r.score for r in toxicity.score(odd_documents, no_labels, every, none).collect()} == {0.0}
    assert toxicity.score(no_documents, odd_labels, every, none).count() == 0


def junk(i):
    kinds = [prose(i, 30).upper().replace(" ", "!! "), "amber " * 60, " | ".join(prose(i, 30).split()), prose(i, 40).replace(" ", "### ")]
    return kinds[i % 4]


def posteriors_by_hand(sites, evidence):
    """Path means without the row itself, shrunk toward the host, shrunk toward all; strengths by the method of moments."""
    def strength(groups, parents):
        n = np.array([len(g) for g in groups])
        if n.sum() <= len(n) or len(n) < 2:
            return 10.0
        within = max(sum(((g - g.mean()) ** 2).sum() for g in groups) / (n.sum() - len(n)), 1e-9)
        between = sum(len(g) * (g.mean() - p) ** 2 for g, p in zip(groups, parents)) - (len(n) - 1) * within
        between = max(between / (n.sum() - (n * n).sum() / n.sum()), 1e-9)
        return min(max(within / between, 1.0), 1e6)

    def grouped(key):
        held = {}
        for i, site in sites.items():
            held.setdefault(key(site), []).append(evidence[i])
        return {k: np.array(v) for k, v in held.items()}
    hosts, paths = grouped(lambda s: s[0]), grouped(lambda s: s)
    mean = np.mean(list(evidence.values()))
    strong = strength(list(hosts.values()), [mean] * len(hosts))
    above = {h: (g.sum() + strong * mean) / (len(g) + strong) for h, g in hosts.items()}
    below = strength(list(paths.values()), [above[s[0]] for s in paths])
    logit = lambda p: np.log(p / (1 - p))
    out = {}
    for i, s in sites.items():
        path = (paths[s].sum() - evidence[i] + below * above[s[0]]) / (len(paths[s]) - 1 + below)
        out[i] = above[s[0]], path, 1 / (1 + np.exp(-(logit(evidence[i]) - logit(mean) + logit(path))))
    return out


def test_quality_keeps_clean_documents_and_shrinks_sparse_sites(spark):
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 50 + i % 40) + ".", "en", f"h{i % 3}/p{i % 2}") for i in range(400)]
    rows += [(900 + i, junk(i), "en", "bad") for i in range(40)] + [(990, prose(7, 70) + ".", "en", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # a third of the rows: 0, 15, 30 and 45 show each kind of junk
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    site = quality.site_of(docs["source"], docs["lang"])
    got = {r.doc_id: r for r in quality.classify(docs, labels, *site).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (i % 5 > 0) for i in range(400)) and got[990].kept
    assert not any(got[900 + i].kept for i in range(40))
    evidence = {i: r.evidence for i, r in got.items()}
    bad = [evidence[900 + i] for i in range(40)]
    for i, (host, path, value) in posteriors_by_hand({r[0]: (r[3].split("/")[0], r[3]) for r in rows}, evidence).items():
        assert (got[i].host_posterior, got[i].path_posterior, got[i].score) == pytest.approx((host, path, value), abs=1e-9)
    assert got[900].path_posterior < 0.3 < got[990].path_posterior
    assert min(bad) <= got[900].host_posterior + 0.1
    kept = quality.accepted(docs, labels, *site)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_quality_of_odd_rows(odd_documents, no_documents, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        site = quality.site_of(odd_documents["source"], odd_documents["lang"])
        got = quality.classify(odd_documents, labels, *site)
        assert got.count() == odd_documents.count()
        assert quality.accepted(odd_documents, labels, *site).columns == odd_documents.columns
    assert all(r.kept for r in quality.classify(odd_documents, no_labels, *site).collect())
    assert quality.classify(no_documents, odd_labels, *quality.site_of(no_documents["source"], no_documents["lang"])).count() == 0


def test_word_and_shingle_hashes_tell_words_apart():
    import pyarrow as pa
    texts = ["one two  three\nfour five six", "", None, "two", "one two three four five six", "é é é é é é"]
    words, bounds = word_hashes(*text_bytes(pa.array(texts)))
    assert np.diff(bounds).tolist() == [6, 0, 0, 1, 6, 6]
    assert (words[:6] == words[7:13]).all() and words[6] == words[1] and len(set(words[:6].tolist())) == 6
    shingles, text = shingle_hashes(words, bounds, 5)
    assert np.bincount(text, minlength=6).tolist() == [2, 0, 0, 1, 2, 2]
    assert (shingles[:2] == shingles[3:5]).all() and shingles[5] == shingles[6]


def brute_url(url, rules, words):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    hit = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low) is not None
    strict, soft = sum(map(hit, words.strict)), sum(w for t, w in words.soft.items() if hit(t))
    verdict = best.verdict if best else "block" if strict or soft >= words.soft_limit else "allow"
    return host, path, best.text if best else None, verdict, strict, soft


def test_url_filter_equals_a_plain_version(spark):
    rules = [url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]
    words = url_filter.Vocabulary()
    urls = [None, "", "no scheme/sex", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/a", "http://x.net/es/q",
            "http://x.net/ES/q", "http://x.org/free-porn", "http://essex.org/", "http://x.org/sex/adult", "http://x.org/sex/sex",
            "http://x.org/xxx", "http://x.org/axxx", "http://a.org?u=http://b.com/", "http://notcom/", "http://com/", "ü://ÄB.org/Ö",
            "http://x.org/hot_girls", "http://x.org/POKER?casino", "http://x.org/" + "a" * 100_000 + "/milf", "x://a\nb/c\nd?e"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[8], "x")],
                                  "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, rules, words).collect()}
    assert got == {**{i: brute_url(u, rules, words) for i, u in enumerate(urls)}, None: brute_url(urls[8], rules, words)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, (), url_filter.Vocabulary((), {})).collect()} == {"allow"}
