"""URL filter: host rules first, then a weighted vocabulary found with Aho-Corasick.

A term counts only between boundaries (no ASCII letter or digit on either side), so
"essex" holds no "sex". One strict term rejects; soft terms reject when the summed
weights of the *distinct* soft terms reach ``soft_limit``.

Defined results: a null URL, or one without ``://``, has empty host and path; a null URL
holds no term and is allowed. Repeated rows are judged one by one. Other columns of the
input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary.
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "sexcam", "escorts",
          "gangbang", "blowjob", "bukkake")
SOFT = {"sex": 1.0, "sexy": 1.0, "nude": 1.0, "nudes": 1.0, "naked": 1.0, "adult": 1.0, "erotic": 1.0, "fetish": 1.0,
        "webcam": 1.0, "dating": 1.0, "hot": 1.0, "girls": 1.0, "casino": 1.0, "poker": 1.0, "betting": 1.0,
        "jackpot": 1.0, "slots": 1.0, "viagra": 1.0, "cialis": 1.0, "warez": 1.0, "torrent": 1.0, "keygen": 1.0}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    strict: Sequence[str] = STRICT
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = 2.0


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return (ascii_lower(F.regexp_extract(text, r"://([^/?#]*)", 1)),
            F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else nulls; of equal length a block goes first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text).otherwise(text)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def automaton(words: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in words.soft.items():
        found.add_word(term, (term, float(weight)))
    for term in words.strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def count_terms(text: str, found: ahocorasick.Automaton) -> tuple[int, float]:
    """Number of distinct strict terms and summed weight of distinct soft terms in lower-cased ``text``."""
    strict, soft, last = set(), {}, len(text) - 1
    inside = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    for end, (term, weight) in found.iter(text):
        start = end - len(term) + 1
        if (start and inside(text[start - 1])) or (end < last and inside(text[end + 1])):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), sum(soft.values())


def judge(pages: DataFrame, rules: Sequence[Rule] = (), words: Vocabulary | None = None, key: str = "page_id",
          url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, strict_terms, soft_weight``: the rule's verdict, else the vocabulary's."""
    words = words or Vocabulary()
    fold = str.maketrans(UPPER, LOWER)

    @F.pandas_udf("strict_terms int, soft_weight double")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(words)
        for urls in batches:
            yield pd.DataFrame([count_terms(u.translate(fold), found) if u and len(found) else (0, 0.0)
                                for u in urls.tolist()], columns=["strict_terms", "soft_weight"])

    host, path = host_and_path(F.col(url))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    seen = (pages.select(key, host.alias("host"), path.alias("path"), terms(F.col(url)).alias("_terms")))
    bad = (F.col("_terms.strict_terms") > 0) | (F.col("_terms.soft_weight") >= words.soft_limit)
    return seen.select(key, "host", "path", rule.alias("rule"),
                       F.coalesce(ruled, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                       F.col("_terms.strict_terms").alias("strict_terms"),
                       F.col("_terms.soft_weight").alias("soft_weight"))


def judge_sql(rules: Sequence[Rule], words: Vocabulary, pages: str = "pages") -> str:
    """The same for DuckDB, with one regular expression per soft term."""
    quoted = "'" + UPPER + "', '" + LOWER + "'"
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
            for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block"))]
    pick = lambda what: "CASE " + " ".join(f"WHEN {f} THEN '{what(r)}'" for f, r in fits) + " END"
    has = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    strict = " + ".join(f"CAST({has(t)} AS INTEGER)" for t in words.strict)
    soft = " + ".join(f"CASE WHEN {has(t)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for t, w in words.soft.items())
    return f"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {quoted}) AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
                   translate(coalesce(url, ''), {quoted}) AS low
            FROM {pages}),
        hits AS (SELECT *, CAST({strict} AS INTEGER) AS strict_terms, {soft} AS soft_weight FROM parts)
        SELECT page_id, host, path, {pick(lambda r: r.text)} AS rule,
               coalesce({pick(lambda r: r.verdict)},
                        CASE WHEN strict_terms > 0 OR soft_weight >= {words.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
               strict_terms, soft_weight
        FROM hits"""
