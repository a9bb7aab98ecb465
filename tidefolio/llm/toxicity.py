"""Toxicity of texts after undoing disguises with a noisy-channel decoder.

Places where letters touch digits or symbols, where a letter is doubled, or where single
letters are spaced out, however widely, become character lattices: a sign may stand for the
letters it is used for, a repeated letter or a separator may have been inserted, each at a
channel cost. Viterbi search under an interpolated Kneser-Ney character model of the
corpus picks the likeliest reading, which replaces the original, or stands beside it where
the place is common in plain words too (doubled letters, a sign at one side). The restored words are
then scored: every word, and its beginnings of 4 to 6 letters, has the lower confidence
bound of its share of toxic documents; a word counts as the strongest of these, and a
logistic model of a document's strongest words gives the score. It is fitted on the labelled
documents, each left out of its own words' counts.

Scale: the character model counts whole texts of all documents (at most 64**4 four-grams).
Word odds come from the ``max_labelled`` labelled rows of smallest id hash and keep the
``max_evidence`` strongest keys, so what goes to the tasks is bounded by parameters.
Texts are read twice and never shuffled; labelled ones are restored once and stored. Distinct spans of a batch are
decoded together, and remembered up to a bound by the Python process, over all its tasks.

Defined results: null is empty text; an empty text has the score of a document without any
evidence; if the labels are of one kind only, scores are 0. Labels that disagree count as
toxic. Repeated rows are scored alike; extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.charlm import BITS, KneserNey, Models, symbol_table
from tidefolio.llm.common import stored
from tidefolio.llm.language_id import gram_counts
from tidefolio.llm.words import slices, text_bytes

MAX_LABELLED = 20_000
MAX_EVIDENCE = 50_000
BEGINNINGS = (4, 5, 6)
REMEMBERED = 200_000
LONGEST_SPAN = 200  # bytes of one lattice; a longer run of signs is decoded in several
FEW_PATHS = 128  # lattices with at most so many readings are scored path by path
KEYS_HELD = 400_000
CERTAINTY = 3.0  # standard deviations of the lower bound

# Letters that signs are written for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*'\"~^/\\"
COST_SIGN, COST_REPEAT, COST_SEPARATOR, COST_DROP, COST_BREAK = 1.5, 0.7, 0.3, 5.0, 1.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS if ord(c) < 128] + [ord(c) for c in "._-*"]] = True
_STANDS = np.zeros(256, bool)  # signs that stand for letters
_STANDS[[ord(c) for c in SIGNS if ord(c) < 128]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GAP = _BLANK.copy()
_GAP[[ord(c) for c in ".-_*"]] = True
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^(?:[^\w@$!|+(€]|_)+|(?:[^\w@$!|+(€]|_)+$")
_BLANKS = re.compile(r"\s{2,}")
_CHOICE = re.compile(r"(?<=([a-z]))\1|[^a-z]")  # in lower-case ASCII: where more than the letter itself can be meant


def suspects(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a buffer that hint at a disguise, and which of them are rare in plain words; texts end with a blank."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    letter, sign, blank, gap = _LETTER[data], _SIGN[data], _BLANK[data], _GAP[data]
    hint = np.zeros(n, bool)
    hint[1:-1] |= sign[1:-1] & letter[:-2] & letter[2:]  # l0ser, i.d.i.o.t
    hint[1:-1] |= sign[:-2] & sign[1:-1] & letter[2:]  # 1d10t
    hint[:-1] |= sign[:-1] & letter[1:] & np.concatenate([[True], blank[:-2]])  # $tupid
    folded = data | np.uint8(32)
    double = letter[:-1] & (folded[:-1] == folded[1:]) & (data[:-1] < 128) & (data[1:] < 128)
    hint[1:-1] |= double[:-1] & double[1:]
    if n >= 5:  # t r a s h
        hint[2:-2] |= letter[:-4] & gap[1:-3] & letter[2:-2] & gap[3:-1] & letter[4:] & (data[2:-2] < 128)
    weak = np.zeros(n, bool)
    weak[:-1] |= double  # losser
    stands = _STANDS[data]
    weak[:-1] |= stands[:-1] & letter[1:]  # "1diot
    weak[1:] |= stands[1:] & letter[:-1]  # foo1
    euro = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC))
    weak[euro[letter[np.maximum(euro - 1, 0)] & (euro > 0) | letter[np.minimum(euro + 3, n - 1)]]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    first, after = edge[::2], edge[1::2]  # what stands between gaps
    single = (after - first == 1) & letter[first] & (data[first] < 128)
    weak[first[1:-1][single[:-2] & single[1:-1] & single[2:]]] = True  # t  r  a  s  h
    places = np.flatnonzero(hint | weak)
    return places, hint[places]


def spans(data: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """Tokens around the places; neighbouring one-letter tokens belong together."""
    found, last = [], -1
    raw = data.tobytes()
    n = len(raw)
    blanks = np.concatenate([[-1], np.flatnonzero(_BLANK[data]), [n]])
    before = blanks[np.searchsorted(blanks, places) - 1] + 1
    after = blanks[np.searchsorted(blanks, places, "right")]
    low_of = np.maximum(before, places - LONGEST_SPAN)
    high_of = np.maximum(np.minimum(after, low_of + LONGEST_SPAN), places + 1)
    for place, low, high in zip(places.tolist(), low_of.tolist(), high_of.tolist()):
        if place < last:
            continue
        if high - low <= 2:  # spaced letters: go on while tokens of one letter follow
            letters = 1
            while letters < LONGEST_SPAN:
                at = low
                while at > max(last, 0) and _GAP[raw[at - 1]]:
                    at -= 1
                if at == low or at <= max(last, 0) or not _LETTER[raw[at - 1]] or (at > 1 and not _GAP[raw[at - 2]]):
                    break
                low, letters = at - 1, letters + 1
            while letters < LONGEST_SPAN:
                at = high
                while at < n and _GAP[raw[at]]:
                    at += 1
                if at == high or at >= n or not _LETTER[raw[at]] or (at + 1 < n and _LETTER[raw[at + 1]]):
                    break
                high, letters = at + 1, letters + 1
        low = max(low, last, 0)
        while low < high and 128 <= raw[low] < 192:  # never inside a character
            low += 1
        while high < n and 128 <= raw[high] < 192:
            high += 1
        if high > low:
            found.append((low, high))
            last = high
    return found


def _choices(c: str, before: str, lettered: bool, inside: bool) -> list[tuple[str | None, float]]:
    """What a character may stand for, at which cost; None is nothing."""
    if c.isalpha():
        return [(c, 0.0), (None, COST_REPEAT)] if c == before else [(c, 0.0)]
    if c in SIGNS:
        letters: list[tuple[str | None, float]] = [(x, COST_SIGN) for x in SIGNS[c]]
        if not lettered or inside:
            letters += [(None, COST_REPEAT if c == before else COST_DROP), (" ", COST_BREAK)]
        return letters
    if c in SEPARATORS or c.isspace():
        return [(None, COST_SEPARATOR), (" ", COST_BREAK)]
    return [(" ", 0.0)]


def _paths(text: str, lettered: bool) -> list[tuple[str, float]] | None:
    """All paths through a lattice as (reading, cost), or None if there are more than ``FEW_PATHS``."""
    paths, end, plain = [("", 0.0)], len(text) - 1, 0
    for place in ([m.start() for m in _CHOICE.finditer(text)] if text.isascii() else
                  [i for i, c in enumerate(text) if not c.isalpha() or (i and c == text[i - 1])]):
        choices = _choices(text[place], text[place - 1] if place else "", lettered, 0 < place < end)
        if len(paths) * len(choices) > FEW_PATHS:
            return None
        fixed, grown = text[plain:place], []
        for reading, cost in paths:
            reading += fixed
            for letter, more in choices:
                if letter is None or (letter == " " and (not reading or reading[-1] == " ")):
                    grown.append((reading, cost + more))
                else:
                    grown.append((reading + letter, cost + more))
        paths, plain = grown, place + 1
    return [(reading + text[plain:], cost) for reading, cost in paths]


class Decoder:
    """Likeliest readings under a character model."""

    def __init__(self, models: Models):
        self.models, self.known, self.older, self.grams = models, {}, {}, {}
        self.symbol = symbol_table()

    def _fetch(self, grams: set[int]) -> None:
        """Look up the log probabilities of several four-grams at once."""
        lacking = [g for g in grams if g not in self.grams]
        if lacking:
            logs = self.models.log_probabilities(np.array(lacking, np.uint32))[:, 0].tolist()
            self.grams.update(zip(lacking, logs))

    def _code(self, letter: str) -> int:
        point = ord(letter)
        return int(self.symbol[point]) if point < 65536 else 28 + point % 36

    def read(self, span: str) -> str:
        span = span if span.isalnum() else _BLANKS.sub(" ", span)
        if span not in self.known:
            self.prepare([span])
        return self.known[span]

    def prepare(self, spans: Iterable[str]) -> None:
        """Decode what is not known yet, all at once: the following ``read`` of these spans looks them up."""
        spans = {s if s.isalnum() else _BLANKS.sub(" ", s) for s in set(spans)}
        if len(self.known) > REMEMBERED:  # what was not asked for since the last such moment is forgotten
            self.older, self.known = self.known, {}
        self.known.update((s, self.older[s]) for s in spans if s in self.older)
        texts = {s: s.lower() if s.isalnum() else _EDGE.sub("", s.lower()) for s in spans if s not in self.known}
        wanted = {(t, False) for t in texts.values()} | {(t, True) for t in texts.values() if t and (t[0] in SIGNS or t[-1] in SIGNS)}
        decoded = self.decode_all([w for w in wanted if any(c.isalpha() for c in w[0])])
        for span, text in texts.items():
            likeliest = decoded.get((text, False), span)
            # at an end a sign may as well be punctuation: both readings count
            lettered = decoded.get((text, True), likeliest)
            self.known[span] = likeliest if lettered == likeliest else f"{likeliest} {lettered}"

    def decode_all(self, wanted: list[tuple[str, bool]]) -> dict[tuple[str, bool], str]:
        """Likeliest reading of each (text, lettered): few paths are scored one by one, in one go, many by Viterbi search."""
        paths, owners, costs, out = [], [], [], {}
        for w in wanted:
            found = _paths(*w)
            if found is None:
                out[w] = self._decode(*w)
            else:
                for reading, cost in found:
                    paths.append(reading)
                    owners.append(w)
                    costs.append(cost)
        best: dict[tuple[str, bool], tuple[float, str]] = {}
        for w, total in zip(owners, zip((self._scores(paths) - np.array(costs)).tolist(), paths)):
            if w not in best or best[w] < total:
                best[w] = total
        out.update((w, reading) for w, (_, reading) in best.items())
        return out

    def _scores(self, paths: list[str]) -> np.ndarray:
        """Log probability of each reading, with the end of its last word."""
        if not paths:
            return np.zeros(0)
        points = np.frombuffer("".join(paths).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in paths])
        code = self.symbol[np.minimum(points, 65535)].astype(np.uint32)
        code[points == 32] = 0
        rare = np.flatnonzero(points > 65535)
        code[rare] = 28 + points[rare] % 36
        # each reading after three zeros and before one
        begin = np.cumsum(sizes + 4) - sizes - 1
        at = np.arange(len(code)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        line = np.zeros(int((sizes + 4).sum()), np.uint32)
        line[at] = code
        gram = line.copy()
        for k in range(1, 4):
            gram[k:] |= line[:-k] << np.uint32(BITS * k)
        scored = np.zeros(len(line), bool)
        scored[at] = True
        last = begin + sizes
        scored[last] = line[last - 1] > 0
        keys, inverse = np.unique(gram[scored], return_inverse=True)
        logs = np.zeros(len(line) + 1)
        logs[np.flatnonzero(scored)] = self.models.log_probabilities(keys)[:, 0].astype(np.float64)[inverse]
        return np.add.reduceat(logs, np.column_stack([begin, last + 1]).ravel())[::2]

    def _decode(self, text: str, lettered: bool = False) -> str:
        if len(self.grams) > REMEMBERED:
            self.grams.clear()
        states = {(0, ""): (0.0, "")}  # every state: last three symbols and last letter -> log probability, reading
        before = ""
        for place, c in enumerate(text):
            choices = _choices(c, before, lettered, 0 < place < len(text) - 1)
            before = c
            codes = [0 if x == " " else self._code(x) for x, _ in choices if x is not None]
            self._fetch({(context << BITS) | code for context, _ in states for code in codes})
            following: dict[tuple[int, str], tuple[float, str]] = {}
            for (context, last), (score, reading) in states.items():
                for letter, cost in choices:
                    if letter is None or (letter == " " and context & 63 == 0):
                        state, total, out = (context, last), score - cost, reading
                    else:
                        code = 0 if letter == " " else self._code(letter)
                        gram = (context << BITS) | code
                        state = (gram & ((1 << 3 * BITS) - 1), letter)
                        total, out = score - cost + self.grams[gram], reading + letter
                    if state not in following or following[state][0] < total:
                        following[state] = (total, out)
            states = following
        self._fetch({context << BITS for context, _ in states})
        return max(((score + (self.grams[context << BITS] if context & 63 else 0.0), out)
                    for (context, _), (score, out) in states.items()))[1]


_decoders: dict[str, Decoder] = {}


def decoder_of(run: str, models: Broadcast[Models]) -> Decoder:
    """The decoder that this Python process has for a run: tasks that follow each other share what it remembers."""
    if run not in _decoders:
        _decoders.clear()
        _decoders[run] = Decoder(models.value)
    return _decoders[run]


def disguises(texts: list[str]) -> list[tuple[int, bytes, list[tuple[int, int, bool, str]]]]:
    """Number and bytes of each text with suspicious places, and their spans with whether a hint there is sure."""
    data, offsets = text_bytes(pa.array([t + "\n" for t in texts], pa.string()))
    places, sure = suspects(data)
    found_in: list[tuple[int, bytes, list[tuple[int, int, bool, str]]]] = []
    if not len(places):
        return found_in
    at, sures = np.searchsorted(places, offsets), np.concatenate([[0], np.cumsum(sure)])
    for i in np.flatnonzero(np.diff(at)).tolist():
        own, here = data[offsets[i]:offsets[i + 1] - 1], places[at[i]:at[i + 1]] - offsets[i]
        found = spans(own, here)
        bounds = sures[at[i] + np.searchsorted(here, np.array(found, np.int64).reshape(-1, 2))].tolist()
        raw = own.tobytes()
        found_in.append((i, raw, [(low, high, within > before, raw[low:high].decode("utf-8", "replace"))
                                  for (low, high), (before, within) in zip(found, bounds)]))
    return found_in


def restored(texts: list[str], decoder: Decoder, found: list | None = None) -> list[str]:
    """The texts with disguised places (``disguises``) replaced by their readings, or with readings beside them."""
    out = list(texts)
    for i, raw, places in disguises(texts) if found is None else found:
        parts, last = [], 0
        for low, high, sure, span in places:
            reading = decoder.read(span)
            if not sure and reading != span:
                reading = f"{span} {reading} "
            parts += [raw[last:low].decode("utf-8", "replace"), reading]
            last = high
        out[i] = "".join(parts) + raw[last:].decode("utf-8", "replace")
    return out


def word_keys(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they differ from whole words."""
    if len(word) < BEGINNINGS[0]:
        return [word]
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


class Evidence:
    """Strength of words: how surely they are commoner in toxic documents, from the bounded table of counts.

    A key's strength is the lower Wilson bound of its share of toxic documents, as log odds
    above the share of all. Training documents are left out of their own counts.
    """

    def __init__(self, table: dict[str, tuple[int, int]], toxic: int, other: int):
        a, b = (np.array([v[i] for v in table.values()], np.float64) for i in (0, 1))
        base = float(np.log(toxic / other))
        # as counted, and less one document without or with the label
        columns = [self.lower(a, b, base), self.lower(a, b - 1, base), self.lower(a - 1, b, base)]
        self.table = {k: v for k, v in zip(table, zip(*(c.tolist() for c in columns))) if max(v) > 0}
        self.seen, self.strong = set(), {}

    @staticmethod
    def lower(a: np.ndarray, b: np.ndarray, base: float) -> np.ndarray:
        """Strength of keys that ``a`` toxic and ``b`` other documents have; 0 where it is not above that of all."""
        n, z = np.maximum(a + b, 1), CERTAINTY
        p = np.clip(a / n, 0, 1)
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        odds = np.log(np.maximum(low, 1e-300) / (1 - low)) - base
        return np.where((a > 0) & (low > 0), np.maximum(odds, 0.0), 0.0)

    def of(self, word: str, own: int | None = None) -> float:
        which, table = 0 if own is None else 1 + own, self.table
        return max((table[k][which] for k in word_keys(word) if k in table), default=0.0)

    def strengths(self, words: set[str], own: int | None) -> list[float]:
        """Of the words that have any; words are looked at once, unless a label is left out of their counts."""
        if own is not None:
            return [e for e in (self.of(w, own) for w in words) if e > 0]
        if len(self.seen) > REMEMBERED:
            self.seen, self.strong = set(), {}
        new = words - self.seen
        self.strong.update((w, e) for w, e in ((w, self.of(w)) for w in new) if e > 0)
        self.seen |= new
        return [self.strong[w] for w in words & self.strong.keys()]

    def features(self, text: str, own: int | None = None) -> tuple[float, float, float, float]:
        """``own``: the label, if the text is one of those counted."""
        words = set(_WORD.findall(text.lower()))
        strong = sorted(self.strengths(words, own), reverse=True)
        return (strong[0] if strong else 0.0, strong[1] if len(strong) > 1 else 0.0,
                float(np.log1p(sum(strong))), float(np.log1p(len(words))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(len(w)),
                               z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(batches: Iterator[pa.RecordBatch], column: int, decoder: Decoder):
    for whole in batches:
        for batch in slices(whole, column):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            found = disguises(texts)
            decoder.prepare(span for _, _, places in found for *_, span in places)
            yield batch, restored(texts, decoder, found)


def score(documents: DataFrame, labels: DataFrame, learned: Column, held_out: Column, key: str = "doc_id",
          text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED,
          max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """``key, held_out, score, predicted`` for every row; starts jobs. ``learned`` says whose labels may be used."""
    context = documents.sparkSession.sparkContext
    # extra columns, whatever their names, play no part from here on
    documents = documents.select(F.col(key), F.col(text), learned.alias("_learned"), held_out.alias("_held"))
    learned, held_out = F.col("_learned"), F.col("_held")
    counts = stored(gram_counts(documents.select(F.lit(0).alias("_all"), text).filter(F.col(text).isNotNull()),
                                "_all", text), "grams").toArrow().sort_by("gram")
    run, models = uuid.uuid4().hex, context.broadcast(Models([KneserNey(counts.column("gram").to_numpy(), counts.column("n").to_numpy())]))

    known = (labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    ids = documents.filter(learned).select(F.col(key).alias("_id")).distinct()
    chosen = stored(known.join(ids, "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "labelled")
    sizes = {r._y: r.n for r in chosen.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return documents.select(key, held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    taught = (documents.filter(learned).join(F.broadcast(chosen), documents[key] == chosen["_id"])
              .select("_y", F.col(text).alias("_t")))

    def undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 1, decoder_of(run, models)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_y", "_t"])

    taught = stored(taught.mapInArrow(undone, "_y int, _t string"), "restored")  # a bounded sample, read twice

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def rows():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([v[1] for v in held.values()], pa.int64()),
                 pa.array([v[0] for v in held.values()], pa.int64())], names=["key", "toxic", "other"])
            held.clear()
        for batch in batches:
            for y, t in zip(*(c.to_pylist() for c in batch.columns)):
                for k in {k for w in set(_WORD.findall(t.lower())) for k in word_keys(w)}:
                    held.setdefault(k, [0, 0])[y] += 1
            if len(held) > KEYS_HELD:
                yield from rows()
        yield from rows()

    a, b = F.col("a"), F.col("b")
    ahead = a * sizes[0] - b * sizes[1]  # positive where the key is commoner in toxic documents
    counted = (taught.mapInArrow(keys, "key string, toxic long, other long").groupBy("key")
               .agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).filter((a > 1) & (ahead > 0))
               .orderBy(F.desc(a * a / (a + b)), "key").limit(max_evidence).toArrow())
    pairs = zip(counted.column("a").to_pylist(), counted.column("b").to_pylist())
    evidence = context.broadcast(Evidence(dict(zip(counted.column("key").to_pylist(), pairs)), sizes[1], sizes[0]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = evidence.value
        for batch in batches:
            x = np.array([table.features(t, y) for y, t in zip(*(c.to_pylist() for c in batch.columns))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)],
                                             names=["y", "x0", "x1", "x2", "x3"])

    sample = taught.mapInArrow(features, "y int, x0 double, x1 double, x2 double, x3 double").toPandas().to_numpy()
    weights = _logistic(sample[:, 1:], sample[:, 0])

    @F.arrow_udf("double")
    def scored(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, table = decoder_of(run, models), evidence.value
        for array in arrays:
            parts = []
            for _, texts in _texts([pa.RecordBatch.from_arrays([array], names=["t"])], 0, own):
                x = np.array([table.features(t) for t in texts]).reshape(-1, 4)
                parts.append(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    out = documents.select(F.col(key), held_out.alias("held_out"), scored(F.col(text)).alias("score"))
    return out.select(key, "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
