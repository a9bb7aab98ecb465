"""Character n-gram counts and interpolated Kneser-Ney models over 64 symbols.

Texts are lower-cased and every character becomes one of 64 symbols: 0 for all that is no
letter or digit (runs count once), 1-26 for a-z, 27 for digits, and the other 36 for the other
letters by code point. So there are at most 64**4 four-grams of a language, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np

SYMBOLS, BITS, ORDER = 64, 6, 4
HASH = 0x9E3779B1  # odd: a bijection of 24-bit numbers
MASK4 = (1 << BITS * ORDER) - 1
_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 65,536."""
    global _table
    if _table is None:
        points = np.arange(1 << 16)
        kinds = [unicodedata.category(chr(p))[0] for p in range(1 << 16)]
        _table = np.where([k == "L" or k == "M" for k in kinds], 28 + points % 36, 0).astype(np.uint8)
        _table[[k == "N" for k in kinds]] = 27
        _table[97:123] = np.arange(1, 27)
        _table[65:91] = np.arange(1, 27)
    return _table


def symbols(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each after three zeros; where each text's own symbols begin and end."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered)).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0] + [len(t) + 1 for t in lowered])  # places of the line breaks before each text
    table = symbol_table()
    code = table[np.minimum(points, 65535)]
    rare = np.flatnonzero(points > 65535)
    if len(rare):
        code[rare] = [28 + p % 36 if chr(p).isalpha() else 0 for p in points[rare].tolist()]
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # of a run of zeros the first stays
    keep[starts[:-1]] = True
    place = np.cumsum(keep) - 1
    code = code[keep]
    first = place[starts[:-1]]
    sizes = np.diff(np.append(first, len(code)))
    extra = 2
    out = np.zeros(len(code) + extra * len(texts), np.uint8)
    shift = np.repeat(np.arange(1, len(texts) + 1) * extra, sizes)
    out[np.arange(len(code)) + shift] = code
    begin = first + np.arange(1, len(texts) + 1) * extra + 1
    return out, begin, begin + sizes - 1


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each place, as a number; the first places lack some symbols."""
    out = np.zeros(len(code), np.uint32)
    for k in range(order):
        out[k:] |= code[:len(code) - k].astype(np.uint32) << np.uint32(BITS * k)
    return out


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], (np.add.reduceat(weights, at) if len(at) else weights)


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


class KneserNey:
    """Interpolated Kneser-Ney over four symbols, for one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys.astype(np.int64), counts.astype(np.float64)
        lower = SYMBOLS ** np.arange(ORDER + 1)
        types, below = self.keys, 1.0 / SYMBOLS
        # continuation counts: in how many longer n-grams a shorter one ends
        spread = []
        for n in (3, 2, 1):
            types = types % lower[n]
            kept = np.bincount(types, minlength=lower[n])
            spread.append(kept.astype(np.float64))
            types = np.flatnonzero(kept)
        for n, kept in zip((1, 2, 3), reversed(spread)):
            table = kept.reshape(-1, SYMBOLS)
            d, total = discount(kept[kept > 0]), table.sum(1, keepdims=True)
            back = np.where(total > 0, d * (table > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
            shorter = np.tile(np.atleast_2d(below), (lower[n - 1] // max(1, np.atleast_2d(below).shape[0]), 1))
            below = np.maximum(table - d, 0) / np.maximum(total, 1) + back * shorter
        self.three = below.reshape(-1)  # P(d | b c) at b c d
        context = self.keys >> BITS
        self.top = discount(self.counts)
        self.total = np.bincount(context, self.counts, minlength=lower[3])
        kinds = np.bincount(context, minlength=lower[3])
        self.back = np.where(self.total > 0, self.top * kinds / np.maximum(self.total, 1), 1.0)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """P(d | a b c) for each number of a b c d."""
        keys = keys.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        seen = np.where(self.keys[at] == keys, self.counts[at], 0.0) if len(self.keys) else np.zeros(len(keys))
        context = keys >> BITS
        return (np.maximum(seen - self.top, 0) / np.maximum(self.total[context], 1)
                + self.back[context] * self.three[keys & (SYMBOLS ** 3 - 1)])


class Models:
    """Log probabilities of several languages in one sorted hash array, with dense tables for four-grams none has."""

    def __init__(self, models: Sequence[KneserNey]):
        keys = np.unique(np.concatenate([m.keys for m in models]))
        hashed = self.hashed(keys)
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.logs = np.column_stack([np.log(m.probability(keys)) for m in models])[order].astype(np.float32)
        self.back = np.column_stack([np.log(m.back) for m in models]).astype(np.float32)
        self.three = np.column_stack([np.log(m.three) for m in models]).astype(np.float32)

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(HASH)) & np.uint64(MASK4)).astype(np.uint32)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """One row per key, one column per language."""
        wanted = self.hashed(keys)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out = self.logs[at]
        lost = np.flatnonzero(self.hashes[at] != wanted)
        if len(lost):
            key = keys[lost].astype(np.int64)
            out[lost] = self.back[key >> BITS] + self.three[key & (SYMBOLS ** 3 - 1)]
        return out
