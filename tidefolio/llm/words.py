"""Word hashes of many texts at once, with numpy.

Words are runs of bytes other than ASCII white space. A word's hash is its polynomial in
an odd base modulo 2**64, taken from running sums of the whole buffer, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20
BATCH_BYTES = 512 << 10
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, CHUNK + 1), base, np.uint64)
        found[0] = 1
        _powers[base] = found = np.multiply.accumulate(found)
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in a text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the offsets of its rows; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _hashes(part: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of the words of ``part``; a word also ends at each of ``breaks``."""
    solid = ~SPACE[part]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(part))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part))[:len(part)], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(part))[start]), start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the number of its first word (one entry more than texts).

    Works in chunks that end at white space, so memory beside the hashes is bounded
    whatever the texts' lengths (a single word longer than a chunk is taken whole).
    """
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(SPACE[data[end:]])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(data)
        low, high = np.searchsorted(offsets, at), np.searchsorted(offsets, end)
        h, s = _hashes(data[at:end], offsets[low:high] - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, and the number of its text.

    A text of one to ``size - 1`` words is one shingle of all its words.
    """
    counts = np.diff(bounds)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), per_text)
    first = np.cumsum(per_text) - per_text
    at = bounds[:-1][text] + np.arange(len(text)) - first[text]
    end = bounds[1:][text]
    out = np.zeros(len(text), np.uint64)
    for k in range(size):
        here = np.minimum(at + k, max(0, len(words) - 1))
        value = words[here] if len(words) else np.zeros(0, np.uint64)
        out = mix(out * np.uint64(BASE) + np.where(at + k < end, value, np.uint64(0)) + np.uint64(1))
    return out, text
