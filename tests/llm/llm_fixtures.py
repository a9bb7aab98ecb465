"""Plain helpers of these tests."""

import hashlib

WORDS = ("amber bridge candle dorsal ember fallow garden harbor island jungle kettle lantern meadow nectar orchard "
         "pebble quarry river saddle timber umber velvet willow yonder zephyr").split()


def prose(seed: int, n: int) -> str:
    """Words by a fixed rule."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


def sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def union_find(n: int, links) -> list[int]:
    head = list(range(n))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        head[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]
