"""Approximate search of a pattern in a text, by edit distance.

Distances at all end positions come from Myers' bit-vector algorithm on Python's integers of any length, so a pattern
may be as long as it likes.  A hit with edits doesn't fix where it starts; here the start is that whose span is nearest
to the pattern's length among those of the same distance, the later one of two as near.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

Hit = tuple[int, int, int]  # start, end, distance


def allowed_edits(length: int, rate: float) -> int:
    """``floor(length * rate)`` in 32-bit floats."""
    return int(np.floor(np.float32(length) * np.float32(rate)))


@lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def end_distances(pattern: str, text: str) -> list[int]:
    """For each end position from 0 to ``len(text)``, the least distance of the pattern to a part of the text that ends there."""
    m = len(pattern)
    masks, full, high = _masks(pattern), (1 << m) - 1, 1 << max(0, m - 1)
    up, down, score = full, 0, m
    out = [m]
    if not m:
        return [0] * (len(text) + 1)
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & full
        up = (hn << 1 | (full & ~(d0 | hp))) & full
        down = d0 & hp
        out.append(score)
    return out


def start_of(pattern: str, text: str, end: int, distance: int) -> int:
    """Where a hit of that distance begins, among all parts of the text that end at ``end``."""
    m = len(pattern)
    if not distance:
        return end - m
    back = text[max(0, end - m - distance) : end][::-1]
    row = list(range(m + 1))  # distances of the reversed pattern's prefixes to the reversed text's prefix
    best = (abs(m), 0) if row[m] == distance else None
    pattern = pattern[::-1]
    for j, c in enumerate(back, 1):
        new = [j]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        if row[m] == distance and (best is None or abs(j - m) < best[0]):
            best = (abs(j - m), j)
    return end - best[1]


def find_all(pattern: str, text: str, most: int) -> list[Hit]:
    """A hit for each end position within ``most`` edits, by position."""
    if most <= 0:
        out, at = [], text.find(pattern) if pattern else -1
        while at >= 0:
            out.append((at, at + len(pattern), 0))
            at = text.find(pattern, at + 1)
        return out
    ends = [(e, d) for e, d in enumerate(end_distances(pattern, text)) if d <= most and e]
    return [(start_of(pattern, text, e, d), e, d) for e, d in ends]


def disjoint(hits: list[Hit]) -> list[Hit]:
    """Hits taken in the order of their distances, then positions, as long as they don't overlap one taken before."""
    out: list[Hit] = []
    for start, end, d in sorted(hits, key=lambda h: h[2]):
        if all(start >= e or end <= s for s, e, _ in out):
            out.append((start, end, d))
    return out


def find_disjoint(pattern: str, text: str, most: int) -> list[Hit]:
    return disjoint(find_all(pattern, text, most))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]
