"""Approximate search of many patterns in many texts at once.

Myers' bit vectors in numpy words: an element is a pair of a pattern and a text, a step takes all texts one letter on.
The results are those of :mod:`readloom.operators.search`, which also does what doesn't fit a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from readloom.operators.search import Hit, disjoint, find_all

#: Pairs that take a step at once.
CHUNK = 1 << 17
FAR = np.int16(1 << 14)
#: So many patterns are found by pieces that stand in a text as they are, if pieces are so long at least.
MANY, SEED = 256, 4


class Texts:
    """Texts as a matrix of small numbers, one a letter of ``letters``; 0 is any other letter, and what is beyond a text's end."""

    def __init__(self, texts: list[str], letters: str):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int32)
        table = np.zeros(257, np.uint8)
        for i, c in enumerate(letters, 1):
            table[ord(c)] = i
        self.codes = np.zeros((int(self.lengths.max(initial=0)), len(texts)), np.uint8)  # a letter a row, so that a step reads a row
        for i, t in enumerate(texts):
            raw = np.frombuffer(t.encode("latin-1"), np.uint8) if t.isascii() else np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 256)
            self.codes[: len(raw), i] = table[raw]


def fits(patterns: list[str]) -> bool:
    """Whether patterns go into words; they have to be of one length."""
    return bool(patterns) and 0 < len(patterns[0]) <= 64 and all(len(p) == len(patterns[0]) and p.isascii() for p in patterns) and len(set("".join(patterns))) < 255


class Bank:
    """Patterns of one length."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.m = patterns, len(patterns[0])
        self.word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * np.dtype(t).itemsize >= self.m)
        self.letters = "".join(sorted(set("".join(patterns))))
        self.masks = np.zeros((len(patterns), len(self.letters) + 1), self.word)
        for p, text in enumerate(patterns):
            for i, c in enumerate(text):
                self.masks[p, self.letters.index(c) + 1] |= self.word(1 << i)
        self.numbers = np.array([[self.letters.index(c) + 1 for c in x] for x in patterns], np.uint8)

    def scores(self, codes: np.ndarray, masks: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """After each letter, the least distance of a pattern to a part that ends there: of all patterns (rows) in all texts, or with ``masks``, a row a text, of one each."""
        word, high = self.word, self.word(1 << (self.m - 1))
        shape = (len(self.patterns), codes.shape[1]) if masks is None else (codes.shape[1],)
        up, down, score = np.full(shape, ~word(0)), np.zeros(shape, word), np.full(shape, self.m, np.int16)
        row, one = np.arange(codes.shape[1]), word(1)
        full = word((1 << self.m) - 1)
        up &= full
        with np.errstate(over="ignore"):
            for letter in codes:
                eq = self.masks[:, letter] if masks is None else masks[row, letter]
                x = eq | down
                d0 = (((x & up) + up) ^ up) | x
                hp = down | ~(d0 | up)
                hn = up & d0
                score += (hp & high) != 0
                score -= (hn & high) != 0
                hp <<= one
                up = ((hn << one) | ~(d0 | hp)) & full
                down = d0 & hp & full
                yield score

    def least(self, texts: Texts, most: int) -> np.ndarray:
        """The least distance of each pattern (row) to any part of each text; over ``most`` it may be anything over."""
        out = np.full((len(self.patterns), len(texts.texts)), FAR, np.int16)
        step = max(1, CHUNK // len(self.patterns))
        for at in range(0, len(texts.texts), step):
            part, own = slice(at, at + step), texts.lengths[at : at + step]
            whole, best = own.min(initial=0), out[:, part]
            for j, score in enumerate(self.scores(texts.codes[: own.max(initial=0), part])):
                np.minimum(best, score if j < whole else np.where(own > j, score, FAR), out=best)
        return out

    def ends(self, texts: Texts, pattern: np.ndarray, text: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of places of patterns and texts: the pair, the end, and the distance of every hit within ``most`` (one each)."""
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, len(pattern), CHUNK):
            part = slice(at, at + CHUNK)
            p, t, limit = pattern[part], text[part], most[part]
            length = texts.lengths[t]
            for j, score in enumerate(self.scores(texts.codes[: length.max(initial=0), t], self.masks[p])):
                hit = np.flatnonzero((score <= limit) & (length > j))
                if len(hit):
                    found.append((hit + at, np.full(len(hit), j + 1), score[hit].astype(np.int64)))
        pair, end, distance = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((end, pair))
        return pair[order], end[order], distance[order]

    def starts(self, texts: Texts, pattern: np.ndarray, text: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Where hits begin: of the spans of that distance the one nearest to the pattern's length, the shorter of two as near."""
        out = end - self.m
        some = np.flatnonzero(distance)
        if not len(some):
            return out
        p, t, e, d = pattern[some], text[some], end[some], distance[some]
        letters = self.numbers[p, ::-1]
        row = np.repeat(np.arange(self.m + 1, dtype=np.int16)[:, None], len(some), axis=1)
        best, span = np.full(len(some), FAR, np.int64), np.zeros(len(some), np.int64)
        hit = row[self.m] == d
        best[hit] = self.m
        for j in range(1, self.m + int(d.max()) + 1):
            there = e >= j
            code = np.where(there, texts.codes[np.maximum(e - j, 0), t], 255)
            new = np.empty_like(row)
            new[0] = j
            for i in range(1, self.m + 1):
                np.minimum(row[i - 1] + (letters[:, i - 1] != code), np.minimum(row[i], new[i - 1]) + 1, out=new[i])
            row = new
            hit = there & (row[self.m] == d) & (np.abs(j - self.m) < best) & (j <= self.m + d)
            best[hit], span[hit] = abs(j - self.m), j
        out[some] = e - span
        return out


@lru_cache(maxsize=16)
def bank_of(patterns: tuple[str, ...]) -> Bank:
    """Banks are made once for the batches that use them."""
    return Bank(list(patterns))


def exact_pairs(codes: np.ndarray, at: int, pieces: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces of patterns (a row a pattern, of letters as numbers) stand in texts: pattern, text and place of each, texts numbered from ``at``."""
    n = pieces.shape[1]
    if len(codes) < n:
        return (np.empty(0, np.int64),) * 3
    weights = np.int64(base) ** np.arange(n, dtype=np.int64)
    keys = pieces.astype(np.int64) @ weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    windows = np.zeros((len(codes) - n + 1, codes.shape[1]), np.int64)
    for i in range(n):
        windows += codes[i : len(codes) - n + 1 + i] * weights[i]
    first, last = np.searchsorted(keys, windows, "left"), np.searchsorted(keys, windows, "right")
    place, text = np.nonzero(last > first)
    lo, times = first[place, text], (last - first)[place, text]
    which = np.repeat(lo - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
    return order[which], np.repeat(text, times) + at, np.repeat(place, times)


def _pieces(bank: Bank, texts: Texts, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`exact_pairs` of the letters ``lo`` to ``hi`` of all patterns, some texts at a time."""
    step = max(1, CHUNK // max(1, len(texts.codes)))
    for at in range(0, len(texts.texts), step):
        yield exact_pairs(texts.codes[:, at : at + step], at, bank.numbers[:, lo:hi], len(bank.letters) + 1)


def exact_hits(patterns: list[str], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text (pattern, start, end) of all hits without edits, disjoint for each pattern, by pattern and place; the cost hardly depends on how many patterns there are."""
    bank = bank_of(tuple(patterns))
    held = Texts(texts, bank.letters)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for pattern, text, place in _pieces(bank, held, 0, bank.m):
        order = np.lexsort((place, pattern, text))
        last, until = None, 0
        for p, t, s in zip(pattern[order].tolist(), text[order].tolist(), place[order].tolist()):
            if (p, t) != last:
                last, until = (p, t), 0
            if s >= until:
                out[t].append((p, s, s + bank.m))
                until = s + bank.m
    return out


def seeded(bank: Bank, texts: Texts, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, pattern), in order, that may be within ``most`` edits: of ``most + 1`` pieces of the pattern one stands in the text as it is."""
    cuts = [bank.m * i // (most + 1) for i in range(most + 2)]
    found = [np.empty(0, np.int64)]
    for lo, hi in zip(cuts, cuts[1:]):
        found += [np.unique(text * len(bank.patterns) + pattern) for pattern, text, _ in _pieces(bank, texts, lo, hi)]
    pairs = np.unique(np.concatenate(found))
    return pairs // len(bank.patterns), pairs % len(bank.patterns)


def find_all_in(pattern: str, texts: list[str], most: int) -> list[list[Hit]]:
    """:func:`search.find_all` of one pattern in each text."""
    if most <= 0 or not fits([pattern]) or not texts:
        return [find_all(pattern, t, most) for t in texts]
    bank = bank_of((pattern,))
    held = Texts(texts, bank.letters)
    n = len(texts)
    at, end, distance = bank.ends(held, np.zeros(n, np.int64), np.arange(n), np.full(n, most))
    start = bank.starts(held, np.zeros(len(at), np.int64), at, end, distance)
    out: list[list[Hit]] = [[] for _ in texts]
    for i, s, e, d in zip(at.tolist(), start.tolist(), end.tolist(), distance.tolist()):
        out[i].append((s, e, d))
    return out


def best_hits(patterns: list[str], texts: list[str], most: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text the hits with fewest edits of any pattern, ``most`` at most: (pattern, start, end, distance), disjoint for each pattern, by pattern and place."""
    bank = bank_of(tuple(patterns))
    held = Texts(texts, bank.letters)
    if len(patterns) >= MANY and bank.m // (most + 1) >= SEED:
        t, p = seeded(bank, held, most)
        pair, end, distance = bank.ends(held, p, t, np.full(len(p), most))
        least = np.full(len(texts), FAR, np.int64)
        np.minimum.at(least, t[pair], distance)
        best = distance == least[t[pair]]
        pair, end, distance = pair[best], end[best], distance[best]
    else:
        near = bank.least(held, most)
        least = near.min(axis=0, initial=FAR)
        t, p = np.nonzero((near == least[None, :]).T & (least <= most)[:, None])  # by text, then pattern
        pair, end, distance = bank.ends(held, p, t, least[t])
    start = bank.starts(held, p[pair], t[pair], end, distance)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    last, until = -1, 0
    # The hits of a pair are of one distance, so each is taken that begins where the last one taken ends, or later.
    for i, who, where, s, e, d in zip(pair.tolist(), p[pair].tolist(), t[pair].tolist(), start.tolist(), end.tolist(), distance.tolist()):
        if i != last:
            last, until = i, 0
        if s >= until:
            out[where].append((who, s, e, d))
            until = e
    return out


def disjoint_in(pattern: str, texts: list[str], most: int) -> list[list[Hit]]:
    """:func:`search.find_disjoint` of one pattern in each text."""
    return [disjoint(hits) for hits in find_all_in(pattern, texts, most)]
