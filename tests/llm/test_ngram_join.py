"""Op 1 against brute force."""

import random
import re

import numpy as np
import pytest

from readloom.llm import ngram_join as N
from readloom.llm.graph import components


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall("[^\\x20\\x09-\\x0d]+", low)


def brute(rows):
    sets = []
    for doc, text in rows:
        w = words(text)
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, (doc, s) in enumerate(sets)]


def test_edge_cases(docs, rows, nothing):
    want = brute([(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, N.join(docs).collect()), key=repr) == sorted(want, key=repr)
    assert N.join(nothing).collect() == []


@pytest.mark.parametrize("sampled,block", [(1, 8_000), (16, 20)])
def test_groups_of_copies_chains_and_shared_passages(spark, monkeypatch, sampled, block):
    """With little known of frequent shingles, and neighbourhoods in several blocks, results are the same."""
    monkeypatch.setattr(N, "SAMPLED", sampled)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, docs = text(60), text(150), []
    for i in range(60):  # a group of near copies, many pairs of which don't link
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        docs.append(t)
    docs += [text(rng.randint(5, 80)) + passage for _ in range(40)]
    docs += [base] * 25
    chain = text(100)
    for i in range(12):
        docs.append(chain[i : i + 80])
    docs += [text(rng.randint(1, 8)) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    rng.shuffle(rows)
    got = N.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_every_link_survives_the_bounds():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    sets = []
    for _ in range(150):
        n = int(rng.integers(20, 300))
        x = base[:n].copy()
        change = rng.random(n) < rng.choice([0.02, 0.06, 0.3])
        x[change] = rng.integers(0, 1 << 40, int(change.sum())).astype(np.uint64)
        sets.append(np.unique(x))
    ids, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    packed = [N.pack(N.count_vector(s, N.groups_of(len(s))), np.empty(0, np.int64)) for s in sets]
    got = {tuple(p) for p in N.survivors(ids, sizes, ids, packed)}
    want = {(i, j) for i in ids for j in ids if i < j and N.linked(sizes[i], sizes[j], len(np.intersect1d(sets[i], sets[j])))}
    assert want and want <= got and len(got) < len(ids) * (len(ids) - 1) // 2


def test_vectors_survive_packing():
    v = np.array([0, 1, 2, 3, 4, 300, 0, 1])
    low, over, ranks = N.unpack(N.pack(v, np.array([5, 9])))
    assert low.tolist() == [0, 1, 2, 3, 3, 3, 0, 1] and over == 298 and ranks.tolist() == [5, 9]


def test_sets_survive_packing():
    x = np.array([0, 1, (1 << 48) - 1], np.uint64)
    assert N.from_bytes(N.to_bytes(x)).tolist() == x.tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (3, 2), (2, 3)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: i - i % 20 for i in range(60)} | dict.fromkeys(range(100, 140), 100)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
