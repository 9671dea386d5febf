"""Exact Jaccard similarity join on word shingles, with a count-vector R-tree.

A text's set of shingle hashes, dealt into groups, gives a vector of group counts.  Two sets share no more than the sum
of the smaller counts of each group, so vectors whose sum of minima is too small need no comparison; a node of an
R-tree over the vectors keeps the largest count of each group among its points, and the same sum against it bounds
every point below.

Count vectors of unrelated texts are much alike in any few dimensions, so a tree over all of a corpus prunes little
near its root and would be searched in quadratic time.  Trees are therefore built over neighbourhoods that can't
separate a linked pair: under any common order of shingles, two sets that link share one of the first
``n - ceil(3n/4) + 1`` shingles of each (the prefix).  The order puts frequent shingles last.  All documents with one
prefix shingle form a neighbourhood.

1. Texts become sets; equal sets are one class from there on.
2. Prefixes go to their shingle's partition; shingles of a single class end there.  A neighbourhood of a few classes has
   no tree: its pairs are counted over all such neighbourhoods, as pairs that share fewer prefix shingles than a link
   takes can't link.
3. Contraction: each class is compared with the one other class with which it shares most prefix shingles.  Links found
   make first components.  In large neighbourhoods each class is also held against a few others, and the one or two
   whose count vectors promise most are verified, as a large group of copies is searched cheaply once it is connected.
4. Search: large neighbourhoods that lie in one component are done.  In every other one each class's vector is searched
   in the tree of that neighbourhood.  Pairs of two components that survive there, or have met often enough in small
   ones, are bounded by the summed minima of their vectors and then verified on their whole sets.  No pair that may link
   two components is left out, so the components that result are exact.

Tasks read their rows in the order of their shingles and keep no more than a neighbourhood: of a large one its rows leave
as they come.  Sets move twice for each pair that is verified, whatever the size of the corpus: to their id and to the pair's partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import drop, each_batch, may_be_in, partitions, record_batch, sieve, small_batches, table, tidy
from readloom.llm.graph import components

WORDS = 5
#: One in how many documents frequent shingles are learnt from; how many of those have to hold one, and how many go last at most.  Any order gives the same result.
SAMPLED, OFTEN, FREQUENT = 4, 3, 1 << 20
#: Points to a leaf of the tree; classes of a neighbourhood that a task searches at once.
LEAF, BLOCK = 32, 4_000
#: Neighbourhoods up to this size have no tree: their pairs are counted, at most (FEW - 1) / 2 for each class that is in one.
FEW = 12
#: Other classes of a large neighbourhood that each is held against to connect it before the search; in how many neighbourhoods of a class.
GLANCES, GLANCED = 32, 3
#: Pairs with one partner that a task verifies, on average at most.
SHARE = 500
#: Slices of shingles in all, and of a partition, at least: a task takes them one after the other.  Rows of a slice after which large neighbourhoods are sent on.
SLICES, SLICED, HELD = 1 << 11, 8, 1 << 20

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; those of fewer words are one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: white space and case of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    a = np.array([_words[w] for w in words], np.uint64)
    n = max(1, len(a) - WORDS + 1)
    h = np.full(n, min(len(a), WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(WORDS, len(a))):
            h += (a[i : i + n] ^ (a[i : i + n] >> np.uint64(31))) * _K[i]
        h ^= h >> np.uint64(32)
        h *= _K[0]
        h ^= h >> np.uint64(29)
        h *= _K[1]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def shorten(h: np.ndarray) -> np.ndarray:
    """48 of the 64 bits, of which sets are kept and compared."""
    return h >> np.uint64(16)


def to_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def linked(a: int, b: int, shared: int) -> bool:
    """Jaccard of 0.75 at least: 100 shared >= 75 (a + b - shared)."""
    return 7 * shared >= 3 * (a + b)


def prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many prefix items sets of these sizes share at least if they link.

    At most ``a - o`` items of one set aren't in the other, where ``o`` is the overlap a link takes.  Of the two prefixes take
    that which ends earlier in the common order: those of its items that are in the other set are in the other prefix too.
    """
    o = -(-3 * (a + b) // 7)
    return np.minimum(a - (3 * a + 3) // 4 + 1 - (a - o), b - (3 * b + 3) // 4 + 1 - (b - o))


def groups_of(n: int) -> int:
    """Groups of the count vector of a set of ``n``: so many that less than a shingle falls into each."""
    return 1 << max(5, (max(1, -(-4 * n // 3)) - 1).bit_length())


def pack(vector: np.ndarray, ranks: np.ndarray) -> bytes:
    """A count vector in two bits a group, with what is over 3 as a sum, and ranks of frequent items."""
    low = np.minimum(vector, 3).astype(np.uint8)
    return np.array([vector.sum() - low.sum(dtype=np.int64), len(ranks)], "<u4").tobytes() + ranks.astype("<i4").tobytes() + (low[::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, int, np.ndarray]:
    over, k = np.frombuffer(data, "<u4", 2)
    low = np.frombuffer(data, np.uint8, offset=8 + 4 * int(k))
    out = np.empty(4 * len(low), np.uint8)
    for i in range(4):
        out[i::4] = low >> 2 * i & 3
    return out, int(over), np.frombuffer(data, "<i4", int(k), 8)


def count_vector(values: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((values & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def fold(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Vectors of more groups as they would be with ``groups``."""
    while vectors.shape[1] > groups:
        half = vectors.shape[1] // 2
        vectors = vectors[:, :half] + vectors[:, half:]
    return vectors


class RTree:
    """Count vectors in leaves of ``LEAF`` points and nodes of as many children.

    A node has the largest counts and the range of sizes below it, and the marks that all points below have in common.  Points
    with a mark in common are another neighbourhood's work.  They are sorted by size, as linked sets differ little in it, and
    within slabs by marks and by the group whose counts vary most.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, over: np.ndarray, marks: np.ndarray):
        slab = LEAF * LEAF
        order = np.argsort(sizes, kind="stable")
        widest = int(np.argmax(vectors.var(axis=0))) if len(vectors) else 0
        for start in range(0, len(order), slab):
            part = order[start : start + slab]
            order[start : start + slab] = part[np.lexsort((vectors[part, widest], *marks[part].T))]
        self.order, self.vectors, self.sizes, self.over, self.marks = order, vectors[order], sizes[order], over[order], marks[order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        top, least, most, over, marks = self.vectors, self.sizes, self.sizes, self.over, self.marks
        while not self.levels or len(top) > 1:
            starts = np.arange(0, len(top), LEAF)
            top, least, most, over = np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(over, starts)
            marks = np.bitwise_and.reduceat(marks, starts, axis=0)
            self.levels.append((top, least, most, over, marks))

    def search(self, vectors: np.ndarray, sizes: np.ndarray, over: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For all queries at once, leaf by leaf: places of queries and of points whose summed minima allow a link."""
        stack = [(len(self.levels) - 1, i, np.arange(len(vectors))) for i in range(len(self.levels[-1][0]))]
        while stack:
            level, i, rows = stack.pop()
            top, least, most, more, common = (x[i] for x in self.levels[level])
            n = sizes[rows]
            rows = rows[(4 * n >= 3 * least) & (4 * most >= 3 * n) & ~(marks[rows] & common).any(axis=1)]
            if not len(rows):
                continue
            # A point below has at least `least` shingles and at least 3/4 of the query's.
            need = 3 * (sizes[rows] + np.maximum(least, -(-3 * sizes[rows] // 4)))
            rows = rows[7 * (np.minimum(vectors[rows], top).sum(axis=1, dtype=np.int32) + over[rows] + more) >= need]
            if not len(rows):
                continue
            lo, hi = i * LEAF, (i + 1) * LEAF
            if level:
                stack += [(level - 1, k, rows) for k in range(lo, min(hi, len(self.levels[level - 1][0])))]
                continue
            for p in range(lo, min(hi, len(self.vectors))):
                some = rows[~(marks[rows] & self.marks[p]).any(axis=1)]
                bound = np.minimum(vectors[some], self.vectors[p]).sum(axis=1, dtype=np.int32) + over[some] + self.over[p]
                some = some[7 * bound >= 3 * (sizes[some] + self.sizes[p])]
                if len(some):
                    yield some, np.full(len(some), self.order[p])


def survivors(ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, packed: list[bytes], rank: int = -1, blocks: np.ndarray | None = None, lo: int = 0, hi: int = 0) -> np.ndarray:
    """Pairs (smaller id, larger id) of different components whose count vectors allow a link.

    A pair that shares a frequent item of a lower rank than this neighbourhood's is left to that one; of a pair of blocks one
    each is taken.
    """
    pairs = [np.empty((0, 2), np.int64)]
    read = [unpack(x) for x in packed]
    widths, over = np.array([len(v) for v, _, _ in read]), np.array([o for _, o, _ in read], np.int32)
    lower = [r[r < rank] for _, _, r in read]
    names = np.unique(np.concatenate([np.empty(0, np.int32), *lower]))
    marks = np.zeros((len(read), max(1, -(-len(names) // 64))), np.uint64)
    for i, r in enumerate(lower):
        for at in np.searchsorted(names, r).tolist():
            marks[i, at >> 6] |= np.uint64(1 << (at & 63))
    for width in np.unique(widths):
        base = np.flatnonzero(widths == width)
        # Sets of the next width are at most 4/3 as large as some of this width, if they link at all.
        more = np.flatnonzero((widths == 2 * width) & (3 * sizes <= 4 * sizes[base].max()))
        if len(base) + len(more) < 2 or len(np.unique(comps[np.concatenate([base, more])])) < 2:
            continue
        rows = np.concatenate([base, more])
        points = np.stack([read[i][0] for i in base])
        if len(more):
            points = np.concatenate([points, fold(np.stack([read[i][0] for i in more]), int(width))])
        tree = RTree(points[: len(base)], sizes[base], over[base], marks[base])
        for q, p in tree.search(points, sizes[rows], over[rows], marks[rows]):
            a, b = rows[q], base[p]
            keep = (comps[a] != comps[b]) & ((q >= len(base)) | (ids[a] < ids[b]))
            if blocks is not None:
                keep &= (np.minimum(blocks[a], blocks[b]) == lo) & (np.maximum(blocks[a], blocks[b]) == hi)
            a, b = ids[a[keep]], ids[b[keep]]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


# ---- distributed steps ----

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("items", pa.binary())])


def slices_of(parts: int) -> int:
    return parts * max(SLICED, SLICES // parts)


def by_slice(items: np.ndarray, slices: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order by slice; and slice, start and end of the items of each slice in that order."""
    q = (items % np.uint64(slices)).astype(np.int64)
    order = np.argsort(q, kind="stable")
    q = q[order]
    cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    return order, zip(q[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(q)].tolist())


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shortened hashes, sorted, of at most FREQUENT shingles that occur in OFTEN or more of one in SAMPLED documents; and their ranks from rare to common."""
    spark = docs.sparkSession
    parts = partitions(spark)
    n = slices_of(parts)
    dealt, schema = pa.schema([("q", pa.int32()), ("items", pa.binary())]), pa.schema([("item", pa.int64()), ("times", pa.int64())])

    def deal(batch: pa.RecordBatch) -> dict:
        items = np.concatenate([np.empty(0, np.uint64), *(shorten(shingles(x)) for x in batch.column(0).to_pylist())])
        order, cuts = by_slice(items, n)
        items, out = items[order], [(q, lo, hi) for q, lo, hi in cuts]
        return {"q": [q for q, _, _ in out], "items": [to_bytes(items[lo:hi]) for _, lo, hi in out]}

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        items, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [items], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = -1, [], []

        def done() -> pa.RecordBatch:
            (items,), (times,) = summed(keys, counts)
            return record_batch({"item": items[times >= OFTEN].astype(np.int64), "times": times[times >= OFTEN]}, schema)

        for batch in batches:
            for q, x in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now and keys:
                    yield done()
                    keys, counts = [], []
                now = q
                keys.append(from_bytes(x))
                counts.append(np.ones(len(keys[-1]), np.int64))
                if sum(map(len, keys)) > 4 * HELD:
                    keys, counts = summed(keys, counts)
        if keys:
            yield done()

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(each_batch(deal, dealt), "q int, items binary")
    found = table(some.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(tidy(counted), "item long, times long"), "frequent", compact=True)
    # So many of the most frequent ones, by whole counts, as there is room for.
    least, room = OFTEN, FREQUENT
    for times, m in sorted(map(tuple, found.groupBy(F.least("times", F.lit(10_000)).alias("times")).count().collect()), reverse=True):
        room -= m
        least = times if room >= 0 else least
        if room < 0:
            least = times + 1
            break
    rows = found.where(F.col("times") >= least).toArrow()
    drop(found)
    items, times = rows.column("item").to_numpy().astype(np.uint64), rows.column("times").to_numpy()
    order = np.argsort(items)
    rank = np.empty(len(items), np.int64)
    rank[np.lexsort((items, times))] = np.arange(len(items))
    return items[order], rank[order]


def in_order(items: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Items by the common order: by hash, then the frequent ones from rare to common."""
    known, rank = common
    if not len(known) or not len(items):
        return items
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    last = known[at] == items
    if not last.any():
        return items
    return np.concatenate([items[~last], items[last][np.argsort(rank[at[last]], kind="stable")]])


def sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, Broadcast]:
    """``doc_id, n, sig, items``: size, hash and shortened items in the common order, of equal sets about once a task; and the broadcast of that order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # FREQUENT items at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, sigs, items = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text)
                n.append(len(h))
                sig = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None
                sigs.append(sig)
                items.append(to_bytes(in_order(shorten(h), shared.value)) if len(h) and sig not in seen else None)
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
            yield record_batch({"doc_id": batch.column(0), "n": n, "sig": sigs, "items": items}, SETS)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, sig long, items binary"), shared


BLOBS = pa.schema([("q", pa.int32()), ("items", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])


def _prefixes(slices: int):
    """Prefix items of a batch of sets, packed by the slice they go to."""

    def run(batch: pa.RecordBatch) -> dict | None:
        data = [(s, n, from_bytes(x[: 6 * prefix(n)])) for s, n, x in zip(*(c.to_pylist() for c in batch.columns))]
        items = np.concatenate([x for _, _, x in data])
        row = np.repeat(np.arange(len(data)), [len(x) for _, _, x in data])
        order, cuts = by_slice(items, slices)
        items, row = items[order], row[order]
        sigs, sizes = np.array([s for s, _, _ in data], np.int64), np.array([n for _, n, _ in data], np.int64)
        out: dict[str, list] = {k: [] for k in BLOBS.names}
        for q, lo, hi in cuts:
            docs, times = np.unique(row[lo:hi], return_counts=True)
            for k, v in zip(BLOBS.names, (q, to_bytes(items[lo:hi]), sigs[docs].tobytes(), sizes[docs].tobytes(), times.astype(np.int32).tobytes())):
                out[k].append(v)
        return out

    return each_batch(run, BLOBS)


#: Pairs that met in small neighbourhoods, rows of large ones (``a`` the item, ``b`` the class, ``n`` its size), and pairs of large ones to connect them by.
SMALL, LARGE, HUB = 0, 1, 2
MET = pa.schema([(c, pa.int64()) for c in ("kind", "a", "b", "shared", "n", "least")])


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _pair_rows(kind: int, s: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of MET for the pairs of places whose sizes allow a link."""
    keep = (s[p] != s[q]) & (4 * np.minimum(n[p], n[q]) >= 3 * np.maximum(n[p], n[q]))
    p, q = p[keep], q[keep]
    a, b, na, nb = s[p], s[q], n[p], n[q]
    return np.stack([np.full(len(p), kind, np.int64), np.minimum(a, b), np.maximum(a, b), np.ones(len(p), np.int64), np.maximum(na, nb), least_common(na, nb)], axis=1)


def _pairs_of(s: np.ndarray, n: np.ndarray, starts: np.ndarray, times: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of neighbourhoods of FEW classes at most."""
    for m in np.unique(times):
        own = starts[times == m]
        i, j = np.triu_indices(int(m), 1)
        for at in range(0, len(own), max(1, HELD // len(i))):
            first = own[at : at + max(1, HELD // len(i)), None]
            yield _pair_rows(SMALL, s, n, (first + i).ravel(), (first + j).ravel())


def _summed_rows(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    rows = rows[np.lexsort(rows[:, 2::-1].T)]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
    out = rows[starts]
    if len(out):
        out[:, 3] = np.add.reduceat(rows[:, 3], starts)
    return out


class _Slice:
    """The neighbourhoods of one slice: rows come in parts, and those of large neighbourhoods don't stay."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.hubs: dict[int, tuple[int, int]] = {}  # items with a large neighbourhood, and the class that others are held against

    def rows(self, last: bool) -> Iterator[np.ndarray]:
        x, s, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((s, x))
        x, s, n = x[order], s[order], n[order]
        once = np.r_[True, (x[1:] != x[:-1]) | (s[1:] != s[:-1])] if len(x) else np.empty(0, bool)  # a class may come from several tasks
        x, s, n = x[once], s[once], n[once]
        starts = _starts(x)
        times = np.diff(np.r_[starts, len(x)])
        big = times > FEW
        if self.hubs:
            big |= np.isin(x[starts].astype(np.int64), np.array(list(self.hubs), np.int64))
        gone = np.repeat(big, times)
        if gone.any():
            yield from self.large(x[gone].astype(np.int64), s[gone], n[gone])
        if last:
            few = ~big & (times > 1)
            yield from _pairs_of(s, n, starts[few], times[few])
        self.parts = [] if last else [(x[~gone], s[~gone], n[~gone])]

    def large(self, x: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        zero = np.zeros(len(x), np.int64)
        yield np.stack([zero + LARGE, x, s, zero, n, zero], axis=1)
        starts = _starts(x)
        for item, sig, size in zip(x[starts].tolist(), s[starts].tolist(), n[starts].tolist()):
            self.hubs.setdefault(item, (sig, size))
        hubs = np.repeat(np.array([self.hubs[i] for i in x[starts].tolist()], np.int64), np.diff(np.r_[starts, len(x)]), axis=0)
        # Each class with the hub, and with the one before it by size.
        yield _pair_rows(HUB, np.r_[s, hubs[:, 0]], np.r_[n, hubs[:, 1]], np.arange(len(x)), np.arange(len(x)) + len(x))
        order = np.lexsort((s, n, x))
        x, s, n = x[order], s[order], n[order]
        inner = np.flatnonzero(x[1:] == x[:-1]) + 1
        yield _pair_rows(HUB, s, n, inner, inner - 1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MET from BLOBS, which come slice by slice; pairs are summed before they leave."""
    now, own, size = -1, _Slice(), 0
    out, held = [np.empty((0, 6), np.int64)], 0

    def sent() -> Iterator[pa.RecordBatch]:
        rows = _summed_rows(out)
        for at in range(0, len(rows), 50_000):
            yield record_batch(dict(zip(MET.names, map(np.ascontiguousarray, rows[at : at + 50_000].T))), MET)
        out[:] = [rows[:0]]

    for batch in batches:
        for q, x, s, n, k in zip(*(c.to_pylist() for c in batch.columns)):
            if (q != now or size > HELD) and own.parts:
                for rows in own.rows(q != now):
                    out.append(rows)
                    held += len(rows)
                size = sum(len(p[0]) for p in own.parts)
            if q != now:
                now, own, size = q, _Slice(), 0
            times = np.frombuffer(k, np.int32)
            own.parts.append((from_bytes(x), np.repeat(np.frombuffer(s, np.int64), times), np.repeat(np.frombuffer(n, np.int64), times)))
            size += len(own.parts[-1][0])
        if held > 2 * HELD:
            yield from sent()
            held = 0
    if own.parts:
        out.extend(own.rows(True))
    yield from sent()


def ranks_in(items: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ranks of those items that are frequent."""
    known, rank = common
    if not len(known) or not len(items):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    return rank[at[known[at] == items]]


def pick(kept: DataFrame, ids: DataFrame, spent: list[Broadcast], common: Broadcast | None = None) -> DataFrame:
    """``sig, n, items`` (with the broadcast of frequent items, count vectors and the ranks of the prefix as ``items``) of the classes in ``ids`` and a few others, each once; only those are shuffled."""
    shared = kept.sparkSession.sparkContext.broadcast(sieve(ids))  # of bounded size
    spent.append(shared)
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict | None:
        keep = may_be_in(shared.value, np.asarray(batch.column(0)))
        if not len(keep):
            return None
        batch = batch.take(pa.array(keep))
        items = batch.column(2)
        if common is not None:
            whole = [(n, from_bytes(x)) for n, x in zip(batch.column(1).to_pylist(), items.to_pylist())]
            items = [pack(count_vector(x, groups_of(n)), ranks_in(x[: prefix(n)], common.value)) for n, x in whole]
        return {"sig": batch.column(0), "n": batch.column(1), "items": items}

    return kept.where("items is not null").select("sig", "n", "items").mapInArrow(each_batch(run, schema), "sig long, n long, items binary").dropDuplicates(["sig"])


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by partner ``b``, its own set first; the others are compared with that one."""
    own: tuple[tuple, int, np.ndarray] | None = None
    for batch in batches:
        found: dict[str, list[int]] = {"a": [], "b": []}
        for b, part, a, n, items in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.sort(from_bytes(items))
            if a is None:
                own = ((b, part), n, values)
            elif own is not None and own[0] == (b, part):
                width = min(groups_of(n), groups_of(own[1]))
                if not linked(n, own[1], int(np.minimum(count_vector(values, width), count_vector(own[2], width)).sum())):
                    continue
                at = np.minimum(np.searchsorted(own[2], values), len(own[2]) - 1)
                if linked(n, own[1], int(np.count_nonzero(own[2][at] == values))):
                    found["a"].append(a)
                    found["b"].append(b)
        if found["a"]:
            yield record_batch(found, LINKS)


def verify(pairs: DataFrame, kept: DataFrame, spent: list[Broadcast]) -> DataFrame:
    """Those of ``pairs(a, b)``, a table, that link.  The pairs of one ``b`` are split over parts that each get its set."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    dealt = pairs.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    # Each set goes wherever it is asked for, as one of a pair or as the partner that a part's sets are compared with.
    asked = dealt.select(F.col("a").alias("sig"), "b", "part", "a").unionByName(dealt.select(F.col("b").alias("sig"), "b", "part", F.lit(None).cast("long").alias("a")).distinct())
    rows = pick(kept, ids, spent).join(asked, "sig").select("b", "part", "a", "n", "items")
    rows = rows.repartition(partitions(pairs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.mapInArrow(tidy(_verified), "a long, b long")


OPEN = pa.schema([("item", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("sig", pa.int64()), ("n", pa.int64()), ("comp", pa.int64())])


def _open_rows(x: int, s: np.ndarray, n: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a neighbourhood that hold more than one component; those of very many classes in blocks, a class once for each other block."""
    # A row whose neighbours by size are all too large or too small to link has nothing to search.
    order = np.argsort(n, kind="stable")
    s, n, c = s[order], n[order], c[order]
    close = 3 * n[1:] <= 4 * n[:-1]
    keep = np.r_[close, False] | np.r_[False, close]
    s, n, c = s[keep], n[keep], c[keep]
    if not len(s) or (c == c[0]).all():
        return
    order = np.lexsort((s, c))
    s, n, c = s[order], n[order], c[order]
    m = len(s)
    k = max(1, -(-m // (BLOCK // 2))) if m > BLOCK else 1
    block = np.arange(m, dtype=np.int64) * k // m  # rows are sorted by component, so a block has few
    cuts = np.searchsorted(block, np.arange(k + 1))
    only = [c[lo] if c[lo] == c[hi - 1] else None for lo, hi in zip(cuts, cuts[1:])]
    for other in range(k):
        alike = np.array([k > 1 and only[i] is not None and only[i] == only[other] for i in range(k)])
        at = np.flatnonzero(~alike[block])
        for part in range(0, len(at), 50_000):
            to = at[part : part + 50_000]
            lo, hi = np.minimum(block[to], other).astype(np.int32), np.maximum(block[to], other).astype(np.int32)
            yield record_batch(dict(zip(OPEN.names, (np.full(len(to), x), lo, hi, block[to].astype(np.int32), s[to], n[to], c[to]))), OPEN)


def _unfinished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large neighbourhoods of more than one component, from rows ``item, sig, n, comp`` that come by item; holds 24 bytes a class of one neighbourhood."""
    now, parts = None, []
    for batch in batches:
        x, *rest = (np.asarray(c) for c in batch.columns)
        starts = _starts(x)
        for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(x)].tolist()):
            if x[lo] != now and parts:
                yield from _open_rows(now, *(np.concatenate(c) for c in zip(*parts)))
                parts = []
            now = int(x[lo])
            parts.append([c[lo:hi] for c in rest])
    if parts:
        yield from _open_rows(now, *(np.concatenate(c) for c in zip(*parts)))


def glances(ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """For each class the two of GLANCES others, in an order by hashes, whose count vectors leave most room for a link."""
    pairs = [np.empty((0, 2), np.int64)]
    read = [unpack(x)[:2] for x in packed]
    widths = np.array([len(v) for v, _ in read])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        rows = rows[np.argsort(ids[rows] * np.int64(-7046029254386353131) >> 7, kind="stable")]
        if len(rows) < 2:
            continue
        v, over, n, c = np.stack([read[i][0] for i in rows]), np.array([read[i][1] for i in rows]), sizes[rows], comps[rows]
        best = np.full((2, len(rows)), -1.0)
        other = np.zeros((2, len(rows)), np.int64)
        for k in range(1, min(GLANCES, len(rows) - 1) + 1):
            j = np.roll(np.arange(len(rows)), -k)
            room = (7 * (np.minimum(v, v[j]).sum(axis=1, dtype=np.int32) + over + over[j]) - 3 * (n + n[j])) / (n + n[j])
            room = np.where(c != c[j], room, -1.0)
            first, second = room > best[0], (room <= best[0]) & (room > best[1])
            best[1], other[1] = np.where(first, best[0], np.where(second, room, best[1])), np.where(first, other[0], np.where(second, j, other[1]))
            best[0], other[0] = np.where(first, room, best[0]), np.where(first, j, other[0])
        for room, j in zip(best, other):
            a, b = ids[rows[room >= 0]], ids[rows[j[room >= 0]]]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


def _searched(common: Broadcast, glance: bool):
    """Rows come by neighbourhood and pair of blocks; one at a time is glanced at or searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        seen = [np.empty((0, 2), np.int64)]

        def searched() -> np.ndarray:
            block, sig, n, comp = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            if glance:
                return glances(sig, n, comp, [r[4] for r in rows])
            found = ranks_in(np.array([key[0]], np.uint64), common.value)
            return survivors(sig, n, comp, [r[4] for r in rows], int(found[0]) if len(found) else -1, block if key[2] or block.any() else None, key[1], key[2])

        def together() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(seen), axis=0)
            return record_batch({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])}, LINKS)

        for batch in batches:
            for item, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (item, lo, hi) != key:
                    if rows:
                        seen.append(searched())
                    key, rows = (item, lo, hi), []
                rows.append(row)
            if sum(map(len, seen)) > 300_000:
                yield together()
                seen = [np.empty((0, 2), np.int64)]
        if rows:
            seen.append(searched())
        yield together()

    return run


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Texts without words, null ones too, link with nothing and are their own component.  Rows with one id are one document
    as far as their texts are equal; a null id stays null and gives no smallest id.  An empty table gives no rows.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made, common = sets(docs, frequent(docs))
    kept, spent = table(made, "sets"), [common]
    blobs = kept.where("items is not null").select("sig", "n", "items").mapInArrow(_prefixes(slices_of(parts)), "q int, items binary, sigs binary, sizes binary, counts binary")
    met = table(blobs.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(tidy(_met), ", ".join(f"{c} long" for c in MET.names)), "met")
    large = table(met.where(F.col("kind") == LARGE).select(F.col("a").alias("item"), F.col("b").alias("sig"), "n").distinct(), "large")
    pairs = table(met.where(F.col("kind") != LARGE).groupBy("kind", "a", "b").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"), F.max("least").alias("least")), "counted")
    drop(met)

    def looked_through(rows: DataFrame, glance: bool) -> DataFrame:
        vectors = pick(kept, rows.select(F.col("sig").alias("id")), spent, common).select("sig", "items")
        rows = rows.join(vectors, "sig").select("item", "lo", "hi", "block", "sig", "n", "comp", "items")
        return rows.repartition(parts, "item", "lo", "hi").sortWithinPartitions("item", "lo", "hi").mapInArrow(tidy(_searched(common, glance)), "a long, b long")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    # Contraction: the partner with most shared items, by id among equals, if they are a good part of the prefix; and glances at large neighbourhoods.
    near = pairs.where(F.col("shared") * 12 >= F.col("n")).select("a", "b", "shared")
    best = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    # A few neighbourhoods a class do for glances, in parts of BLOCK classes; classes that share many take the same ones.
    blocks = large.groupBy("item").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("item"))
    some = large.withColumn("place", place).where(F.col("place") <= GLANCED).join(blocks, "item")
    dealt = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    some = table(some.select("item", dealt.alias("lo"), dealt.alias("hi"), F.lit(0).alias("block"), "sig", "n", F.col("sig").alias("comp")), "some")
    tried = table(ordered(best).unionByName(ordered(looked_through(some, True))).distinct(), "pairs")
    first = table(verify(tried, kept, spent), "links", compact=True)
    comps = components(first)
    drop(some)

    # Search of all that is still apart.
    of = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"comp_{c}"))
    labelled = large.join(of("sig"), "sig", "left").select("item", "sig", "n", F.coalesce("comp_sig", "sig").alias("comp"))
    open_ = table(labelled.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(tidy(_unfinished), "item long, lo int, hi int, block int, sig long, n long, comp long"), "open", compact=True)
    # Pairs of small neighbourhoods, by how many they share; of large ones they may share as many as either is in.
    rooms = table(open_.select("item", "sig").distinct().groupBy("sig").agg(F.count("*").alias("more")), "rooms")
    rest = pairs.where(F.col("kind") == SMALL)
    for side in ("a", "b"):
        rest = rest.join(rooms.select(F.col("sig").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    rest = rest.where(F.col("shared") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) >= F.col("least"))
    for side in ("a", "b"):
        rest = rest.join(of(side), side, "left")
    rest = rest.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
    late = table(ordered(looked_through(open_, False).unionByName(rest)).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    drop(open_, rooms, pairs, large, tried)
    links = table(first.unionByName(verify(late, kept, spent)), "links", compact=True)
    comps_after = components(links)

    firsts = kept.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"))
    named = firsts.join(comps_after.withColumnRenamed("id", "sig"), "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("comp"))
    named = table(named, "named")
    ids = table(kept.select("doc_id", "n", "sig"), "ids", compact=True)
    drop(kept, late, first, links, comps, comps_after)
    for shared in spent:
        shared.destroy()
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_sig = named.join(least, "comp").select("sig", "component_id")
    return ids.join(by_sig, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
