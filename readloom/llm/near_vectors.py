"""Near-duplicate vectors by p-stable hashing.

Vectors are scaled to length one and hashed into several tables; a table's bucket is given by quantised projections on
Gaussian directions, which near vectors share often and others seldom.  Only bucket, class and a sketch of the signs of
128 more projections are shuffled.  Of a bucket, vectors whose sketches differ in no more bits than a pair at the threshold
may are joined by as few pairs as connect them.  What all buckets connect is a neighbourhood: its vectors are fetched once
and compared exactly, in double precision, in blocks.  No pair is ever written: blocks yield each vector's number of
links and enough links to connect what is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from readloom.llm.common import drop, partitions, record_batch, table, tidy
from readloom.llm.graph import components

#: Width of a quantised step; vectors that a bucket should have at random; share of pairs just at the threshold to be found.
WIDTH, LOAD, RECALL = 2.0, 64, 0.97
SEED = 20_000
#: Vectors of a neighbourhood that a task compares with as many others at once; vectors of a bucket whose sketches are all compared at once.
BLOCK, SMALL = 4_096, 512
#: Bits of a sketch, and how many standard deviations more of them may differ than do on average at the threshold.
BITS, SLACK = 128, 4.0


def meets(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors so far apart fall into one step of a projection (Datar et al., 2004)."""
    if not distance:
        return 1.0
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, least: float) -> tuple[int, int]:
    """Projections to a table, so that about LOAD of ``n`` unrelated vectors meet; tables, so that RECALL of the pairs at ``least`` do."""
    far = meets(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 1) / LOAD) / -math.log(far))) if n > LOAD else 2
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meets(math.sqrt(2 - 2 * least)) ** k)))


class Tables:
    """The hash functions; the same for each dimension wherever they are made."""

    def __init__(self, dim: int, k: int, tables: int):
        rng = np.random.default_rng([SEED, dim])
        self.k, self.tables = k, tables
        self.directions, self.shifts = rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)
        self.mix = rng.integers(1, 1 << 62, (tables, k)) | 1
        self.signs = rng.standard_normal((dim, BITS))

    def sketches(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.signs > 0, axis=1).view(np.int64)

    def buckets(self, units: np.ndarray) -> np.ndarray:
        steps = np.floor((units @ self.directions + self.shifts) / WIDTH).astype(np.int64).reshape(len(units), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = (steps * self.mix).sum(axis=2)
            h ^= h >> 29
            h *= np.int64(-4658895280553007687)
        return h ^ (h >> 32)


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null or zero or has a null or non-finite component."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _units(kind: str):
    """``vec_id, sig, x``: the hash of the vector at length one, and the vector, of equal ones about once a task."""
    schema = pa.schema([("vec_id", pa.int64()), ("sig", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs: list[int | None] = []
            data: list[bytes | None] = []
            for v in batch.column(1).to_pylist():
                u = unit(v)
                sig = None if u is None else xxhash.xxh3_64_intdigest((u + 0.0).tobytes()) - (1 << 63)
                sigs.append(sig)
                data.append(None if sig is None or sig in seen else np.array(v, kind).tobytes())
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
            yield record_batch({"vec_id": batch.column(0), "sig": sigs, "x": data}, schema)

    return run


def units_of(data: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one from vectors of one length that have a direction."""
    x = np.stack([np.frombuffer(v, kind) for v in data]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_made: dict[tuple, Tables] = {}


def _tables(dim: int, k: int, tables: int) -> Tables:
    if (dim, k, tables) not in _made:
        _made[dim, k, tables] = Tables(dim, k, tables)
    return _made[dim, k, tables]


def _hashed(k: int, tables: int, kind: str):
    """``bucket, sig, s0, s1``: the bucket's hash tells the table and the length of the vector too."""
    schema = pa.schema([(c, pa.int64()) for c in ("bucket", "sig", "s0", "s1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, data = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            widths = np.array([len(x) for x in data])
            for width in np.unique(widths):
                for mine in np.array_split(np.flatnonzero(widths == width), -(-int((widths == width).sum()) // 500)):
                    units = units_of([data[i] for i in mine], kind)
                    hashes = _tables(units.shape[1], k, tables)
                    with np.errstate(over="ignore"):
                        h = hashes.buckets(units) * np.int64(tables) + np.arange(tables)
                    s0, s1 = (np.repeat(c, tables) for c in np.ascontiguousarray(hashes.sketches(units).T))
                    yield record_batch({"bucket": h.ravel(), "sig": np.repeat(sigs[mine], tables), "s0": s0, "s1": s1}, schema)

    return run


def most_bits(least: float) -> int:
    """Bits in which sketches of vectors with a cosine of ``least`` may differ: each does with the same probability."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return min(BITS, math.ceil(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p))))


def alike(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of ``a`` (sketches in two words) differ in ``most`` bits at most from which of ``b``."""
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1]) <= most


def spanning(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a symmetric matrix, one fewer than the places they connect."""
    left = near.any(axis=1)
    while left.any():
        start = int(np.argmax(left))
        reached = np.zeros(len(near), bool)
        front = np.zeros(len(near), bool)
        front[start] = True
        while front.any():
            reached |= front
            front = near[front].any(axis=0) & ~reached
        yield from ((start, int(i)) for i in np.flatnonzero(reached) if i != start)
        left &= ~reached


def connected(sketches: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all of a bucket's vectors that alike sketches connect.

    A bucket of more than SMALL is dealt to leaders first: each takes all left that are like it.  Members of one leader are
    connected, so only the smaller groups' members are compared with those of other groups.
    """
    m = len(sketches)
    if m <= SMALL:
        near = alike(sketches, sketches, most)
        np.fill_diagonal(near, False)
        yield from spanning(near)
        return
    left, groups = np.arange(m), []
    while len(left):
        own = alike(sketches[left[:1]], sketches[left], most)[0]
        own[0] = True
        groups.append(left[own])
        yield from ((int(left[0]), int(i)) for i in left[own][1:])
        left = left[~own]
    groups.sort(key=len, reverse=True)
    of = np.empty(m, np.int64)
    for g, members in enumerate(groups):
        of[members] = g
    # Each group against all larger ones.
    before = groups[0]
    for members in groups[1:]:
        met: set[int] = set()
        for at in range(0, len(before), 1 << 20 if len(members) < 8 else max(SMALL, (1 << 23) // len(members))):
            part = before[at : at + (1 << 20 if len(members) < 8 else max(SMALL, (1 << 23) // len(members)))]
            i, j = np.nonzero(alike(sketches[members], sketches[part], most))
            for g, first in zip(*np.unique(of[part[j]], return_index=True)):
                if int(g) not in met:
                    met.add(int(g))
                    yield int(part[j[first]]), int(members[i[first]])
        before = np.concatenate([before, members])


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(most: int):
    """Pairs of classes, from ``bucket, sig, s0, s1`` that come by bucket and class; holds 24 bytes a class of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def done(rows: np.ndarray) -> None:
            rows = rows[np.r_[True, rows[1:, 1] != rows[:-1, 1]]]  # a class may come from several tasks
            if len(rows) > 1:
                out.extend((int(rows[i, 1]), int(rows[j, 1])) for i, j in connected(rows[:, 2:], most))

        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for part in np.split(rows, cuts):
                if parts and len(part) and parts[-1][-1, 0] != part[0, 0]:
                    done(np.concatenate(parts))
                    parts = []
                if len(part):
                    parts.append(part)
            if len(out) > 10_000:
                yield record_batch(dict(zip("ab", zip(*set(out)))), PAIRS)
                out.clear()
        if parts:
            done(np.concatenate(parts))
        if out:
            yield record_batch(dict(zip("ab", zip(*set(out)))), PAIRS)

    return run


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def compare(ids: np.ndarray, copies: np.ndarray, units: np.ndarray, sides: np.ndarray | None, least: float) -> Iterator[tuple]:
    """(class, None, links) of each vector and links (class, class) that connect what is linked here.

    ``sides`` are the blocks of the vectors if two blocks are compared with each other; pairs within one then count elsewhere.
    """
    n = len(ids)
    near = np.empty((n, n), bool)
    for at in range(0, n, 512):
        np.greater_equal(units[at : at + 512] @ units.T, least, out=near[at : at + 512])
    near |= near.T  # the two halves may differ in the last bit
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    links = np.concatenate([near[at : at + 512] @ copies for at in range(0, n, 512)])
    yield from ((int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links))
    yield from ((int(ids[i]), int(ids[j]), 0) for i, j in spanning(near))


def _compared(least: float, kind: str):
    """Rows come by neighbourhood, pair of blocks and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def done() -> None:
            for width in {len(r[3]) for r in rows}:
                mine = [r for r in rows if len(r[3]) == width]
                if len(mine) > 1:
                    sides = np.array([r[0] for r in mine]) if key[1] != key[2] else None
                    out.extend(compare(np.array([r[1] for r in mine], np.int64), np.array([r[2] for r in mine], np.int64), units_of([r[3] for r in mine], kind), sides, least))

        for batch in batches:
            for comp, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (comp, lo, hi) != key:
                    if len(rows) > 1:
                        done()
                    key, rows = (comp, lo, hi), []
                rows.append(row)
            if out:
                yield record_batch(dict(zip(FOUND.names, map(list, zip(*out)))), FOUND)
                out.clear()
        if len(rows) > 1:
            done()
        if out:
            yield record_batch(dict(zip(FOUND.names, map(list, zip(*out)))), FOUND)

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
    don't link.  Equal vectors are one class, so copies are never compared; each still counts as a link.  Rows with null ids
    link like others, but a null id is nobody's smallest: without another id their component is null.  An empty table gives no rows.
    """
    spark, parts = vectors.sparkSession, partitions(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType
    kind = "<f4" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = table(rows.mapInArrow(tidy(_units(kind)), "vec_id long, sig long, x binary"), "units")
    classes = table(units.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "classes")
    k, tables = plan(classes.count(), least)
    hashed = units.where("x is not null").select("sig", "x").mapInArrow(tidy(_hashed(k, tables, kind)), "bucket long, sig long, s0 long, s1 long")
    near = hashed.repartition(parts, "bucket").sortWithinPartitions("bucket", "sig").mapInArrow(tidy(_candidates(most_bits(least))), "a long, b long")
    near = table(near.distinct(), "near")
    hoods = components(near).select(F.col("id").alias("sig"), F.col("component").alias("hood"))

    # Vectors of neighbourhoods, each once: to its block, or, beyond BLOCK vectors, to each pair of blocks.
    blocks = hoods.groupBy("hood").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = hoods.join(blocks, "hood").join(classes.select("sig", "copies"), "sig")
    fetched = units.where("x is not null").select("sig", "x").join(asked, "sig").dropDuplicates(["sig"])
    dealt = fetched.withColumn("side", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hood", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "sig", "copies", "x")
    dealt = dealt.repartition(parts, "hood", "lo", "hi").sortWithinPartitions("hood", "lo", "hi", "sig")
    found = table(dealt.mapInArrow(tidy(_compared(least, kind)), "a long, b long, links long"), "found", compact=True)

    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "sig")
    comps = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "sig")
    named = classes.join(links, "sig", "left").join(comps, "sig", "left").select("sig", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "sig").alias("comp"))
    named = table(named, "named")
    ids = table(units.select("vec_id", "sig"), "ids")
    drop(units, classes, near, found)
    firsts = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    out = ids.join(named.join(firsts, "comp").select("sig", "n_links", "component_id"), "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
