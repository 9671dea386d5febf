"""Document fingerprints as invertible Bloom look-up sketches of paragraph digests.

A text is cut into paragraphs (lines, and the sentences of a line, so that a text of a single line has parts too);
each part's 64-bit digest goes into one cell of each of three rows.  A cell holds how many digests it got, their XOR
and the XOR of their check words.  Subtracting two sketches leaves the digests in which the texts differ, and peeling
reads them out as long as some cell holds just one.  When peeling gets stuck both sketches are made again
larger, until it ends.  The likeness of two texts is the Jaccard coefficient of their multisets of parts, which follows
from their sizes and the number of differing digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from readloom.llm.common import partitions, record_batch, small_batches, tidy

CELLS = 24
ROWS = 3
#: A part ends after a line, after a sentence, or, in a long run without either, after a word that ends like one in eight or so.
_ENDS = re.compile(r"[^\n.!?]*(?:[.!?]+[ \t]*\n*|\n+|$)")
_LONG, _INNER = 400, re.compile(r".*?(?:[snt]\s|$)", re.S)
_MASK, _K = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def parts(text: str) -> list[str]:
    out: list[str] = []
    for part in _ENDS.findall(text):
        if len(part) > _LONG:
            out += [x for x in _INNER.findall(part) if x]
        elif part:
            out.append(part)
    return out


def digests(text: str) -> list[int]:
    """One digest a part, all different; the second, third ... occurrence of a part has digests of its own."""
    seen: dict[str, int] = {}
    out: dict[int, None] = {}
    for part in parts(text):
        n = seen[part] = seen.get(part, 0) + 1
        out[xxhash.xxh3_64_intdigest(part if n == 1 else f"{n}\0{part}")] = None
    return list(out)


class Sketch:
    """``cells`` in three rows; equal sets of digests give equal sketches."""

    __slots__ = ("counts", "keys", "checks", "width")

    def __init__(self, cells: int = CELLS):
        self.width = -(-cells // ROWS)
        n = self.width * ROWS
        self.counts, self.keys, self.checks = [0] * n, [0] * n, [0] * n

    @classmethod
    def of(cls, items: list[int], cells: int = CELLS) -> Sketch:
        out = cls(cells)
        for digest in items:
            out.add(digest, 1)
        return out

    def add(self, digest: int, times: int) -> tuple[int, int, int]:
        """Puts a digest into a cell of each row, or takes it out; gives their places."""
        w, counts, keys, checks = self.width, self.counts, self.keys, self.checks
        check = (digest * _K[3] & _MASK) >> 32
        a = ((digest * _K[0] & _MASK) >> 33) * w >> 31
        b = (((digest * _K[1] & _MASK) >> 33) * w >> 31) + w
        c = (((digest * _K[2] & _MASK) >> 33) * w >> 31) + w + w
        counts[a] += times
        counts[b] += times
        counts[c] += times
        keys[a] ^= digest
        keys[b] ^= digest
        keys[c] ^= digest
        checks[a] ^= check
        checks[b] ^= check
        checks[c] ^= check
        return a, b, c

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch.__new__(Sketch)
        out.width = self.width
        out.counts = [a - b for a, b in zip(self.counts, other.counts)]
        out.keys = [a ^ b for a, b in zip(self.keys, other.keys)]
        out.checks = [a ^ b for a, b in zip(self.checks, other.checks)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests only the first and only the second had; None if peeling gets stuck.  Empties this sketch."""
        mine: list[int] = []
        theirs: list[int] = []
        ready = [i for i, n in enumerate(self.counts) if n in (1, -1)]
        while ready:
            at = ready.pop()
            n, digest = self.counts[at], self.keys[at]
            if n not in (1, -1) or (digest * _K[3] & _MASK) >> 32 != self.checks[at]:
                continue
            (mine if n == 1 else theirs).append(digest)
            ready += [i for i in self.add(digest, -n) if self.counts[i] in (1, -1)]
        return None if any(self.counts) or any(self.keys) else (mine, theirs)

    def text(self, n: int) -> str:
        return f"{n}:" + base64.b64encode(struct.pack(f"<{len(self.counts)}i{len(self.keys)}Q{len(self.checks)}I", *self.counts, *self.keys, *self.checks)).decode()


def differing(a: list[int], b: list[int], first: tuple[Sketch, Sketch] | None = None) -> tuple[list[int], list[int]]:
    """The digests in only ``a`` and only ``b``, recovered by peeling.

    When that fails, sketches are made with 3/2 cells for each digest of either side, and twice as large from then on.
    """
    cells = CELLS
    while True:
        x, y = first if first and cells == CELLS else (Sketch.of(a, cells), Sketch.of(b, cells))
        if (got := x.minus(y).peel()) is not None:
            return got
        cells = max(2 * cells, (len(a) + len(b)) * 3 // 2 + CELLS) if cells == CELLS else 2 * cells


def likeness(a: list[int], b: list[int], first: tuple[Sketch, Sketch] | None = None) -> float:
    """Jaccard coefficient of two sets of digests, 1 for two empty ones."""
    if not a and not b:
        return 1.0
    n = sum(map(len, differing(a, b, first)))
    return (len(a) + len(b) - n) / (len(a) + len(b) + n)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and id; each is compared with the one after it, the last of a bucket with the bucket's end mark."""
    before = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, ends, doc, text in zip(*(x.to_pylist() for x in batch.columns)):
            if before is None and ends:
                continue
            own = digests(text)
            sketch = Sketch.of(own)
            if before is not None and before[0] == bucket:
                _, doc0, text0, own0, sketch0 = before
                k = len(text0) // 4
                edited = text0[: len(text0) - k] + text[:k]
                new = digests(edited)
                newer = Sketch.of(new)
                out.append((doc0, len(text0), hashlib.sha256(edited.encode()).hexdigest(), sketch0.text(len(own0)), newer.text(len(new)), likeness(own0, new, (sketch0, newer)), likeness(own0, own, (sketch0, sketch))))
            before = None if ends else (bucket, doc, text, own, sketch)
        if out:
            yield record_batch(dict(zip(SCHEMA.names, map(list, zip(*out)))), SCHEMA)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, with likenesses to that and to the next document's.

    The next document is that with the next larger id; equal ids go by their texts, null ids come first, and the first
    document follows the last.  A null text is empty.  A single document follows itself; an empty table gives no rows.

    Documents are dealt over ranges of ids, a range a partition.  The first document of a range is also sent, as an end
    mark, to the range before it, so no order over all rows in one place is needed.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = np.unique(np.array(rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n), np.float64).astype(np.int64)) if n > 1 else np.empty(0, np.int64)

    # Ranges go by numbers of which the shuffle's hash deals one to each partition.
    found = spark.range(0, 64 * n, numPartitions=1).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()
    numbers = np.array(sorted(r["x"] for r in found) if len(found) == n else range(n), np.int32)

    @F.pandas_udf(IntegerType())
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(numbers[np.searchsorted(cuts, k.to_numpy(), side="right")])

    firsts = sorted(tuple(r) for r in rows.select("k", bucket_of("k").alias("bucket")).groupBy("bucket").agg(F.min("k").alias("k")).select("k", "bucket").collect())  # a row a range
    marks = [(k, firsts[i - 1][1]) for i, (k, _) in enumerate(firsts)]
    ends = rows.join(F.broadcast(spark.createDataFrame(marks or [(0, 0)], "k long, bucket int").limit(len(marks))), "k")
    both = rows.withColumn("bucket", bucket_of("k")).withColumn("ends", F.lit(False)).unionByName(ends.withColumn("ends", F.lit(True)))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "ends", "k", "text")
    return dealt.select("bucket", "ends", "doc_id", "text").mapInArrow(tidy(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
