"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and small Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  Only a local session may leave it unset (a temporary folder then serves)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="readloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/readloom/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing that was written.

    ``compact`` brings what many tasks have a few rows of into files of a fair size, as many as that takes.
    """
    df = df.hint("rebalance") if compact else df
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")  # what the write shuffled isn't read again: the table is
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    give_back()  # what the driver needed to get here
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`table` that no later plan reads."""
    for df in frames:
        delete(df.sparkSession, df._readloom_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Have Arrow send Python at most 1,000 rows and 2 MB at once from now on: texts and pages can be long, and a worker and an executor's buffers hold a batch several times."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0]) * 1024 ** "bkmgt".index(re.search(r"[kmgt]?b?$", spark.conf.get(key).lower())[0][:1] or "b")
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(id_col: str, remainder: int = 2, of: int = 4) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == remainder, F.lit(False))


def each_batch(fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that turns a batch into columns; a column ``kept`` passes as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := fn(batch)) is not None:
                yield record_batch(columns, schema if "kept" not in columns else schema.append(pa.field("kept", columns["kept"].type)))

    return tidy(run)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives freed memory back to the system when a task ends, as workers wait for the next task and an executor's memory counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def kept_as(docs: DataFrame, keep: list[str] | None) -> tuple[list[Column], str]:
    """For operators that may keep columns of their input beside their own: a struct ``kept`` to select, and its part of the schema."""
    if not keep:
        return [], ""
    kept = F.struct(*(docs[c] for c in keep)).alias("kept")
    return [kept], f", kept {docs.select(kept).schema[0].dataType.simpleString()}"


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


#: Bits for each id in a filter, and how many in all at most; with more ids it lets more rows pass.
FILTER_BITS, FILTER_MOST = 16, 1 << 28


def sieve(ids: DataFrame) -> np.ndarray:
    """A filter with the bits of all ``ids(id)`` set, put together by pages on executors: a power of two of bits, FILTER_MOST at most."""
    bits = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_BITS * ids.count()).bit_length()))
    schema = pa.schema([("page", pa.int64()), ("bits", pa.binary())])
    slot = F.col("id").bitwiseAND(bits - 1)

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.asarray(batch.column(0))
            for p in np.unique(slots >> 16):
                pages.setdefault(int(p), np.zeros(1 << 16, bool))[slots[slots >> 16 == p] & 0xFFFF] = True
        if pages:
            yield record_batch({"page": list(pages), "bits": [np.packbits(x).tobytes() for x in pages.values()]}, schema)

    n = min(partitions(ids.sparkSession), bits >> 16)
    found = ids.select(slot.alias("slot")).distinct().repartition(n, F.shiftright("slot", 16)).mapInArrow(tidy(page), "page long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for p, own in found:
        out[p * 8192 : (p + 1) * 8192] = np.frombuffer(own, np.uint8)
    return out


def may_be_in(filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the ids that a :func:`sieve` doesn't rule out."""
    slot = ids & (8 * len(filled) - 1)
    return np.flatnonzero(filled[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
