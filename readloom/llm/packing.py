"""Packing of token sequences into as few bins as can be, with certificates.

1. Executors tokenise each text and cut what is longer than a bin into pieces.
2. Pieces are dealt at random over groups of a bounded number of pieces; each group runs best-fit decreasing.
3. Dual feasible functions give each group a number of bins that no packing can beat.  A group that reaches it is
   certified; groups with a gap pool their pieces with those of other such groups, are dealt anew and run again,
   and a new packing replaces the old ones only if it uses fewer bins.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import drop, each_batch, small_batches, table
from readloom.llm.tokens import byte_letters

#: Pieces to a group, on average.  More pieces leave less slack to a group; a group has to fit a task.
GROUP = 16_000
ROUNDS = 3


class ByteEncoder:
    """Ids as the byte-level BPE of a tokenizers file gives them, special strings in texts included.

    The merges run in a faster library when the file's ids are in the order of its merges, as there a lower id is merged first;
    otherwise in the library of the file.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
        ids = [vocab["".join(x.split(" "))] for x in merges]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"]["use_regex"] and not model.get("ignore_merges")
        if plain and ids == sorted(set(ids)) and len(vocab) == len(ids) + 256:
            import tiktoken

            back = {c: i for i, c in enumerate(byte_letters())}
            # Fixed value: the pattern of byte-level pre-tokenisation.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(back[c] for c in k): v for k, v in vocab.items()}, special_tokens={x["content"]: x["id"] for x in spec["added_tokens"]})
            self.encode = lambda text: fast.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(tokenizer_json)
            self.encode = lambda text: slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and then ``end_id``, in pieces of at most ``size``; of a longer text the first piece takes what is left over.  A null text is empty: its piece is ``end_id`` alone.  A repeated row is cut again."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    own: list[ByteEncoder] = []

    def cut(batch: pa.RecordBatch) -> dict:
        if not own:
            own.append(ByteEncoder(shared.value))
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(array("I", [*(own[0].encode(text) if text else ()), end_id]), np.uint32).astype("<u4", copy=False)
            first = len(ids) % size or size
            start = 0
            for k, end in enumerate(range(first, len(ids) + 1, size)):
                rows.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                start = end
        return dict(zip(schema.names, map(list, zip(*rows))))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each_batch(cut, schema), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length by best-fit decreasing, and the number of bins.

    The open bins stand in stacks by the room they have; one integer has a bit for each stack that isn't empty, so
    the tightest bin with enough room is found by a shift.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    filled, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := filled >> n:
            room = n + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                filled ^= 1 << room
        else:
            room, at, used = size, used, used + 1
        bins[i], offsets[i] = at, size - room
        if left := room - n:
            stacks[left].append(at)
            filled |= 1 << left
    return bins, offsets, used


def bound(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing can beat: the largest that two families of dual feasible functions give.

    One rounds lengths over ``size - t`` up to a bin and drops those under ``t``; the other rounds to multiples of
    ``size / k``, in the direction that keeps sums of a bin within it.
    """
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    most = -(-int((n * x).sum()) // size)
    for t in range(1, size // 2 + 1):
        most = max(most, int(n[size - t + 1 :].sum()) - (-int((n * x)[t : size - t + 1].sum()) // size))
    for k in range(1, 100):
        # u(x) = x if (k+1)x is a multiple of size, else floor((k+1)x / size) * size / k, in units of size / (k (k+1)).
        whole = (k + 1) * x % size == 0
        scaled = np.where(whole, k * ((k + 1) * x // size), (k + 1) * ((k + 1) * x // size))
        most = max(most, -(-int((n * scaled).sum()) // (k * (k + 1))))
    return most


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, bins long, least long"


def _run(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Packs a group; keeps the packings it had if the new one isn't better."""
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=False, kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit(lengths, size)
        had = int(group.drop_duplicates("grp")["bins"].sum()) if "bins" in group else None
        if had is not None and used >= had:
            return group.drop(columns="pool")
        return group.drop(columns="pool", errors="ignore").assign(grp=int(group["pool" if "pool" in group else "grp"].iloc[0]), bin=bins, offset=offsets, bins=used, least=bound(lengths, size))

    return run


def pack(parts: DataFrame, *, size: int = 2048, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``certified`` to the rows of :func:`pieces`.

    Repeated rows are packed as often as they occur; an empty table gives no rows.  After ``rounds`` exchanges a gap that
    is left stays: rows of groups that aren't proven to be in as few bins as can be aren't ``certified``.
    """
    parts = table(parts, "pieces")
    spent = [parts]
    total = parts.count()
    groups = max(1, round(total / group))
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)).cast("long")
    if groups > 1:  # equal rows, were there very many of them, would meet in a group: deal them apart
        key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    open_, closed = table(parts.withColumn("grp", key).groupBy("grp").applyInPandas(_run(size), _PACKED), "packed"), []
    spent.append(open_)
    for turn in range(1, rounds + 1):
        closed.append(open_.where("bins <= least"))
        open_ = open_.where("bins > least")
        n = open_.select("grp").distinct().count()
        if n < 2:
            break
        # Each exchange deals the groups with a gap over half as many pools, otherwise each time; a row tells its group's gap itself.
        pool = F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(n // 2)) + F.lit(turn << 40)
        open_ = table(open_.withColumn("pool", pool).groupBy("pool").applyInPandas(_run(size), _PACKED), "packed")
        spent.append(open_)
    done = open_
    for x in closed:
        done = done.unionByName(x)
    sequence = (F.col("grp") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id")
    out = table(done.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset", (F.col("bins") <= F.col("least")).alias("certified")), "sequences")
    drop(*spent)
    return out
