"""BAM: alignments in blocks of gzip, after the public SAM/BAM specification.

Tasks decode ranges of a file's blocks.  Nothing in a file says where records begin within a block, so at the beginning of a
range the place is sought from which several records in a row make sense; a task whose records don't lead exactly to the
place where the next range begins aborts, so a wrong guess can't give wrong rows.  Paths are opened by the tasks, so a
folder that all executors mount is needed.  A file of plain gzip is one range.
"""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources.text import SAM_COLUMNS, SAM_NUMBERS, SAM_ORDER

#: Packed bases, operations, and the layouts of tag values.
PACKED, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
LAYOUTS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_BASES, _CODES = {ord(f"{i:x}"): c for i, c in enumerate(PACKED)}, {c: f"{i:x}" for i, c in enumerate(PACKED)}
_LETTERS = bytes((i + 33) % 256 for i in range(256))
#: Bytes of a file to a range; records in a row that have to make sense where one begins.
RANGE, IN_A_ROW = 32 << 20, 6
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def local(path: str) -> str:
    return path.removeprefix("file://")


def _take(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("a BAM file ends within a record")
    return data


def read_header(f: BinaryIO) -> tuple[str, list[str]]:
    """The text of the header and the reference names."""
    if _take(f, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = _take(f, struct.unpack("<i", _take(f, 4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", _take(f, 4))[0]):
        names.append(_take(f, struct.unpack("<i", _take(f, 4))[0]).rstrip(b"\0").decode())
        _take(f, 4)
    return text, names


def float_text(x: float) -> str:
    return f"{x:.9g}"


def _tags(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{LAYOUTS[sub]}", data, at + 5)
            at += 5 + n * struct.calcsize(LAYOUTS[sub])
            out.append(f"{name}:B:{sub}," + ",".join(float_text(v) if sub == "f" else str(v) for v in values))
        else:
            (value,) = struct.unpack_from(f"<{LAYOUTS[kind]}", data, at)
            at += struct.calcsize(LAYOUTS[kind])
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{float_text(value) if kind == 'f' else value}")
    return "\t".join(out)


def decode(data: bytes, names: list[str]) -> dict:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)

    def name_of(i: int) -> str:
        if i >= len(names):
            raise ValueError(f"a record names reference {i}, the header has {len(names)}")
        return names[i] if i >= 0 else "*"

    at = 32 + l_name
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, at))
    at += 4 * n_ops
    seq = data[at : at + (l_seq + 1) // 2].hex().translate(_BASES)[:l_seq]
    at += (l_seq + 1) // 2
    quals = data[at : at + l_seq]
    qual = "*" if not l_seq or quals[0] == 255 else quals.translate(_LETTERS).decode("latin-1")
    qname, tags = data[32 : 32 + l_name - 1].decode(), _tags(data[at + l_seq :])
    row = {"qname": qname, "flag": flag, "rname": name_of(ref), "pos": pos + 1, "mapq": -1 if mapq == 255 else mapq, "cigar": cigar or "*", "rnext": name_of(next_ref), "pnext": next_pos + 1, "tlen": tlen, "seq": seq or "*", "qual": qual, "tags": tags}
    return row | {"id": qname, "desc": tags}


def records(f: BinaryIO, names: list[str]) -> Iterator[dict]:
    while size := f.read(4):
        yield decode(_take(f, struct.unpack("<i", size)[0]), names)


# Encoding, from the columns of SAM.


def _encode_tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    head = name.encode() + kind.encode()
    if len(name) != 2 or kind not in "AifZHB":
        raise ValueError(f"bad tag {text!r}")
    if kind == "A":
        return head + value.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "i":
        return head + struct.pack("<i", int(value)) if -(1 << 31) <= int(value) < 1 << 31 else name.encode() + b"I" + struct.pack("<I", int(value))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    sub, *values = value.split(",")
    return head + sub.encode() + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{LAYOUTS[sub]}", *((float if sub == "f" else int)(v) for v in values))


def _bin(start: int, end: int) -> int:
    """The smallest bin that holds a span, of the specification's binning scheme."""
    end -= 1
    for shift in (14, 17, 20, 23, 26):
        if start >> shift == end >> shift:
            return ((1 << 29 - shift) - 1) // 7 + (start >> shift)
    return 0


def encode(row: dict, ids: dict[str, int]) -> bytes:
    def ref_of(name: str, same: int = -1) -> int:
        if name in ("*", ""):
            return -1
        if name == "=":
            return same
        if name not in ids:
            raise ValueError(f"the header doesn't name reference {name!r}")
        return ids[name]

    ops = []
    digits = ""
    span = 0
    for c in "" if row["cigar"] == "*" else row["cigar"]:
        if c.isdigit():
            digits += c
        else:
            ops.append(int(digits) << 4 | OPERATIONS.index(c))
            span += int(digits) if c in "MDN=X" else 0
            digits = ""
    seq = "" if row["seq"] == "*" else row["seq"]
    packed = bytes.fromhex("".join(map(_CODES.get, seq.upper(), "f" * len(seq))) + "0" * (len(seq) % 2))
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(c) - 33 for c in row["qual"])
    if len(qual) != len(seq):
        raise ValueError(f"{row['qname']}: sequence and quality differ in length")
    ref, pos, mapq = ref_of(row["rname"]), int(row["pos"]) - 1, int(row["mapq"])
    name = (row["qname"] or "*").encode() + b"\0"
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 255 if mapq < 0 else mapq, _bin(max(0, pos), max(0, pos) + max(1, span)), len(ops), int(row["flag"]), len(seq), ref_of(row["rnext"], ref), int(row["pnext"]) - 1, int(row["tlen"]))
    body = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + b"".join(_encode_tag(t) for t in (row["tags"] or "").split("\t") if t)
    return struct.pack("<i", len(body)) + body


def references(header: str) -> list[tuple[str, int]]:
    """Names and lengths of the header's ``@SQ`` lines."""
    out = []
    for line in header.splitlines():
        if line.startswith("@SQ\t"):
            fields = dict(x.split(":", 1) for x in line.split("\t")[1:])
            out.append((fields["SN"], int(fields.get("LN", 0))))
    return out


def block(data: bytes) -> bytes:
    """A block of at most 64 KB that says how long it is."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def top(header: str) -> bytes:
    """The blocks that a file begins with."""
    refs, text = references(header), header.encode()
    start = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    start += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)
    return b"".join(block(start[i : i + 60_000]) for i in range(0, len(start), 60_000))


def write_records(f: BinaryIO, header: str, rows: Iterable[dict]) -> None:
    """Blocks of records, which end with a record; such pieces may follow each other."""
    ids = {name: i for i, (name, _) in enumerate(references(header))}
    pending = bytearray()
    for row in rows:
        pending += encode(row, ids)
        while len(pending) >= 60_000:
            f.write(block(bytes(pending[:60_000])))
            del pending[:60_000]
    if pending:
        f.write(block(bytes(pending)))


def write(f: BinaryIO, header: str, rows: Iterable[dict]) -> None:
    f.write(top(header))
    write_records(f, header, rows)
    f.write(END_BLOCK)


def schema() -> str:
    return "_part int, _place long, " + ", ".join(f"`{c}` {'float' if c in SAM_NUMBERS else 'string'}" for c in SAM_ORDER)


Place = tuple[int, int]  # of a block in the file, and of a byte in the block


def block_size(f: BinaryIO, at: int) -> int | None:
    """How long the block at a place of the file is; 0 at the file's end, None if it doesn't say."""
    f.seek(at)
    head = f.read(12)
    if not head:
        return 0
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, k = f.read(struct.unpack_from("<H", head, 10)[0]), 0
    while k + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, k + 2)[0]
        if extra[k : k + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + n
    return None


class Blocks:
    """The unpacked bytes of a file from a place on, with the place of the next byte."""

    def __init__(self, f: BinaryIO, start: Place = (0, 0)):
        self.f, self.next = f, start[0]
        self.data, self.at, self.block = b"", 0, start[0]
        self._load()
        self.at = start[1]
        self._settle()

    def _load(self) -> bool:
        self.block = self.next
        size = block_size(self.f, self.block)
        if size is None:
            raise ValueError(f"no block at byte {self.block}")
        if not size:
            self.data, self.at = b"", 0
            return False
        self.f.seek(self.block)
        self.data, self.at = zlib.decompress(self.f.read(size), 31), 0
        self.next = self.block + size
        return True

    def _settle(self) -> None:
        while self.at >= len(self.data) and self._load():
            pass

    @property
    def place(self) -> Place:
        return self.block, self.at

    def read(self, n: int) -> bytes:
        out = []
        while n and self.data:
            part = self.data[self.at : self.at + n]
            out.append(part)
            n -= len(part)
            self.at += len(part)
            self._settle()
        return b"".join(out)


def _makes_sense(data: bytes, at: int, refs: int) -> int | None:
    """Where the record after one that may begin at ``at`` begins; None if it can't be one."""
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < refs and -1 <= next_ref < refs and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0):
        return None
    if size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(f: BinaryIO, start: int, refs: int) -> Place:
    """The place of the first record that begins in the blocks from ``start`` on; the file's end if none does."""
    f.seek(0, 2)
    end = f.tell()
    held, data, at = [], bytearray(), start
    while at < end:
        size = block_size(f, at)
        if not size:
            break
        f.seek(at)
        held.append((len(data), at))
        data += zlib.decompress(f.read(size), 31)
        at += size
        whole = at >= end
        for i in range(len(data) if whole else max(0, len(data) - 36)):
            k, n = i, 0
            while k is not None and n < IN_A_ROW and k + 36 <= len(data):
                k, n = _makes_sense(data, k, refs), n + 1
            if k is not None and n and (n == IN_A_ROW or whole and k == len(data)):
                lo, block = max(x for x in held if x[0] <= i)
                return block, i - lo
    return end, 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        with open(local(self.path), "rb") as f:
            if block_size(f, 0) is None:
                return [InputPartition((0, None, None))]
            top = Blocks(f)
            _, names = read_header(top)
            places, end = [top.place], f.seek(0, 2)
            at, limit = 0, self.size
            while at < end and (n := block_size(f, at)):  # block by block, by what their heads say
                if at >= limit:
                    if (place := first_record(f, at, len(names))) > places[-1]:
                        places.append(place)
                    limit = at + self.size
                at += n
            return [InputPartition((i, a, b)) for i, (a, b) in enumerate(zip(places, [*places[1:], None]))]

    def read(self, partition):
        i, start, end = partition.value
        if start is None:
            with gzip.open(local(self.path), "rb") as f:
                _, names = read_header(f)
                yield from ((i, n, *self.cells(row)) for n, row in enumerate(records(f, names)))
            return
        with open(local(self.path), "rb") as f:
            _, names = read_header(Blocks(f))
            rows, n = Blocks(f, start), 0
            while rows.data and (end is None or rows.place < end):
                yield (i, n, *self.cells(decode(_take(rows, struct.unpack("<i", _take(rows, 4))[0]), names)))
                n += 1
            if end is not None and rows.place != end:
                raise ValueError(f"{self.path}: records don't lead to the one found at {end}; read the file as one range")

    @staticmethod
    def cells(row: dict) -> Iterator:
        return (float(row[c]) if c in SAM_NUMBERS else row[c] for c in SAM_ORDER)


def record_count(path: str, start: Place, end: Place | None) -> int:
    """How many records a range has, by what they say of their lengths; none is decoded."""
    with open(local(path), "rb") as f:
        rows, n = Blocks(f, start), 0
        while rows.data and (end is None or rows.place < end):
            _take(rows, struct.unpack("<i", _take(rows, 4))[0])
            n += 1
        return n


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; ``range`` is the bytes of a file to a range."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schema()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Alignments with ``_row_id``, their numbers in the file: of a file of several ranges a count a range reaches the driver."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("range", size).load(path)
    if os.path.getsize(local(path)) <= size:
        return rows.withColumnRenamed("_place", "_row_id").drop("_part")
    ranges = [p.value for p in _Reader(path, size).partitions()]
    counts = spark.sparkContext.parallelize(ranges, len(ranges)).map(lambda r: record_count(path, *r[1:])).collect() if len(ranges) > 1 else [0]
    before, starts = 0, []
    for (part, _, _), n in zip(ranges, counts):
        starts.append((part, before))
        before += n
    known = spark.createDataFrame(starts, "_part int, _before long")
    numbered = rows.join(F.broadcast(known), "_part").withColumn("_row_id", F.col("_before") + F.col("_place"))  # a row a range
    return numbered.select("_row_id", *(F.col(c) for c in SAM_ORDER))


def bam_header(path: str) -> str:
    with gzip.open(local(path), "rb") as f:
        return read_header(f)[0]


assert len(SAM_ORDER) == len(SAM_COLUMNS) + 2
