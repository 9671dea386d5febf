"""Where effects go: files named by the rows themselves, counts, means and standard output."""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from itertools import groupby
from typing import TextIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from readloom.functions.display import display
from readloom.sources import bam
from readloom.sources.text import SAM_COLUMNS

PROGRAM = "readloom"


def writer_of(filename: str) -> str:
    """The kind of file that an extension asks for; any other is text, a line a value."""
    ext = filename.rsplit(".", 1)[-1] if "." in filename else ""
    return {"fa": "fasta", "fasta": "fasta", "fq": "fastq", "fastq": "fastq", "sam": "sam", "bam": "bam"}.get(ext, "text")


#: The fields each kind of file needs.
NEEDS = {"fasta": ["seq", "id", "desc"], "fastq": ["seq", "id", "desc", "qual"], "sam": SAM_COLUMNS, "bam": SAM_COLUMNS}


def _headed(read: Column) -> Column:
    return F.when(read["desc"] == "", read["id"]).otherwise(F.concat(read["id"], F.lit(" "), read["desc"]))


def as_fasta(read: Column) -> Column:
    return F.concat(F.lit(">"), _headed(read), F.lit("\n"), read["seq"])


def as_fastq(read: Column) -> Column:
    return F.concat(F.lit("@"), _headed(read), F.lit("\n"), read["seq"], F.lit("\n+\n"), read["qual"])


def as_sam(read: Column, kind: StructType) -> Column:
    cells = []
    for c in SAM_COLUMNS:
        x = read[c]
        if c == "mapq":
            x = F.when(x < 0, F.lit(255)).otherwise(x.cast("bigint"))
        cells.append(x.cast("bigint").cast("string") if isinstance(kind[c].dataType, NumericType) else x)
    *fixed, tags = cells
    return F.concat_ws("\t", *fixed, F.when(tags != "", tags))


def body_for(value: Column, kind, filename: Column) -> Column:
    """The text of a value in the file it goes to; a value that the file's kind doesn't take aborts."""
    ext = F.regexp_extract(filename, r"\.([^.]*)$", 1)
    names = {f.name for f in kind.fields} if isinstance(kind, StructType) else set()
    can = {k: set(need) <= names for k, need in NEEDS.items()}
    wrong = F.raise_error(F.concat(F.lit("this value can't be written to "), filename)).cast("string")
    return (
        F.when(ext.isin("fa", "fasta"), as_fasta(value) if can["fasta"] else wrong)
        .when(ext.isin("fq", "fastq"), as_fastq(value) if can["fastq"] else wrong)
        .when(ext.isin("sam", "bam"), as_sam(value, kind) if can["sam"] else wrong)
        .otherwise(value if isinstance(kind, StringType) else wrong)
    )


def program_line(header: str, command: str = "") -> str:
    """The header with a line that names this program, of an id that the header hasn't."""
    ids, n = {x.split("ID:")[1].split("\t")[0] for x in header.splitlines() if x.startswith("@PG") and "ID:" in x}, 0
    own = PROGRAM
    while own in ids:
        n += 1
        own = f"{PROGRAM}-{n}"
    cells = ["@PG", f"ID:{own}", f"PN:{PROGRAM}", *([f"CL:{command}"] if command else [])]
    return header + "\t".join(cells) + "\n"


def _bam_row(line: str) -> dict:
    cells = line.split("\t", 11)
    row = dict(zip(SAM_COLUMNS, cells)) | {"tags": cells[11] if len(cells) > 11 else ""}
    return row | {"mapq": -1 if row["mapq"] == "255" else row["mapq"]}


def _target(folder: str, name: str) -> str:
    target = os.path.normpath(os.path.join(folder, name))
    if os.path.commonpath([os.path.abspath(folder), os.path.abspath(target)]) != os.path.abspath(folder) or not os.path.basename(name):
        raise ValueError(f"{name!r} isn't the name of a file within the output folder")
    return target


def _hidden(target: str, piece: int | str = "whole") -> str:
    return os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{piece}.part")


def _ends(name: str, top: str) -> tuple[bytes, bytes]:
    """What a file of that name begins and ends with."""
    kind = writer_of(name)
    return (bam.top(top), bam.END_BLOCK) if kind == "bam" else (top.encode() if kind == "sam" else b"", b"")


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows by name and order in ranges of about as many, so that what a task has doesn't grow with a name's rows."""
    return rows.repartitionByRange("filename", *order).sortWithinPartitions("filename", *order)


def _join(spark: SparkSession, files: list[tuple[str, bytes, list[str], bytes]]) -> None:
    """Files (target, head, pieces, tail) of a mounted folder: tasks copy a piece each to its place in a hidden file, which takes the name when all are there."""
    copies = []
    for target, head, pieces, tail in files:
        with open(_hidden(target), "wb") as f:
            f.write(head)
            for piece in pieces:
                copies.append((piece, _hidden(target), f.tell()))
                f.seek(os.path.getsize(piece), os.SEEK_CUR)
            f.write(tail)
            f.truncate()

    def copy(job: tuple[str, str, int]) -> None:
        piece, hidden, at = job
        with open(piece, "rb") as f, open(hidden, "r+b") as out:
            out.seek(at)
            shutil.copyfileobj(f, out, 1 << 20)

    if copies:
        spark.sparkContext.parallelize(copies, min(len(copies), 1000)).foreach(copy)
    for target, _, pieces, _ in files:
        os.replace(_hidden(target), target)
        for piece in pieces:
            os.unlink(piece)


def write_files(rows: DataFrame, folder: str, header: str = "", command: str = "") -> None:
    """Write ``rows(filename, order..., body)``, a file a name, in the order of the columns between.

    A folder with a scheme other than ``file`` is written by :func:`write_anywhere`.  Elsewhere a task has a range of names and of
    a name's rows, which it streams to hidden files that take the names at the end, so a task that is run again leaves no
    half-written file.  Only the first and the last name of a task may be in other tasks too; their pieces are joined when all
    are there.  The folder must exist wherever tasks run.  A name that would leave it aborts.
    """
    if "://" in folder and not folder.startswith("file://"):
        return write_anywhere(rows, folder, header, command)
    folder = folder.removeprefix("file://")
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"the output folder {folder} doesn't exist")
    order = [c for c in rows.columns if c not in ("filename", "body")]
    top = program_line(header, command)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edges, before = TaskContext.get().partitionId(), [], None
        every = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for n, (name, own) in enumerate(groupby(every, key=lambda row: row[0])):
            if n > 1:
                os.replace(_hidden(_target(folder, before), part), _target(folder, before))
            target = _target(folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            head, tail = _ends(name, top)
            with open(_hidden(target, part), "wb") as f:
                f.write(head if n else b"")
                if writer_of(name) == "bam":
                    bam.write_records(f, top, (_bam_row(body) for _, body in own))
                    end = f.tell()
                    f.write(tail)
                else:
                    for _, body in own:
                        f.write(body.encode() + b"\n")
                    end = f.tell()
            edges = [*edges[:1], (name, part, n > 0, end)]
            before = name
        for name, _, _, end in edges:  # what ends a file ends the last of its pieces only
            os.truncate(_hidden(_target(folder, name), part), end)
        names, parts, headed, _ = zip(*edges) if edges else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(headed, pa.bool_())], names=["name", "part", "headed"])

    edges = _dealt(rows, order).select("filename", "body").mapInArrow(write, "name string, part int, headed boolean").collect()  # two a task at most
    whole = []
    for name, own in groupby(sorted(edges, key=lambda r: (r["name"], r["part"])), key=lambda r: r["name"]):
        held, (head, tail) = list(own), _ends(name, top)
        target = _target(folder, name)
        whole.append((target, b"" if held[0]["headed"] else head, [_hidden(target, r["part"]) for r in held], tail))
    for target, head, pieces, tail in whole:
        if len(pieces) == 1 and not head and not tail:
            os.replace(pieces[0], target)
    _join(rows.sparkSession, [x for x in whole if len(x[2]) > 1 or x[1] or x[3]])


#: Names of files within a folder: no part is empty, ``.`` or ``..``.
_NAME = r"^(?!.*(?:^|/)\.{0,2}(?:/|$))[^\x00-\x1f]+$"


def write_anywhere(rows: DataFrame, folder: str, header: str = "", command: str = "") -> None:
    """The files of :func:`write_files` on any file system that Spark knows, but for alignments in binary form.

    Spark's writer and its protocol put ranges of names and of a name's rows into parts of a hidden folder.  A name's only part
    takes the name by a call to the file system; several are joined, and a header put before them, by tasks on a mounted file
    system, and else by one stream a file.
    """
    spark = rows.sparkSession
    order = [c for c in rows.columns if c not in ("filename", "body")]
    bad = ~F.coalesce(F.col("filename").rlike(_NAME), F.lit(False)) | F.lower("filename").endswith(".bam")
    wrong = F.raise_error(F.concat(F.coalesce(F.col("filename"), F.lit("null")), F.lit(" isn't the name of a file within the output folder, or of one that can be written there"))).cast("string")
    rows = rows.withColumn("filename", F.when(bad, wrong).otherwise(F.col("filename")))
    top = program_line(header, command)
    parts = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    _dealt(rows, order).select("filename", "body").write.partitionBy("filename").text(parts)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    mounted = fs.getUri().getScheme() == "file"
    plain = lambda p: p.toUri().getPath()
    try:
        joined = []
        for held in fs.listStatus(path(parts)):
            if held.isDirectory():
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(held.getPath().getName().removeprefix("filename="))
                found = sorted((x.getPath() for x in fs.listStatus(held.getPath()) if x.getPath().getName().startswith("part-")), key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
                target = path(f"{folder.rstrip('/')}/{name}")
                fs.mkdirs(target.getParent())
                fs.delete(target, False)
                head = top if writer_of(name) == "sam" else ""
                if len(found) == 1 and not head:
                    fs.rename(found[0], target)
                elif mounted:
                    joined.append((plain(target), head.encode(), [plain(p) for p in found], b""))
                else:
                    fs.rename(_streamed(spark, fs, held.getPath(), head, found), target)
        _join(spark, joined)
    finally:
        fs.delete(path(parts), True)


def _streamed(spark: SparkSession, fs, folder, head: str, parts: list):
    """A file in a folder, of a head and parts, which pass the driver a megabyte at a time."""
    jvm = spark._jvm
    whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
    out = fs.create(whole)
    try:
        out.write(bytearray(head.encode()))
        for p in parts:
            part = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    return whole


def write_partitioned(rows: DataFrame, folder: str) -> None:
    """The same rows as folders ``filename=...`` of text parts, by any number of tasks and to any file system: for results that outgrow one writer a name."""
    order = [c for c in rows.columns if c not in ("filename", "body")]
    rows.sortWithinPartitions("filename", *order).select("filename", "body").write.partitionBy("filename").text(folder)


def print_lines(rows: DataFrame, order: list[str], out: TextIO | None = None) -> int:
    """Print ``value`` of the rows in order, a partition at a time."""
    out, n = out or sys.stdout, 0
    for r in rows.orderBy(*order).select("value").toLocalIterator():
        out.write(f"{r['value']}\n")
        n += 1
    return n


def shown(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("value", display(F.col(column), df.schema[column].dataType))
