"""Formats by file name, and the types of their records."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from readloom.sources import bam as bam_
from readloom.sources import text

FORMATS = {"fa": "fasta", "fasta": "fasta", "fq": "fastq", "fastq": "fastq", "sam": "sam", "bam": "bam", "csv": "csv", "tsv": "tsv", "list": "list", "txt": "list"}


def format_of(path: str) -> str:
    """By extension, a second one ``.gz`` aside."""
    name = path.rsplit("/", 1)[-1]
    name = name.removesuffix(".gz")
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext not in FORMATS:
        raise ValueError(f"{path}: the file's type isn't known by its name; there are {', '.join(FORMATS)}")
    return FORMATS[ext]


def scan(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = FORMATS.get(kind, kind) or format_of(path)
    if kind == "bam":
        return bam_.bam(spark, path)
    if kind in ("csv", "tsv"):
        return text.dsv(spark, path, "," if kind == "csv" else "\t")
    return {"fasta": text.fasta, "fastq": text.fastq, "sam": text.sam, "list": text.lines}[kind](spark, path)


def header(spark: SparkSession, path: str, kind: str | None = None) -> str:
    """The header of an alignment file, empty for other formats."""
    kind = FORMATS.get(kind, kind) or format_of(path)
    return text.sam_header(spark, path) if kind == "sam" else bam_.bam_header(path) if kind == "bam" else ""


def field_types(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, str]:
    """``Str`` or ``Num`` by field; of a table the header's names."""
    kind = FORMATS.get(kind, kind) or format_of(path)
    if kind in ("csv", "tsv"):
        return dict.fromkeys(text.dsv_columns(spark, path, "," if kind == "csv" else "\t"), "Str")
    names = {"fasta": ["seq", "id", "desc"], "fastq": ["seq", "id", "desc", "qual"], "list": ["seq"]}.get(kind, text.SAM_ORDER)
    return {c: "Num" if c in text.SAM_NUMBERS else "Str" for c in names}


def spool(kind: str, stream: BinaryIO | None = None) -> str:
    """Standard input as a file of that kind, as scans go over their input more than once."""
    folder = tempfile.mkdtemp(prefix="readloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"stdin.{kind}")
    with open(path, "wb") as f:
        shutil.copyfileobj(stream or sys.stdin.buffer, f)
    return f"file://{path}"
