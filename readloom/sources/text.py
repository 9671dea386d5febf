"""FASTA, FASTQ, SAM, CSV, TSV and plain text as DataFrames, compressed or not, from any file system Spark reads.

Each scan gives ``_row_id``, the record's number from 0 in the order of the file, and the fields of its format.  A folder is
read as its files by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.rows import numbered

#: The columns of an alignment, and those that are numbers.
SAM_COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
SAM_NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}
SAM_ORDER = ["qname", "id", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags", "desc"]


def split_header(header: Column) -> tuple[Column, Column]:
    """Id and description, which the first run of blanks parts."""
    return F.regexp_extract(header, r"^(\S*)", 1), F.regexp_extract(header, r"^\S*[ \t]+(.*)$", 1)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``seq, id, desc``; lines of a sequence are joined.  Records are split where a line begins with ``>``."""
    return fasta_records(numbered(spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")))


def fasta_records(rows: DataFrame) -> DataFrame:
    """The fields of ``value``, the text between two ``\\n>``; other columns stay."""
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    header = F.substring_index(record, "\n", 1)
    ident, desc = split_header(header)
    seq = F.regexp_replace(F.substring(record, F.length(header) + 2, F.length(record)), r"\s", "")
    return rows.select(*(c for c in rows.columns if c != "value"), seq.alias("seq"), ident.alias("id"), desc.alias("desc"))


RECORD = pa.schema([("_row_id", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four lines a record; records that a block's end cuts aren't among the lines."""
    lines: list[tuple[int, str]] = []
    for batch in batches:
        lines += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        whole = len(lines) - len(lines) % 4
        if whole:
            out = [_frame(lines[i : i + 4]) for i in range(0, whole, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORD)], schema=RECORD)
            lines = lines[whole:]
    if lines:
        raise ValueError("a FASTQ file ends within a record")


def _frame(lines: list[tuple[int, str]]) -> tuple[int, str, str, str]:
    (n, header), (_, seq), (_, plus), (_, qual) = lines
    if not header.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
        raise ValueError(f"no FASTQ record at line {n + 1}")
    return n // 4, header[1:], seq, qual


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``seq, id, desc, qual``.

    Lines are numbered first, so a task knows where the records of a block begin.  Records are put together where they lie;
    of those that a block's end cuts, at most one a block, the lines are brought together by a shuffle.
    """
    rows = numbered(spark.read.text(path), "n", keep=True).withColumn("value", F.regexp_replace("value", "\r$", ""))
    own = F.floor(F.col("n") / 4).cast("long")
    inside = (own * 4 >= F.col("_start")) & (own * 4 + 4 <= F.col("_start") + F.col("_n"))
    whole, broken = rows.where(inside), rows.where(~inside)
    records = whole.select("n", "value").mapInArrow(_frames, "_row_id long, header string, seq string, qual string")
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    parts = broken.groupBy(own.alias("_row_id")).agg(*(line(k).alias(f"l{k}") for k in range(4)))
    right = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    wrong = F.raise_error(F.concat(F.lit("no FASTQ record at line "), F.col("_row_id") * 4 + 1)).cast("string")
    rest = parts.select("_row_id", F.when(F.coalesce(right, F.lit(False)), F.substring("l0", 2, 1 << 30)).otherwise(wrong).alias("header"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))
    records = records.unionByName(rest)
    ident, desc = split_header(F.col("header"))
    return records.select("_row_id", "seq", ident.alias("id"), desc.alias("desc"), "qual")


HEADER_LINE = r"^@[A-Z]{2}(\t|$)"
IS_RECORD = f"value <> '' and not value rlike '{HEADER_LINE.replace(chr(92), chr(92) * 2)}'"


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The 11 fixed columns, all tags as one string, and ``id`` and ``desc`` for the first and the last."""
    return sam_records(numbered(spark.read.text(path).where(IS_RECORD)))


def sam_records(rows: DataFrame) -> DataFrame:
    """The fields of ``value``, a line that is no header line; other columns stay."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", 12)
    own = {c: F.coalesce(F.get(cells, i), F.lit("")) for i, c in enumerate(SAM_COLUMNS)}
    own = {c: x.cast("float") if c in SAM_NUMBERS else x for c, x in own.items()}
    # A mapping quality of 255 means that there is none.
    own["mapq"] = F.when(own["mapq"] == 255, F.lit(-1.0).cast("float")).otherwise(own["mapq"])
    own |= {"id": own["qname"], "desc": own["tags"]}
    return rows.select(*(c for c in rows.columns if c != "value"), *(own[c].alias(c) for c in SAM_ORDER))


def sam_header(spark: SparkSession, path: str) -> str:
    """The header lines, which stand first in a file; of the size of a header."""
    rows = spark.read.text(path).where(F.col("value").rlike(HEADER_LINE))
    return "".join(f"{r['value']}\n" for r in rows.collect())


def dsv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A column of strings a header name; a row of another length than the header's aborts."""
    rows = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", sep=sep, enforceSchema=False)
    names = rows.columns
    return numbered(rows).select("_row_id", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names))


def dsv_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep).columns


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A record a line, as its sequence."""
    return numbered(spark.read.text(path)).select("_row_id", F.col("value").alias("seq"))
