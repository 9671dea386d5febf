"""Reads as they arrive: a folder of files as a stream, with running counts and routed output."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.sinks.files import write_files
from readloom.sources import text


def fasta_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """``seq, id, desc`` of the FASTA files that appear in a folder."""
    rows = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_a_batch).text(folder)
    return text.fasta_records(rows.where(F.trim("value") != ""))


def sam_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The fields of the alignments in the SAM files that appear in a folder."""
    return text.sam_records(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder).where(text.IS_RECORD))


def fastq_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """``seq, id, desc, qual`` of the FASTQ files that appear in a folder; one task takes a file whole."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)
    lines = F.split(F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""), "\n$", ""), "\n")
    rows = files.where("length > 0").select(lines.alias("l")).select("l", F.explode(F.sequence(F.lit(0), F.ceil(F.size("l") / 4).cast("int") - 1)).alias("i"))
    line = lambda k: F.coalesce(F.get("l", F.col("i") * 4 + k), F.lit(""))
    right = line(0).startswith("@") & line(2).startswith("+") & (F.length(line(1)) == F.length(line(3)))
    head = F.when(right, F.substring(line(0), 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record at line "), F.col("i") * 4 + 1)).cast("string"))
    ident, desc = text.split_header(F.col("head"))
    return rows.select(head.alias("head"), line(1).alias("seq"), line(3).alias("qual")).select("seq", ident.alias("id"), desc.alias("desc"), "qual")


def files_of_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """For :func:`route`: writes the ``filename, ..., body`` rows of each micro-batch to a folder of its number, the same if it runs again."""

    def write(rows: DataFrame, number: int) -> None:
        own = os.path.join(folder, f"batch-{number}")
        os.makedirs(own, exist_ok=True)
        write_files(rows, own)

    return write


def running_counts(stream: DataFrame, key: Column) -> DataFrame:
    """``value, count`` so far; a row a key is kept as state."""
    return stream.select(key.alias("value")).groupBy("value").count()


def route(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch to ``batch``, once the files that are there are read stop."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
