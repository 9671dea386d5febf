"""Dense row numbers in the order of files and of their rows, without a shuffle.

Rows are counted by block, the part of a file that a task reads at once, and numbered by the block they are in.  Splits of
files depend on the session's parallelism, which may change between the count and the scan; the least number of
splits is therefore fixed when a session first counts, and a row of a block that wasn't counted is an error, never a wrong number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = "spark.sql.files.minPartitionNum"


def pin(spark: SparkSession) -> None:
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))


def _place() -> tuple[Column, Column]:
    part = F.spark_partition_id()
    return part, F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)


def placed(df: DataFrame) -> DataFrame:
    """A scan with where each row is: task, file, block, and place among the task's rows."""
    pin(df.sparkSession)
    part, place = _place()
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}).withColumns({"_part": part, "_place": place})


def blocks(rows: DataFrame) -> DataFrame:
    """``_part, _file, _block, _start, _n, _shift``: a row a block, with the number of rows before it, of its rows, and of what a place lacks to a number."""
    found = rows.groupBy("_part", "_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("place")).collect()
    before, out = 0, []
    for r in sorted(found, key=lambda r: (r["_file"], r["_block"])):
        out.append((r["_part"], r["_file"], r["_block"], before, r["n"], before - r["place"]))
        before += r["n"]
    return rows.sparkSession.createDataFrame(out, "_part int, _file string, _block long, _start long, _n long, _shift long")


def numbered(df: DataFrame, name: str = "_row_id", keep: bool = False) -> DataFrame:
    """``df``, which must be a scan of files or narrow steps after it that keep its metadata, with rows numbered from 0; ``keep`` leaves the block's ``_start`` and ``_n``."""
    rows = placed(df)
    # A row a block of at most 128 MB, say: a millionth of the data.
    out = rows.join(F.broadcast(blocks(rows)), ["_part", "_file", "_block"], "left")
    number = F.coalesce(F.col("_place") + F.col("_shift"), F.raise_error(F.lit("files were split otherwise than when their rows were counted")).cast("long"))
    out = out.withColumn(name, number)
    return out.select(name, *(["_start", "_n"] if keep else []), *(F.col(f"`{c}`") for c in df.columns))
