"""Pairs of files, strands, and joins with reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.scalar import read_reverse_complement
from readloom.operators.matching import match
from readloom.plans.regions import MatchPlan


def as_read(df: DataFrame, name: str = "read") -> DataFrame:
    """``_row_id`` and all other columns as one struct."""
    return df.select("_row_id", F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "_row_id")).alias(name))


def zip_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two files by position, as many as the shorter has: ``_row_id, r1, r2``.  Positions are dense, so the equi-join spreads evenly."""
    return as_read(first, "r1").join(as_read(second, "r2"), "_row_id")


def with_reverse_complement(reads: DataFrame, name: str = "read") -> DataFrame:
    """Each read and then its reverse complement; ``_strand`` is 0 and 1.  One pass over the input."""
    names = [f.name for f in reads.schema[name].dataType.fields]
    other = read_reverse_complement(F.col(name), names)
    both = F.array(F.struct(F.lit(0).alias("s"), F.col(name).alias("r")), F.struct(F.lit(1).alias("s"), other.alias("r")))
    rest = [c for c in reads.columns if c != name]
    return reads.select(*rest, F.explode(both).alias("_b")).select(*rest, F.col("_b.s").alias("_strand"), F.col("_b.r").alias(name))


def members(df: DataFrame, key: str, table: DataFrame, table_key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is in the table, or isn't."""
    return df.join(table.select(F.col(table_key).alias(key)).distinct(), key, "left_semi" if keep else "left_anti")


def bound_row(table: list[dict], place: Column, field: str) -> Column:
    """A field of the reference row that a match bound, by the row's place."""
    return F.element_at(F.array(*(F.lit(r[field]) for r in table)), place + 1)


def demultiplex(reads: DataFrame, plan: MatchPlan, table: list[dict], *, seq: str = "seq", mode: str = "all", label: str = "name") -> DataFrame:
    """Each way a read matches the pattern with a row of the reference table, of those with fewest edits, with that row's label."""
    return match(reads, plan, seq=seq, mode=mode).withColumn(label, bound_row(table, F.col("ctx")[0], label))
