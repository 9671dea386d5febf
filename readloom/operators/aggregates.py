"""The folds of effects: keyed counts, and keyed means with their spread."""

from __future__ import annotations

import os
import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_effect(effects: DataFrame) -> DataFrame:
    """``name, value, count`` of rows ``name, value``: partial counts meet by key."""
    return effects.groupBy("name", "value").agg(F.count("*").alias("count"))


def mean_effect(effects: DataFrame) -> DataFrame:
    """``name, mean, stddev_pop`` of rows ``name, value``."""
    x = F.col("value").cast("double")
    return effects.groupBy("name").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev_pop"))


def report_counts(counts: DataFrame, folder: str, out: TextIO | None = None) -> None:
    """Print counts by name and value, and write ``<name>.csv``; one line a key is streamed, nothing if there is none."""
    out, name, f = out or sys.stdout, None, None
    for r in counts.orderBy(F.col("name").cast("binary"), F.col("value").cast("binary")).toLocalIterator():
        if r["name"] != name:
            if f:
                f.close()
            name = r["name"]
            f = open(os.path.join(folder, f"{name}.csv"), "w")
            f.write("value,count\n")
            out.write(f"{name}:\n")
        out.write(f"\t{r['count']}\t{r['value']}\n")
        f.write(f"{r['value']},{r['count']}\n")
    if f:
        f.close()


def report_means(means: DataFrame, folder: str, out: TextIO | None = None) -> None:
    """Print means by name, and write ``stats.csv``, whose column ``variance`` holds the standard deviation."""
    out = out or sys.stdout
    rows = means.orderBy(F.col("name").cast("binary")).collect()  # a row a name that the script writes out
    if not rows:
        return
    with open(os.path.join(folder, "stats.csv"), "w") as f:
        f.write("name,mean,variance\n")
        for r in rows:
            out.write(f"{r['name']}:\n\t{r['mean']:.2f} ± {r['stddev_pop']:.2f}\n")
            f.write(f"{r['name']},{r['mean']},{r['stddev_pop']}\n")
