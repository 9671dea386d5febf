"""A corpus in five stages: language ID, toxicity, near duplicates, mixing, packing.

Each stage is one operator on all that the one before it kept, written as Parquet in between.  Stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from readloom.llm import langid, mixing, ngram_join, packing, toxicity
from readloom.llm.common import drop, each_batch, may_be_in, sieve, small_batches, table
from readloom.llm.queries import LIMIT, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a text's corrected n-gram counts that its language has to have.
LEAST_LANGUAGE = 0.3
#: Keys of documents without an id begin here.
NO_ID = 1 << 62


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go (null and empty ones too), and those of which no language has a fair share.

    Documents without ``lang`` teach nothing but are judged like others; with no language learnt all go.  Repeated rows and rows without an id stay.
    """
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("kept.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted toxic go.

    Null and empty texts score as texts that tell nothing and stay; repeated rows share their fate; without toxic labels all stay.
    """
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=COLUMNS)
    return scored.where("predicted = 0").select("kept.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once if its row is repeated.

    A document without an id goes by a hash of its text, above all ids (which are below 2 ** 62): it stays if its group has no
    document with an id.  Texts without words are no group; each of another id stays.  Documents are shuffled only if a
    filter of the ids of those that go, or are repeated, holds theirs.
    """
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*COLUMNS).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseAND(NO_ID - 1).bitwiseOR(NO_ID)))
    groups = table(ngram_join.join(keyed, id_col="key").select(F.col("doc_id").alias("key"), "component_id"), "groups")
    repeated = groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    doubtful = groups.where("key <> component_id").select(F.col("key").alias("id")).unionByName(repeated.select(F.col("key").alias("id")))
    filled = spark.sparkContext.broadcast(sieve(doubtful))  # of bounded size
    kind = keyed.schema
    arrow, ddl = to_arrow_schema(kind), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)

    def held(doubt: bool):
        def run(batch: pa.RecordBatch) -> dict | None:
            hit = np.zeros(batch.num_rows, bool)
            hit[may_be_in(filled.value, np.asarray(batch.column(len(COLUMNS))))] = True
            batch = batch.take(pa.array(np.flatnonzero(hit == doubt)))
            return dict(zip(batch.schema.names, batch.columns)) if batch.num_rows else None

        return keyed.mapInArrow(each_batch(run, arrow), ddl)

    first = groups.where("key = component_id").select("key").distinct()
    some = held(True).join(first.hint("merge"), "key", "left_semi").withColumn("same", F.xxhash64(text)).dropDuplicates(["key", "same"])
    return held(False).select(*COLUMNS).unionByName(some.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded, says; rates bring the tokens that are packed to the target weights.

    Null and empty texts have no tokens and get the rate of their posteriors; repeated rows are drawn alike, and rows
    without an id all by one draw.  Without a labelled domain every rate is 1.
    """
    path = tokenizer("byte_bpe_50k.json")
    domains = mixing.learn(docs, mixing.labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = table(mixing.members(docs, domains, tokenizer_path=path), "members")
    steps, _, _ = mixing.mix(rows, domains.names, mixing.tempered)
    drop(rows)
    return mixing.drawn(docs, domains, steps, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is its end mark alone, and a repeated row is packed again."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), size=LIMIT), size=LIMIT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and packing aren't within SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return docs
