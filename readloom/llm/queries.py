"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import fingerprint, langid, licences, mixing, near_vectors, ngram_join, packing, tokens, toxicity, warc
from readloom.llm.oracles import ORACLES

LIMIT = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join(_docs(spark, d))


def op2(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet")))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, d))


def op4(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return langid.identify(docs, langid.train(docs))


def op5(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(_docs(spark, d), tokenizer("word_bpe_49k.json"), limit=LIMIT)


def op6(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.pieces(_docs(spark, d), tokenizer("byte_bpe_50k.json"), size=LIMIT), size=LIMIT)


def op8(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return mixing.mixed(docs, mixing.labelled_domains(docs, spark.read.parquet(f"{d}/labels.parquet")), tokenizer_path=tokenizer("byte_bpe_50k.json"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return licences.scan(docs, licences.train(licences.paragraph_sample(docs)))


def op10(spark: SparkSession, d: str) -> DataFrame:
    return warc.pages_through_archives(spark.read.parquet(f"{d}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1,
    "op2_toxicity": op2,
    "op3_document_fingerprints": op3,
    "op4_language_id": op4,
    "op5_token_counts": op5,
    "op6_embedding_near_dedup": op6,
    "op7_best_fit_packing": op7,
    "op8_mixing": op8,
    "op9_license_scans": op9,
    "op10_warc": op10,
}


