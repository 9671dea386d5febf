"""The stages of the pipeline on rows that aren't as they should be, and against what each operator says by itself."""

import pytest
from pyspark.sql import functions as F

from readloom.llm import langid, ngram_join, toxicity

from .conftest import make

P = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, tokenizers):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and labels for some; written as the driver's tables are."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [r[:5] for r in make(3, 90)]
    rows += [(None, None, None, None, None), (None, rows[0][1], "en", "s", 1), (None, "another text that nobody has an id for and nobody else holds", "en", "s", 1), (None, "another text that nobody has an id for and nobody else holds", "en", "s", 1)]
    rows += [(20, "the same id for quite another text with words of its own in it", "en", "s", 2), (950, "x" * 30_000, "en", "s", 3)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), rows


def plain(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_language_keeps_what_the_operator_names(odd, spark):
    folder, docs, rows = odd
    got = P.language(spark, docs, folder)
    said = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    named = {i for i, lang, s in said if lang != "und" and s >= P.LEAST_LANGUAGE}
    assert got.columns == P.COLUMNS and {r["doc_id"] for r in got.collect()} == named
    assert not {5, 6, 7} & named
    assert got.where("doc_id = 3").count() == 2  # a repeated row is judged twice alike


def test_clean_keeps_what_the_operator_does_not_predict(odd, spark):
    folder, docs, rows = odd
    got = P.clean(spark, docs, folder)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert got.columns == P.COLUMNS and got.count() == scored.where("predicted = 0").count()
    no_labels = spark.read.parquet(f"{folder}/labels.parquet").where("false")
    assert toxicity.score(docs, toxicity.train(docs, no_labels)).where("predicted = 1").count() == 0


def test_one_of_each_group_stays(odd, spark):
    folder, docs, rows = odd
    got = P.distinct(spark, docs, folder)
    # By brute force: shingle sets, links, components; without an id a row comes after all with one, and once a text.
    shingles = []
    for r in rows:
        w = ngram_join.shingles(r[1])
        shingles.append(frozenset(w.tolist()))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    group, kept = {i: i for i in range(len(rows))}, set()
    for i in order:
        for j in order:
            a, b = shingles[i], shingles[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    seen = set()
    for i in order:
        key = group[i] if shingles[i] else ("empty", rows[i][0] if rows[i][0] is not None else rows[i][1] or "")
        if key not in seen:
            seen.add(key)
            kept.add(repr(rows[i][:2]))
    found = [repr((r["doc_id"], r["text"])) for r in got.collect()]
    # The id 20 has two texts; both are the smallest id of their groups.
    assert sorted(found) == sorted(kept)
    assert got.columns == P.COLUMNS


def test_mixing_and_packing_take_odd_rows(odd, spark):
    folder, docs, rows = odd
    mixed = P.mix(spark, docs, folder)
    assert mixed.columns == P.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows}
    packed = P.pack(spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {P.LIMIT}").count() == 0
    assert {r["length"] for r in packed.where("doc_id in (5, 6)").collect()} == {1}


def test_stages_of_an_empty_table(odd, spark):
    folder, docs, _ = odd
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), folder).collect() == [], name


def test_the_whole_run_on_odd_rows(odd, spark):
    folder, docs, _ = odd
    out = P.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in docs.collect()}
