"""Reads hold all letters of all texts, and operators take reads of any length."""

import random
import re

import pytest

from readloom import catalogue
from readloom.operators import matching
from readloom.operators.relations import demultiplex
from readloom.operators.search import edit_distance, find_disjoint
from readloom.plans.regions import Hole, Term, compile_regions, named, sized

LONG = 30_000


def read(text, to=catalogue.TO_BASES):
    return "".join(dict(zip(catalogue.LETTERS, to))[c] for c in re.sub("[^A-Z]", "", (text or "").upper()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = ["".join(rng.choice("ABCDEFGH ,.I") for _ in range(n)) for n in (0, 5, 149, 150, 151, 400, 700, LONG)]
    return [*out, None, "I" * 300 + "abcdcbaa" + "I" * 9, "I" * 200 + "abcabc" + "I" * 9 + "abcabc" + "I" * 3 + "ccdd" + "I"]


def test_reads_hold_all_letters(spark, texts, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r["row_id"], r["id"], r["seq"], r["qual"]) for r in catalogue.fq(spark, str(tmp_path)).collect())
    assert len({r[0] for r in found}) == len(found)
    for i, t in enumerate(texts):
        own = [r for r in found if r[0] // catalogue.MOST == i]
        assert [r[1] for r in own] == [f"read{i}_{k}" for k in range(len(own))] and "".join(r[2] for r in own) == read(t) and "".join(r[3] for r in own) == read(t, catalogue.TO_QUALS)
        assert all(len(r[2]) == catalogue.BASES for r in own[:-1]) and (len(own[-1][2]) > 0 or not read(t))


def test_long_reads_match_as_short_ones_do(spark, texts):
    seqs = {i: read(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(seqs.items()), "row_id long, seq string").repartition(3)
    every = [(i, s, m.start()) for i, s in seqs.items() for m in re.finditer("ACG", s)]
    got = lambda regions, *columns: sorted((r["row_id"], *(r[c] for c in columns)) for r in matching.match(df, compile_regions(regions)).collect())
    assert got([Hole(), Term.of("ACG"), named("rest", Hole())], "rest_seq") == sorted((i, s[at + 3 :]) for i, s, at in every)
    assert got([Hole(), Term.of("ACG"), named("mid", sized(2)), Term.of("AA"), Hole()], "mid_seq") == sorted((i, s[at + 3 : at + 5]) for i, s, at in every if s[at + 5 : at + 7] == "AA")
    hits = {i: find_disjoint("ACGTGCAA", s, 2) for i, s in seqs.items()}
    fuzzy = {i: [h for h in own if h[2] == min(x[2] for x in own)] for i, own in hits.items()}
    assert got([Hole(), Term.of("ACGTGCAA", 0.26), named("rest", Hole())], "dist", "rest_seq") == sorted((i, d, seqs[i][e:]) for i, hits in fuzzy.items() for _, e, d in hits)
    counted = {r["row_id"]: r["n"] for r in df.select("row_id", matching.count_matches(df["seq"], "ACGTGCAA", 0.2).alias("n")).collect()}
    assert counted == {i: len(own) for i, own in hits.items()}


def test_all_barcodes_are_tried(spark, texts):
    rng = random.Random(3)
    codes = [{"name": i, "seq": "".join(rng.choice("ACGT") for _ in range(8))} for i in range(60)]
    seqs = {i: read(t) for i, t in enumerate(texts) if len(t or "") < LONG}
    plan = compile_regions([Hole(), Term(tuple(((i,), c["seq"]) for i, c in enumerate(codes)), 0.26, (0,)), Hole()], 1)
    got = {(r["row_id"], r["name"], r["dist"]) for r in demultiplex(spark.createDataFrame(list(seqs.items()), "row_id long, seq string"), plan, codes).collect()}
    want = set()
    for i, s in seqs.items():
        near = {c["name"]: min((edit_distance(c["seq"], s[a:b]) for a in range(len(s)) for b in range(a + 6, min(len(s), a + 10) + 1)), default=9) for c in codes}
        least = min(near.values())
        want |= {(i, name, d) for name, d in near.items() if d == least and d <= 2}
    assert got == want
