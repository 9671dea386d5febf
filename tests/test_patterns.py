"""Patterns: plans, both ways to run them, and match modes."""

import random

import pytest

from readloom.operators import bank, matching, search
from readloom.operators.matching import match, worlds_of
from readloom.plans import native
from readloom.plans.regions import Hole, Let, Term, compile_regions, named, sized

SEQ = "A" * 9 + "G" * 4 + "C" * 12


def cut(regions, seq=SEQ, **more):
    plan = compile_regions(regions, **more)
    return [tuple(seq[w[1][lo] : w[1][hi]] for _, lo, hi in plan.names) for w in worlds_of(plan, seq)]


def test_regions_of_a_pattern():
    assert cut([Hole(), Term.of("GGGG"), named("rest", sized(3)), Hole()]) == [("CCC",)]
    assert cut([named("a", Hole()), Term.of("GGGG"), named("b", Hole())]) == [("A" * 9, "C" * 12)]
    assert cut([named("all", sized(2), Term.of("AAA"), Hole())]) == [(SEQ,)]


def test_a_sized_region_is_strictly_inside():
    assert cut([named("x", sized(25)), Hole()]) == []
    assert cut([named("x", sized(24)), Hole()]) == [(SEQ[:24],)]
    assert cut([named("x", sized(0)), Hole()]) == []


def test_both_ends_pinned_is_a_distance_over_the_window():
    assert len(cut([Term.of("ACGT", 0.25)], "ACGA")) == 1
    assert cut([Term.of("ACGT")], "ACGA") == []


def test_nothing_places_a_boundary():
    with pytest.raises(ValueError, match="'a'"):
        compile_regions([named("a", Hole()), Hole()])


def test_edits_are_summed_and_the_best_hits_go_on():
    plan = compile_regions([Hole(), Term.of("GATTACA", 0.3), Hole()])
    assert [w[0] for w in worlds_of(plan, "CCGATTACACCGATTTCACC")] == [0]
    assert [w[0] for w in worlds_of(plan, "CCGATAACACCGATTTCACC")] == [1, 1]


def test_lower_case_reads_never_match_and_patterns_are_raised():
    assert cut([Hole(), Term.of("gggg"), Hole()]) != []
    assert cut([Hole(), Term.of("GGGG"), Hole()], SEQ.lower()) == []


def test_one_variable_in_two_terms_has_one_value():
    both = Term((((0,), "AA"), ((1,), "CC")), 0.0, (0,))
    plan = compile_regions([both, Hole(), both], 1)
    assert [w[2] for w in worlds_of(plan, "AAGGAA")] == [(0,)]
    assert worlds_of(plan, "AAGGCC") == []


PLANS = [
    [Hole(), Term.of("ACG"), named("rest", Hole())],
    [Hole(), Term.of("ACG"), named("rest", sized(3)), Hole()],
    [named("head", sized(4)), Term.of("AC"), Hole()],
    [named("head", sized(4)), Hole(), Term.of("AC"), named("b", Hole())],
    [Hole(), Term.of("GT"), named("tail", sized(2))],
    [named("first", sized(3)), Hole(), named("last", sized(2))],
    [Hole(), named("g", Term.of("ACG"), named("n", sized(2))), Hole()],
]


@pytest.mark.parametrize("regions", PLANS)
def test_the_native_form_gives_the_worlds_of_the_general_one(spark, regions):
    import random

    rng = random.Random(3)
    seqs = ["", "A", "ACG", "ACGACG", *("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, seq string")
    plan = compile_regions(regions)
    assert native.is_native(plan)
    got = df.select("i", native.worlds(df["seq"], plan).alias("w")).collect()
    known = sorted({0, plan.size} | {op.loc for op in plan.ops if hasattr(op, "loc")} | {k for op in plan.ops if hasattr(op, "atom") for k in (op.atom, op.atom + 1)})
    for r in got:
        want = [[w[1][k] for k in known] for w in worlds_of(plan, seqs[r["i"]])]
        assert [[w["locs"][k] for k in known] for w in r["w"]] == want


def test_modes(spark):
    df = spark.createDataFrame([(0, "TTACGTTACGTT"), (1, "TTACGTT"), (2, "TTT")], "i long, seq string")
    plan = compile_regions([Hole(), Term.of("ACG"), named("rest", Hole())])
    rows = lambda mode: sorted((r["i"], r["rest_seq"]) for r in match(df, plan, mode=mode).collect())
    assert rows("all") == [(0, "TT"), (0, "TTACGTT"), (1, "TT")]
    assert rows("all-best") == [(0, "TTACGTT"), (1, "TT")]
    assert rows("one-best") == [(1, "TT")]
    with pytest.raises(ValueError):
        rows("best")


def test_the_search_runs_once_and_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "'ACGTACGT' seq", "'x' other").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("id > 5")
    plan = compile_regions([Hole(), Term.of("ACGT", 0.3), named("rest", Hole())])
    text = match(df.select("id", "seq"), plan)._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert "GreaterThan(id,5)" in text and "other" not in text


def test_count_and_describe(spark):
    df = spark.createDataFrame([("ACGACGTTACG",), ("TTT",), ("AAAAA",)], "seq string")
    n = lambda *a: [r[0] for r in df.select(matching.count_matches(df["seq"], *a)).collect()]
    assert n("ACG") == [3.0, 0.0, 0.0] and n("AA") == [0.0, 0.0, 2.0]
    assert n("ACGT", 0.25)[0] >= 1
    got = [r[0] for r in df.select(matching.describe(df["seq"], {"a": "GTT", "b": "CGA"}, True)).collect()]
    assert got == ["[ _ b _ a _ ]", "[ _ ]", "[ _ ]"]


def test_sizes_of_one_round_do_not_limit_each_other():
    """Both ends of the read place a boundary at once, so the regions may overlap; the next round sees both."""
    pattern = [named("a", sized(3)), Hole(), named("b", sized(4))]
    assert cut(pattern, "ACGTTG") == [("ACG", "GTTG")]
    assert cut(pattern, "ACGT") == []  # b would begin where the read does
    assert cut([named("a", sized(3)), named("c", sized(1)), Hole(), named("b", sized(4))], "ACGTTGA") == []  # c ends beyond where b begins
    assert cut([named("a", sized(3)), named("c", sized(1)), Hole(), named("b", sized(4))], "ACGTTGAAA") == [("ACG", "T", "GAAA")]


def test_a_bank_of_patterns_finds_what_one_search_each_does():
    rng = random.Random(1)
    for _ in range(200):
        letters, m, k = rng.choice(["AC", "ACGT", "ACGTNé"]), rng.randint(1, rng.choice([3, 9, 20, 64])), rng.randint(1, 4)
        patterns = ["".join(rng.choice(letters[:4]) for _ in range(m)) for _ in range(4)]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        assert bank.find_all_in(patterns[0], texts, k) == [search.find_all(patterns[0], t, k) for t in texts]
        for t, got in zip(texts, bank.best_hits(patterns, texts, k)):
            every = [(i, s, e, d) for i, p in enumerate(patterns) for s, e, d in search.find_disjoint(p, t, k)]
            assert got == sorted(h for h in every if h[3] == min(x[3] for x in every))


def test_pieces_find_what_a_search_for_all_patterns_does(monkeypatch):
    rng = random.Random(4)
    for m, k in ((12, 2), (16, 1), (10, 0), (9, 1)):
        patterns = ["".join(rng.choice("ACGT") for _ in range(m)) for _ in range(300)]
        patterns[7] = patterns[3]
        texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50))) for _ in range(6)] + [patterns[3] + "A" + patterns[5][:4] + "T" + patterns[5][4:] + patterns[3] * 2, "", "A"]
        got = bank.exact_hits(patterns, texts)
        assert got == [[(i, s, e) for i, p in enumerate(patterns) for s, e, _ in search.find_disjoint(p, t, 0)] for t in texts]
        if k:
            monkeypatch.setattr(bank, "MANY", 256)
            few = bank.best_hits(patterns, texts, k)
            monkeypatch.setattr(bank, "MANY", 1 << 30)
            assert few == bank.best_hits(patterns, texts, k) and few[6]


def test_many_reads_at_once_give_each_read_its_worlds():
    rng = random.Random(6)
    codes = tuple(((i,), "".join(rng.choice("ACGT") for _ in range(8))) for i in range(30))
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    one = Term(codes, 0.26, (0,))
    for regions, variables in (([Hole(), one, Hole()], 1), ([Hole(), one, named("mid", sized(3)), Term(codes, 0.13, (0,)), Hole()], 1), ([Hole(), Term.of("ACGTGCAA", 0.3), Hole(), Term.of("GG", 0.0), named("r", Hole())], 0)):
        plan = compile_regions(regions, variables)
        together = matching.worlds_of_all(plan, reads)
        for seq, found in zip(reads, together):
            assert found == plainly(plan, seq)


def plainly(plan, seq):
    """Worlds one read, one world and one string at a time."""
    worlds = [(0, {0: 0, plan.size: len(seq)}, (-1,) * plan.variables)]
    for op in plan.ops:
        new = []
        for dist, locs, ctx in worlds:
            if isinstance(op, Let):
                at = locs[op.base] + op.offset
                new += [(dist, locs | {op.loc: at}, ctx)] if locs[op.lo] < at < locs[op.hi] else []
                continue
            found = [(d, s, e, b) for text, b in matching.choices_of(op, ctx) for s, e, d in matching.hits_of(op, text, seq, locs)]
            new += [(dist + d, locs | {op.atom: s, op.atom + 1: e}, b) for d, s, e, b in found if d == min(f[0] for f in found)]
        worlds = new
    return worlds


def test_hits_at_one_place_share_their_boundaries():
    plan = compile_regions([Term(tuple(((i,), "ACG") for i in range(3)), 0.0, (0,)), Hole()], 1)
    (worlds,) = matching.worlds_of_all(plan, ["ACGTT"])
    assert [w[2] for w in worlds] == [(0,), (1,), (2,)] and all(w[1] is worlds[0][1] for w in worlds)
