"""Scalar functions row by row, against Python."""

import math

import pytest
from pyspark.sql import functions as F

from readloom.functions import scalar as S
from readloom.lang import text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("a,b", [(1, 0), (-1, 0), (0, 0), (7, 2), (-7, 2), (5.5, -2)])
def test_division(spark, a, b):
    got, rest = one(spark, S.divide(F.lit(float(a)), F.lit(float(b)))), one(spark, S.modulo(F.lit(float(a)), F.lit(float(b))))
    if b:
        assert got == pytest.approx(a / b) and rest == pytest.approx(math.fmod(a, b))
    else:
        assert math.isnan(rest) and (math.isnan(got) if a == 0 else got == math.copysign(math.inf, a))


@pytest.mark.parametrize("x,want", [(10, "10"), (2.5, "2.5"), (0.1, "0.1"), (-3, "-3"), (16777216, "16777216"), (1e-4, "0.0001"), (math.inf, "inf"), (-math.inf, "-inf"), (math.nan, "NaN"), (1e10, "10000000000"), (-0.0, "-0")])
def test_numbers_as_text(spark, x, want):
    assert one(spark, S.number_text(F.lit(float(x)))) == want == text.number_text(x)


def test_strings(spark):
    s = F.lit("ACGTACG")
    assert one(spark, S.find_last(s, F.lit("ACG"))) == 4 and one(spark, S.find_first(s, F.lit("TT"))) == -1
    assert one(spark, S.slice_(s, F.lit(1), F.lit(3))) == "CG"
    with pytest.raises(Exception, match="out of range"):
        one(spark, S.slice_(s, F.lit(1), F.lit(9)))
    assert one(spark, S.lookup(F.lit("a=1 k=v x"), F.lit("k"))) == "v" and one(spark, S.lookup(F.lit("a=1"), F.lit("k"))) == ""
    assert one(spark, S.translate(F.lit("ATGTAANNNAC"))) == "M-?" and one(spark, S.translate(F.lit("AC"))) == ""
    assert one(spark, S.translate(F.lit("TAANNN"), "*", "X")) == "*X"
    assert one(spark, S.reverse_complement(F.lit("ACGTNRYacg"))) == "cgtRYNACGT" == text.revcomp("ACGTNRYacg")


def test_lists_and_numbers(spark):
    q = S.to_qscores(F.lit("!I"))
    assert one(spark, q) == [0.0, 40.0] and one(spark, S.list_mean(q)) == 20.0
    for fn in (S.list_min, S.list_max, S.list_mean):
        with pytest.raises(Exception, match="empty list"):
            one(spark, fn(F.array().cast("array<float>")))
    with pytest.raises(Exception, match="not a number"):
        one(spark, S.to_num(F.lit("x")))
    with pytest.raises(Exception, match="below 33"):
        one(spark, S.to_qscores(F.lit(" ")))


def test_rounding_and_equality(spark):
    assert one(spark, S.round_half_away(F.lit(-2.5))) == -3 and one(spark, S.floor(F.lit(-0.5))) == -1 and one(spark, S.ceil(F.lit(0.2))) == 1
    assert one(spark, S.number_equal(F.lit(math.nan), F.lit(math.nan))) is False


def test_flags_hold_numbers_within_16_bits(spark):
    assert one(spark, S.flag("paired", F.lit(-5.0))) is False and one(spark, S.flag("supplementary_alignment", F.lit(1e9))) is True
    assert [n for i, n in enumerate(S.FLAGS) if one(spark, S.flag(n, F.lit(float(1 << i))))] == S.FLAGS


def test_every_codon_and_what_is_none(spark):
    codons = [a + b + c for a in S.CODON_ORDER for b in S.CODON_ORDER for c in S.CODON_ORDER]
    want = S.AMINO.replace("-", "*stop*") + "<bad><bad><bad>"
    row = spark.createDataFrame([("".join(codons) + "ANGacgA.CGT",)], "s string").select(S.translate(F.col("s"), "*stop*", "<bad>")).first()
    assert row[0] == want
