"""Patterns without errors and with at most one term, as expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.bind import let
from readloom.operators.search import allowed_edits
from readloom.plans.regions import Let, MatchPlan, Restrict


def is_native(plan: MatchPlan) -> bool:
    terms = [op for op in plan.ops if isinstance(op, Restrict)]
    if len(terms) > 1 or plan.variables:
        return False
    return all(len(t.term.choices) == 1 and t.term.choices[0][1] and allowed_edits(len(t.term.choices[0][1]), t.term.rate) == 0 and not (t.fixed_start and t.fixed_end) for t in terms)


def worlds(seq: Column, plan: MatchPlan, strict: bool = False) -> Column:
    """``array<struct<dist int, locs array<int>, ctx array<int>>>`` of the ways the pattern matches."""
    return let(seq, lambda s: let(F.length(s), lambda n: _worlds(s, n, plan, strict)))


def _worlds(seq: Column, length: Column, plan: MatchPlan, strict: bool) -> Column:
    def run(ops: list, locs: dict[int, Column], good: list[Column]) -> Column:
        for k, op in enumerate(ops):
            if isinstance(op, Let):
                at = locs[op.base] + op.offset
                good = [*good, (locs[op.lo] < at) & (at < locs[op.hi])]
                locs = locs | {op.loc: at}
                continue
            text = op.term.choices[0][1].upper()
            n = len(text)
            if op.fixed_start or op.fixed_end:
                start = locs[op.lo] if op.fixed_start else locs[op.hi] - n
                good = [*good, start >= 0, start + n <= length, F.substring(seq, start + 1, F.lit(n)) == text]
                locs = locs | {op.atom: start, op.atom + 1: start + n}
                continue
            lo = locs[op.lo]
            pieces = F.split(F.substring(seq, lo + 1, locs[op.hi] - lo), re.escape(text), -1)
            # The i-th of the hits, none of which overlap, begins after i + 1 pieces and i terms.
            starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + n, lo) + F.length(p)))
            rest, before, known = ops[k + 1 :], good, locs
            found = F.flatten(F.transform(starts, lambda s: run(rest, known | {op.atom: s, op.atom + 1: s + F.lit(n)}, [])))
            return F.when(_all(before), found).otherwise(none())
        for lo, hi, size in plan.checks if strict else []:
            good = [*good, locs[hi] - locs[lo] == size]
        one = F.struct(F.lit(0).alias("dist"), F.array(*(locs.get(i, F.lit(-1)).cast("int") for i in range(plan.size + 1))).alias("locs"), F.array().cast("array<int>").alias("ctx"))
        return F.when(_all(good), F.array(one)).otherwise(none())

    return run(plan.ops, {0: F.lit(0), plan.size: length}, [])


def none() -> Column:
    return F.array().cast("array<struct<dist:int,locs:array<int>,ctx:array<int>>>")


def _all(good: list[Column]) -> Column:
    out = F.lit(True)
    for g in good:
        out = out & g
    return out
