"""Matching reads against a plan: one row, or none, or several, for each way (world) a pattern matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.bind import let
from readloom.operators.bank import best_hits, disjoint_in, exact_hits, fits
from readloom.operators.search import Hit, allowed_edits, edit_distance, find_disjoint
from readloom.plans import native
from readloom.plans.regions import Let, MatchPlan, Restrict

WORLD = "array<struct<dist:int,locs:array<int>,ctx:array<int>>>"
#: Match modes by their names on the command line: every world; the first of the best; the best if no other is as good.
MODES = ("all", "all-best", "one-best")

#: From so many strings on, hits without edits are sought for all strings at once.
SEVERAL = 16

World = tuple[int, dict[int, int], tuple[int, ...]]


def hits_of(op: Restrict, pattern: str, seq: str, locs: dict[int, int], exact: bool = False) -> list[Hit]:
    """Where a term is found in its window.  A window pinned at one end is the pattern's length and its edits wide; one that leaves the read has no hits.  ``exact`` asks for those without edits only, which is cheap."""
    k = allowed_edits(len(pattern), op.term.rate)
    lo, hi = locs[op.lo], locs[op.hi]
    if op.fixed_start and op.fixed_end:
        d = edit_distance(pattern, seq[lo:hi])
        return [(lo, hi, d)] if d <= k else []
    if op.fixed_start:
        hi = lo + len(pattern) + k
    elif op.fixed_end:
        lo = hi - len(pattern) - k
    if lo < 0 or hi > len(seq) or lo > hi:
        return []
    return [(s + lo, e + lo, d) for s, e, d in find_disjoint(pattern, seq[lo:hi], 0 if exact else k)]


Found = list[tuple[int, int, int, tuple[int, ...]]]  # distance, start, end, bound variables


def choices_of(op: Restrict, ctx: tuple[int, ...]) -> list[tuple[str, tuple[int, ...]]]:
    """The strings that variables bound so far leave, each with what it binds."""
    choices = []
    for choice, text in op.term.choices:
        bound = list(ctx)
        for variable, value in zip(op.term.uses, choice):
            if bound[variable] not in (-1, value):
                break
            bound[variable] = value
        else:
            choices.append((text.upper(), tuple(bound)))
    return choices


def searched(op: Restrict, seq: str, locs: dict[int, int], choices: list[tuple[str, tuple[int, ...]]]) -> Found:
    """Hits of a term in one world: with hits without edits no others count, so a search for more is needed only where there are none."""
    found: Found = []
    for exact in (True, False):
        found = found or [(d, s, e, b) for text, b in choices for s, e, d in hits_of(op, text, seq, locs, exact) if d == 0 or not exact]
    return found


def open_window(op: Restrict) -> bool:
    return not (op.fixed_start or op.fixed_end)


def searched_together(op: Restrict, seqs: list[str], worlds: list[tuple[int, World]]) -> list[Found]:
    """Hits of a term in the worlds of many reads.

    Strings of one length are searched in all windows at once where neither end of the window is pinned and some edits are
    allowed; windows with a hit without edits need no such search.  A window pinned at one end is looked up where no edits are.
    """
    out: list[Found] = []
    together: dict[tuple[int, ...], list[int]] = {}
    given: dict[tuple[int, ...], tuple[list, bool]] = {}
    whole: dict[tuple[int, ...], dict[str, list[tuple[int, ...]]]] = {}  # of a window pinned at one end without edits, which string it has to be
    for i, (dist, locs, ctx) in worlds:
        if ctx not in given:
            choices = choices_of(op, ctx)
            texts = [t for t, _ in choices]
            given[ctx] = choices, open_window(op) and fits(texts) and (len(texts) >= SEVERAL or allowed_edits(len(texts[0]), op.term.rate) > 0)
            if texts and op.fixed_start != op.fixed_end and len({len(t) for t in texts}) == 1 and allowed_edits(len(texts[0]), op.term.rate) <= 0 and texts[0]:
                whole[ctx] = {}
                for t, b in choices:
                    whole[ctx].setdefault(t, []).append(b)
        choices, many = given[ctx]
        if ctx in whole:
            m = len(choices[0][0])
            lo = locs[op.lo] if op.fixed_start else locs[op.hi] - m
            fits_in = 0 <= lo <= lo + m <= len(seqs[i])
            out.append([(0, lo, lo + m, b) for b in whole[ctx].get(seqs[i][lo : lo + m], ())] if fits_in else [])
        elif many and 0 <= locs[op.lo] <= locs[op.hi] <= len(seqs[i]):
            together.setdefault(ctx, []).append(len(out))
            out.append([])
        else:
            out.append(searched(op, seqs[i], locs, choices))
    slow: dict[tuple[int, ...], list[int]] = {}
    for ctx, places in together.items():
        choices = given[ctx][0]
        texts = [t for t, _ in choices]
        if len(texts) >= SEVERAL:
            windows = [seqs[worlds[p][0]][worlds[p][1][1][op.lo] : worlds[p][1][1][op.hi]] for p in places]
            for p, hits in zip(places, exact_hits(texts, windows)):
                lo = worlds[p][1][1][op.lo]
                out[p] = [(0, s + lo, e + lo, choices[c][1]) for c, s, e in hits]
        else:
            for p in places:
                i, (_, locs, _) = worlds[p]
                out[p] = [(d, s, e, b) for text, b in choices for s, e, d in hits_of(op, text, seqs[i], locs, True)]
        if allowed_edits(len(texts[0]), op.term.rate) > 0 and (left := [p for p in places if not out[p]]):
            slow[ctx] = left
    for ctx, places in slow.items():
        choices = given[ctx][0]
        k = allowed_edits(len(choices[0][0]), op.term.rate)
        windows = [(worlds[p][1][1][op.lo], seqs[worlds[p][0]][worlds[p][1][1][op.lo] : worlds[p][1][1][op.hi]]) for p in places]
        for p, (lo, _), hits in zip(places, windows, best_hits([t for t, _ in choices], [w for _, w in windows], k)):
            out[p] = [(d, s + lo, e + lo, choices[c][1]) for c, s, e, d in hits]
    return out


def worlds_of_all(plan: MatchPlan, seqs: list[str], strict: bool = False) -> list[list[World]]:
    """All worlds of each read, in order.  Of the hits of a term in a world only those with fewest edits go on."""
    worlds: list[tuple[int, World]] = [(i, (0, {0: 0, plan.size: len(s)}, (-1,) * plan.variables)) for i, s in enumerate(seqs)]
    for op in plan.ops:
        new: list[tuple[int, World]] = []
        if isinstance(op, Let):
            for i, (dist, locs, ctx) in worlds:
                at = locs[op.base] + op.offset
                if locs[op.lo] < at < locs[op.hi]:
                    new.append((i, (dist, locs | {op.loc: at}, ctx)))
        else:
            for (i, (dist, locs, _)), found in zip(worlds, searched_together(op, seqs, worlds)):
                if found:
                    least, made = min(f[0] for f in found), {}  # hits at one place share their boundaries, which nothing changes later
                    for d, s, e, c in found:
                        if d == least:
                            if (s, e) not in made:
                                made[s, e] = locs | {op.atom: s, op.atom + 1: e}
                            new.append((i, (min(255, dist + d), made[s, e], c)))
        worlds = new
    out: list[list[World]] = [[] for _ in seqs]
    for i, w in worlds:
        if not strict or all(w[1][hi] - w[1][lo] == size for lo, hi, size in plan.checks):
            out[i].append(w)
    return out


def worlds_of(plan: MatchPlan, seq: str, strict: bool = False) -> list[World]:
    """All worlds of one read."""
    return worlds_of_all(plan, [seq], strict)[0]


def _lists(flat: list, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat, kind))


def search_udf(plan: MatchPlan, strict: bool = False):
    """The general matcher as an Arrow function of the sequence.  Declared nondeterministic, so that Spark doesn't run it twice."""

    @F.arrow_udf(WORLD)
    def search(seqs: pa.Array) -> pa.Array:
        dist: list[int] = []
        locs: list[int] = []
        ctx: list[int] = []
        ctx_n: list[int] = []
        worlds_n: list[int] = []
        for found in worlds_of_all(plan, [x or "" for x in seqs.to_pylist()], strict):
            worlds_n.append(len(found))
            before, row = None, []
            for d, at, c in found:
                if at is not before:
                    before, row = at, [at.get(i, -1) for i in range(plan.size + 1)]
                dist.append(d)
                locs += row
                ctx += c
                ctx_n.append(len(c))
        rows = pa.StructArray.from_arrays([pa.array(dist, pa.int32()), _lists(locs, [plan.size + 1] * len(dist), pa.int32()), _lists(ctx, ctx_n, pa.int32())], names=["dist", "locs", "ctx"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(worlds_n)].astype(np.int32)), rows)

    return search.asNondeterministic()


def worlds_column(seq: Column, plan: MatchPlan, strict: bool = False) -> Column:
    return native.worlds(seq, plan, strict) if native.is_native(plan) else search_udf(plan, strict)(seq)


def in_mode(worlds: Column, mode: str) -> Column:
    """The worlds that a match mode leaves."""
    if mode == "all":
        return worlds

    def best_of(every: Column) -> Column:
        return let(F.array_min(F.transform(every, lambda w: w["dist"])), lambda least: F.filter(every, lambda w: w["dist"] == least))

    best = let(worlds, best_of)
    if mode == "all-best":
        return F.slice(best, 1, 1)
    if mode == "one-best":
        return let(best, lambda b: F.when(F.size(b) == 1, b).otherwise(native.none()))
    raise ValueError(f"match mode {mode!r}; there are {', '.join(MODES)}")


def match(reads: DataFrame, plan: MatchPlan, *, seq: str = "seq", qual: str | None = None, mode: str = "all", strict: bool = False) -> DataFrame:
    """One row a world: the read's columns, ``dist``, ``ctx`` (the row of each variable's table, from 0), ``world`` (its place), and ``<name>_seq`` (``<name>_qual``) for each named region."""
    found = reads.withColumn("_worlds", worlds_column(F.col(seq), plan, strict)).withColumn("_worlds", in_mode(F.col("_worlds"), mode))
    rows = found.select(*reads.columns, F.posexplode_outer("_worlds").alias("world", "_world")).where("_world is not null")
    out = []
    for name, lo, hi in plan.names:
        start, end = F.col("_world.locs")[lo], F.col("_world.locs")[hi]
        out.append(F.substring(F.col(seq), start + 1, end - start).alias(f"{name}_seq"))
        if qual:
            out.append(F.substring(F.col(qual), start + 1, end - start).alias(f"{name}_qual"))
    return rows.select(*reads.columns, "world", F.col("_world.dist").alias("dist"), F.col("_world.ctx").alias("ctx"), F.col("_world.locs").alias("locs"), *out)


# Searches that count or list hits; these round the allowed edits and take patterns as they are.


def rounded_edits(length: int, rate: float) -> int:
    return int(np.floor(np.float32(length) * np.float32(rate) + np.float32(0.5)))


def count_matches(seq: Column, pattern: str, rate: float = 0.0) -> Column:
    """Number of disjoint hits."""
    k = rounded_edits(len(pattern), rate)
    if k == 0:
        if not pattern:
            return F.lit(0.0).cast("float")
        return ((F.length(seq) - F.length(F.replace(seq, F.lit(pattern), F.lit("")))) / len(pattern)).cast("float")

    @F.arrow_udf("float")
    def count(seqs: pa.Array) -> pa.Array:
        return pa.array([float(len(hits)) for hits in disjoint_in(pattern, [s or "" for s in seqs.to_pylist()], k)], pa.float32())

    return count(seq)


def describe(seq: Column, terms: dict[str, str], reverse_complement: bool = False, rate: float = 0.0) -> Column:
    """``[ _ a _ -b _ ]``: the names of the terms found, by where they begin; ties by name, a forward hit first."""
    from readloom.lang.text import revcomp

    patterns = [(name, text) for name, text in sorted(terms.items())]
    if reverse_complement:
        patterns += [(f"-{name}", revcomp(text)) for name, text in sorted(terms.items())]

    @F.arrow_udf("string")
    def described(seqs: pa.Array) -> pa.Array:
        texts = [s or "" for s in seqs.to_pylist()]
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for i, (name, text) in enumerate(patterns):
            for own, hits in zip(found, disjoint_in(text, texts, rounded_edits(len(text), rate))):
                own += [(h[0], i, name) for h in hits]
        return pa.array(["[ _ " + "".join(f"{name} _ " for _, _, name in sorted(own)) + "]" for own in found], pa.string())

    return described(seq)
