"""From a script to DataFrames of effects.

Terms become columns, or constants where nothing of a read is in them; functions are inlined.  A statement adds its
effects to a frame: a DataFrame of reads, the condition under which control gets there, and a path of numbers whose
lexicographic order is the order in which a reader of the script would meet the effects.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import scalar as S
from readloom.functions.display import display
from readloom.lang.syntax import Node, ScriptError, parse, parse_term
from readloom.lang.text import number_text, revcomp
from readloom.lang.types import ANY, BOOL, EFFECT, NUM, PRIMITIVES, STR, TYPE, Function, ListOf, Record, fits, of_spark, spark_type
from readloom.operators import matching
from readloom.plans.regions import Hole, MatchPlan, Named, Sized, Term, compile_regions
from readloom.sources import registry
from readloom.sinks.files import body_for

NOTHING = object()


@dataclass
class Value:
    """A typed value: a constant, a column, or parts that are values themselves."""

    type: Any
    column: Column | None = None
    constant: Any = NOTHING
    fields: dict[str, Value] | None = None
    items: list[Value] | None = None
    call: Callable | None = None
    shape: Any = None  # the fields that are there, where the type tells only some

    @property
    def known(self) -> Record:
        return self.shape or self.type

    def col(self) -> Column:
        if self.column is not None:
            return self.column
        if self.fields is not None and self.constant is NOTHING:
            return F.struct(*(v.col().alias(n) for n, v in self.fields.items()))
        if self.items is not None and self.constant is NOTHING:
            return F.array(*(v.col() for v in self.items)) if self.items else F.array().cast(spark_type(self.type))
        return literal(self.constant, self.type)


def literal(value: Any, kind: Any) -> Column:
    if isinstance(kind, (ListOf, Record)):
        plain = spark_type(kind)
        return F.from_json(F.lit(json.dumps(value, default=float)), plain.simpleString()) if value else F.array().cast(plain)
    return F.lit(float(value)).cast("float") if kind == NUM else F.lit(value)


def constant(value: Any) -> Value:
    if isinstance(value, bool):
        return Value(BOOL, constant=value)
    if isinstance(value, str):
        return Value(STR, constant=value)
    if isinstance(value, dict):
        parts = {k: constant(v) for k, v in value.items()}
        return Value(Record.of({k: v.type for k, v in parts.items()}), constant=value, fields=parts)
    return Value(NUM, constant=np.float32(value))


@dataclass
class Frame:
    rows: DataFrame
    guard: Column | None
    path: list

    def at(self, *more) -> Frame:
        return replace(self, path=[*self.path, *more])

    def when(self, test: Column) -> Frame:
        return replace(self, guard=test if self.guard is None else self.guard & test)

    def filtered(self) -> DataFrame:
        return self.rows if self.guard is None else self.rows.where(self.guard)


@dataclass
class Effect:
    kind: str
    frame: Frame
    parts: dict[str, Value]


@dataclass
class Program:
    """Effects by kind: ``stdout`` (value), ``out`` (filename, body), ``count`` (name, value), ``mean`` (name, value), each with ``_row_id`` and ``_seq``.

    ``events`` has all of them in one pass over each frame of the script, for :func:`of_kind`.
    """

    stdout: DataFrame | None = None
    out: DataFrame | None = None
    count: DataFrame | None = None
    mean: DataFrame | None = None
    effects: list[Effect] = field(default_factory=list)
    events: DataFrame | None = None




class Compiler:
    def __init__(self, spark: SparkSession, *, error: float = 0.0, mode: str = "all", strict: bool = False):
        self.spark, self.error, self.mode, self.strict = spark, error, mode, strict
        self.effects: list[Effect] = []
        self.columns = 0
        self.natives = natives(self)

    # Errors and types.

    def wrong(self, node: Node, message: str) -> None:
        raise ScriptError(message, node.start, node.end)

    def expect(self, node: Node, value: Value, want: Any) -> Value:
        if not fits(value.type, want):
            self.wrong(node, f"mismatched types: expected {want}, found {value.type}")
        return value

    def type_of(self, node: Node, env: dict) -> Any:
        if node.kind == "name" and node.name in PRIMITIVES:
            return PRIMITIVES[node.name]
        if node.kind == "list_type":
            return ListOf(self.type_of(node.of, env))
        if node.kind == "record_type":
            return Record.of({n: self.type_of(t, env) for n, t in node.fields}, node.open)
        if node.kind == "record" and not node.fields:
            return Record.of({})
        if node.kind == "function_type":
            return Function(tuple(self.type_of(p, env) for p in node.params), self.type_of(node.result, env))
        value = self.term(node, env)
        if value.type != TYPE:
            self.wrong(node, f"mismatched types: expected Type, found {value.type}")
        return value.constant

    # Terms.

    def term(self, node: Node, env: dict[str, Value]) -> Value:
        return getattr(self, f"_{node.kind}")(node, env)

    def _bool(self, node: Node, env: dict) -> Value:
        return Value(BOOL, constant=node.value)

    def _number(self, node: Node, env: dict) -> Value:
        return Value(NUM, constant=np.float32(node.value))

    def _string(self, node: Node, env: dict) -> Value:
        parts = [Value(STR, constant=p) if isinstance(p, str) else self.shown(self.term(p, env)) for p in node.parts]
        if all(p.constant is not NOTHING for p in parts):
            return Value(STR, constant="".join(p.constant for p in parts))
        return Value(STR, F.concat(*(p.col() for p in parts)))

    def shown(self, value: Value) -> Value:
        if value.constant is not NOTHING and value.type == STR:
            return value
        if value.constant is not NOTHING and value.type == NUM:
            return Value(STR, constant=number_text(value.constant))
        if value.type in (EFFECT, TYPE) or isinstance(value.type, Function):
            raise ScriptError(f"nothing says how to show {value.type}", 0, 0)
        return Value(STR, display(value.col(), spark_type(value.known)))

    def _name(self, node: Node, env: dict) -> Value:
        if node.name in env:
            return env[node.name]
        if node.name in self.natives:
            return self.natives[node.name]
        if node.name in PRIMITIVES:
            return Value(TYPE, constant=PRIMITIVES[node.name])
        self.wrong(node, f"unknown name '{node.name}'")

    def _field(self, node: Node, env: dict) -> Value:
        value = self.term(node.value, env)
        if not isinstance(value.type, Record) or value.type.open:
            self.wrong(node.value, f"mismatched types: expected a record, found {value.type}")
        kind = value.type.get(node.name)
        if kind is None:
            self.wrong(node, f"no field '{node.name}' in {value.type}")
        if value.fields is not None:
            return value.fields[node.name]
        return Value(kind, value.col()[node.name])

    def _record(self, node: Node, env: dict) -> Value:
        parts = {n: self.term(t, env) for n, t in node.fields}
        kind = Record.of({n: v.type for n, v in parts.items()})
        if parts and all(v.constant is not NOTHING for v in parts.values()):
            return Value(kind, constant={n: v.constant for n, v in parts.items()}, fields=parts)
        return Value(kind, fields=parts)

    def _list(self, node: Node, env: dict) -> Value:
        items = [self.term(t, env) for t in node.items]
        kind = items[0].type if items else ANY
        for t, v in zip(node.items, items):
            self.expect(t, v, kind)
        if all(v.constant is not NOTHING for v in items):
            return Value(ListOf(kind), constant=[v.constant for v in items], items=items)
        return Value(ListOf(kind), items=items)

    def _binary(self, node: Node, env: dict) -> Value:
        name = {"+": "plus", "-": "minus", "*": "times", "/": "division", "%": "modulo", "^": "exponent", "==": "equal", "!=": "not_equal", "<": "less_than", ">": "greater_than", "<=": "less_than_or_equal", ">=": "greater_than_or_equal", "and": "and", "or": "or"}[node.op]
        return self.apply(node, self.natives[f"binary_{name}"], [node.left, node.right], [], env)

    def _unary(self, node: Node, env: dict) -> Value:
        if node.op == "not":
            return self.apply(node, self.natives["unary_not"], [node.value], [], env)
        kind = self.term(node.value, env).type
        name = "unary_minus" if kind == NUM else "unary_reverse_complement" if kind == STR else "unary_read_reverse_complement"
        return self.apply(node, self.natives[name], [node.value], [], env)

    def _function(self, node: Node, env: dict) -> Value:
        given = dict(env)
        kinds = [(p.name, self.type_of(p.type, env), p) for p in node.params]
        for _, kind, p in kinds:
            if p.default is not None:
                self.expect(p.default, self.term(p.default, env), kind)
        placed = {n: Value(k, call=lambda args, opts, k=k: Value(k.result, F.lit(None))) if isinstance(k, Function) else Value(k, F.lit(None), shape=k) for n, k, _ in kinds}

        def call(args: list[Value], opts: dict[str, Value]) -> Value:
            own = dict(given)
            rest = list(args)
            for name, _, p in kinds:
                own[name] = rest.pop(0) if p.default is None else opts.get(name) or self.term(p.default, given)
            return self.term(node.body, own)

        try:
            result = self.term(node.body, given | placed).type
        except TypeError:
            result = ANY
        return Value(Function(tuple(k for _, k, p in kinds if p.default is None), result, tuple((n, k) for n, k, p in kinds if p.default is not None)), call=call)

    def _foreign(self, node: Node, env: dict) -> Value:
        if node.name not in self.natives:
            self.wrong(node, f"unknown native function '{node.name}'")
        native = self.natives[node.name]
        params = [(p.name, self.type_of(p.type, env), p) for p in node.params]
        result = native.type.result if node.type.kind == "list_type" else self.type_of(node.type, env)
        defaults = {n: self.term(p.default, env) for n, _, p in params if p.default is not None}
        return Value(Function(tuple(k for _, k, p in params if p.default is None), result, tuple((n, k) for n, k, p in params if p.default is not None)), call=lambda args, opts: replace(v := native.call(args, defaults | opts), type=result, shape=v.shape if isinstance(result, Record) and result.open else None))

    def _list_type(self, node: Node, env: dict) -> Value:
        return Value(TYPE, constant=self.type_of(node, env))

    _record_type = _function_type = _list_type

    def _call(self, node: Node, env: dict) -> Value:
        head = self.term(node.head, env)
        return self.apply(node, head, node.args, node.opts, env)

    def apply(self, node: Node, head: Value, args: list[Node], opts: list[tuple[str, Node]], env: dict) -> Value:
        if not isinstance(head.type, Function):
            self.wrong(node, f"mismatched types: expected a function, found {head.type}")
        if len(args) != len(head.type.params):
            self.wrong(node, f"expected {len(head.type.params)} arguments, found {len(args)}")
        values = [self.expect(a, self.term(a, env), want) for a, want in zip(args, head.type.params)]
        known, given = dict(head.type.opts), {}
        for name, value in opts:
            if name not in known:
                listed = ", ".join(f"{n}: {k}" for n, k in head.type.opts)
                self.wrong(node, f"found optional argument named '{name}'; only expected optional arguments {{ {listed} }}")
            given[name] = self.expect(value, self.term(value, env), known[name])
        try:
            return head.call(values, given)
        except ScriptError:
            raise
        except (TypeError, ValueError, FileNotFoundError) as e:
            self.wrong(node, str(e))

    # Statements.

    def run(self, stmts: list[Node], frame: Frame, env: dict[str, Value]) -> None:
        env = dict(env)
        for i, node in enumerate(stmts):
            here = frame.at(i)
            if node.kind == "let":
                if node.name in env or node.name in self.natives:
                    self.wrong(node, f"'{node.name}' is already defined")
                env[node.name] = self.term(node.value, env)
            elif node.kind == "effect":
                value = self.expect(node.value, self.term(node.value, env), EFFECT)
                kind, parts = value.constant
                self.effects.append(Effect(kind, here, parts))
            elif node.kind == "if":
                test = self.expect(node.test, self.term(node.test, env), BOOL).col()
                self.run(node.then, here.when(test), env)
                if node.other is not None:
                    self.run(node.other, here.when(~test), env)
            else:
                self.match(node, here, env)

    def match(self, node: Node, frame: Frame, env: dict) -> None:
        value = self.term(node.value, env)
        rows, before = frame.filtered(), F.lit(True)  # what is known without searching goes before the search
        for case in node.cases:
            pattern = case.pattern
            if pattern.kind == "read":
                plan, variables = self.plan(pattern, value, env)
                name = self.fresh()
                rows = rows.withColumn(name, matching.worlds_column(value.col()["seq"], plan, self.strict))
                rows = rows.withColumn(name, matching.in_mode(F.col(name), self.mode))
                place, world = self.fresh(), self.fresh()
                inner = rows.where(before & (F.size(name) > 0)).select("*", F.posexplode_outer(name).alias(place, world)).where(F.col(world).isNotNull())
                inner = inner.drop(name)
                self.run(case.body, Frame(inner, None, [*frame.path, F.col(place)]), env | self.bound(plan, variables, value, world))
                before = before & (F.size(name) == 0)
            else:
                test, binds = self.test(pattern, value)
                self.run(case.body, Frame(rows, before & test, [*frame.path, 0]), env | binds)
                before = before & ~test

    def fresh(self) -> str:
        self.columns += 1
        return f"_c{self.columns}"

    def test(self, pattern: Node, value: Value) -> tuple[Column, dict[str, Value]]:
        if pattern.kind == "any":
            return F.lit(True), {}
        if pattern.kind == "named":
            test, binds = self.test(pattern.pattern, value)
            return test, binds | {pattern.name: value}
        if pattern.kind == "constant":
            want = self.term(pattern.value, {})
            self.expect(pattern, want, value.type)
            return equal(value, want).col(), {}
        if pattern.kind == "record":
            if not isinstance(value.type, Record):
                self.wrong(pattern, f"mismatched types: expected a record, found {value.type}")
            test, binds = F.lit(True), {}
            for name, part in pattern.fields:
                kind = value.known.get(name)
                if kind is None:
                    self.wrong(pattern, f"no field '{name}' in {value.type}")
                own = value.fields[name] if value.fields is not None else Value(kind, value.col()[name])
                more, new = self.test(part, own)
                test, binds = test & more, binds | new
            return test, binds
        self.wrong(pattern, "a read pattern can't stand within a record pattern")

    def plan(self, pattern: Node, value: Value, env: dict) -> tuple[MatchPlan, list[tuple[str, list[dict], Any]]]:
        if not fits(value.type, Record.of({"seq": STR}, True)):
            self.wrong(pattern, f"mismatched types: expected {{ seq: Str .. }}, found {value.type}")
        variables = []
        for t in pattern.tables:
            table = self.term(t.value, env)
            if not isinstance(table.type, ListOf) or table.constant is NOTHING:
                self.wrong(t, "a list that no read changes is needed here")
            variables.append((t.name, table.constant, table.type.of))
        names = [n for n, _, _ in variables]

        def regions(nodes: list[Node]) -> tuple:
            return tuple(map(region, nodes))

        def region(r: Node):
            if r.kind == "hole":
                return Hole()
            if r.kind == "named":
                return Named(r.name, regions(r.regions))
            if r.kind == "sized":
                return Sized(self.fixed(r.size, env, NUM), regions(r.regions))
            uses = sorted({names.index(n) for n in mentioned(r.value) if n in names})
            rate = self.error if r.rate is None else float(self.fixed(r.rate, env, NUM))
            choices = []
            for rows in _product([range(len(variables[i][1])) for i in uses]):
                own = {names[i]: constant(variables[i][1][k]) for i, k in zip(uses, rows)}
                choices.append((tuple(rows), self.fixed(r.value, env | own, STR)))
            return Term(tuple(choices), rate, tuple(uses))

        try:
            return compile_regions(regions(pattern.regions), len(variables)), variables
        except ValueError as e:
            self.wrong(pattern, str(e))

    def fixed(self, node: Node, env: dict, kind: Any) -> Any:
        value = self.expect(node, self.term(node, env), kind)
        if value.constant is NOTHING:
            self.wrong(node, "this part of a pattern can't depend on the read")
        return value.constant

    def bound(self, plan: MatchPlan, variables: list, value: Value, world: str) -> dict[str, Value]:
        out = {}
        for i, (name, rows, kind) in enumerate(variables):
            at = F.col(world)["ctx"][i] + 1
            if isinstance(kind, Record):
                out[name] = Value(kind, fields={f: Value(t, F.element_at(literal([r[f] for r in rows], ListOf(t)), at)) for f, t in kind.fields})
            else:
                out[name] = Value(kind, F.element_at(literal(rows, ListOf(kind)), at))
        names = [n for n, _ in value.known.fields]
        for name, lo, hi in plan.names:
            cut = S.slice_read(value.col(), names, F.col(world)["locs"][lo], F.col(world)["locs"][hi])
            out[name] = Value(value.type, cut, shape=value.shape)
        return out


def mentioned(node: Node) -> set[str]:
    """Names that a term mentions."""
    out = {node.name} if node.kind == "name" else set()
    for x in node.data.values():
        for y in x if isinstance(x, list) else [x]:
            for z in y if isinstance(y, tuple) else [y]:
                if isinstance(z, Node):
                    out |= mentioned(z)
    return out


def _product(ranges: list) -> list[tuple]:
    return reduce(lambda acc, r: [(*a, x) for a in acc for x in r], ranges, [()])


def equal(a: Value, b: Value) -> Value:
    """Values of different types aren't equal, nor are lists; NaN equals nothing."""
    if a.type == NUM and b.type == NUM:
        if NOTHING not in (a.constant, b.constant):
            return Value(BOOL, constant=bool(a.constant == b.constant))
        return Value(BOOL, S.number_equal(a.col(), b.col()))
    if isinstance(a.type, Record) and isinstance(b.type, Record):
        x, y = dict(a.known.fields), dict(b.known.fields)
        if x.keys() != y.keys():
            return Value(BOOL, constant=False)
        part = lambda v, n, t: v.fields[n] if v.fields is not None else Value(t, v.col()[n])
        return Value(BOOL, reduce(lambda p, q: p & q, (equal(part(a, n, x[n]), part(b, n, y[n])).col() for n in x), F.lit(True)))
    if a.type != b.type or a.type not in (BOOL, STR):
        return Value(BOOL, constant=False)
    if NOTHING not in (a.constant, b.constant):
        return Value(BOOL, constant=a.constant == b.constant)
    return Value(BOOL, a.col() == b.col())


def natives(c: Compiler) -> dict[str, Value]:
    """The functions that scripts start with.  Fixed values: their names and parameters, by which scripts know them."""
    out: dict[str, Value] = {}

    def add(name: str, params: list, result: Any, build: Callable, fold: Callable | None = None, /, **opts: tuple[Any, Any]) -> None:
        defaults = {n: constant(d) for n, (_, d) in opts.items()}

        def call(args: list[Value], given: dict[str, Value]) -> Value:
            every = [*args, *(given.get(n, defaults[n]) for n in defaults)]
            if fold is not None and all(v.constant is not NOTHING for v in every):
                x = fold(*(v.constant for v in every))
                return Value(result, constant=np.float32(x) if result == NUM else x)
            got = build(*every)
            return got if isinstance(got, Value) else Value(result, got)

        out[name] = Value(Function(tuple(params), result, tuple((n, t) for n, (t, _) in opts.items())), call=call)

    def plain(fn: Callable) -> Callable:
        return lambda *vs: fn(*(v.col() for v in vs))

    f32 = np.float32
    with_seq, with_desc = Record.of({"seq": STR}, True), Record.of({"desc": STR}, True)
    for name, fn, fold in (("plus", S.plus, lambda a, b: f32(a) + f32(b)), ("minus", S.minus, lambda a, b: f32(a) - f32(b)), ("times", S.times, lambda a, b: f32(a) * f32(b)), ("division", S.divide, None), ("modulo", S.modulo, None), ("exponent", S.power, lambda a, b: f32(a) ** f32(b))):
        add(f"binary_{name}", [NUM, NUM], NUM, plain(fn), fold)
    for name, fn in (("less_than", lambda a, b: a < b), ("greater_than", lambda a, b: a > b), ("less_than_or_equal", lambda a, b: a <= b), ("greater_than_or_equal", lambda a, b: a >= b)):
        add(f"binary_{name}", [NUM, NUM], BOOL, plain(fn), lambda a, b, fn=fn: bool(fn(a, b)))
    add("binary_equal", [ANY, ANY], BOOL, equal)
    add("binary_not_equal", [ANY, ANY], BOOL, lambda a, b: (lambda e: Value(BOOL, constant=not e.constant) if e.constant is not NOTHING else Value(BOOL, ~e.col()))(equal(a, b)))
    add("binary_and", [BOOL, BOOL], BOOL, plain(lambda a, b: a & b), lambda a, b: a and b)
    add("binary_or", [BOOL, BOOL], BOOL, plain(lambda a, b: a | b), lambda a, b: a or b)
    add("unary_not", [BOOL], BOOL, plain(lambda a: ~a), lambda a: not a)
    add("unary_minus", [NUM], NUM, plain(S.negative), lambda a: -f32(a))
    add("unary_reverse_complement", [STR], STR, plain(S.reverse_complement), revcomp)

    def names(v: Value) -> list[str]:
        return [n for n, _ in v.known.fields]

    def opened(v: Value, column: Column, kind: Record, like: Value | None = None) -> Value:
        return Value(kind, column, shape=replace((like or v).known, open=False))

    add("unary_read_reverse_complement", [with_seq], with_seq, lambda r: opened(r, S.read_reverse_complement(r.col(), names(r)), with_seq))
    add("len", [STR], NUM, plain(S.length), lambda s: len(s.encode()))
    add("slice", [STR, NUM, NUM], STR, plain(S.slice_))
    add("tag", [with_desc, STR], with_desc, lambda r, t, prefix: opened(r, S.tag(r.col(), names(r), t.col(), prefix.col()), with_desc), prefix=(STR, " "))
    add("rename", [with_seq, STR], with_seq, lambda r, t: opened(r, S.rename(r.col(), names(r), t.col()), with_seq))
    add("translate", [STR], STR, plain(S.translate), stop_codon=(STR, "-"), illegal_codon=(STR, "?"))
    add("str_concat", [STR, STR], STR, plain(S.str_concat), lambda a, b: a + b)
    add("concat", [with_seq, with_seq], with_seq, lambda a, b: opened(a, S.concat_reads(a.col(), names(a), b.col(), names(b)), with_seq, b))
    add("find_first", [STR, STR], NUM, plain(S.find_first), lambda a, b: a.find(b))
    add("find_last", [STR, STR], NUM, plain(S.find_last), lambda a, b: a.rfind(b))
    add("lookup", [STR, STR], STR, plain(S.lookup), kv_sep=(STR, "="), sep=(STR, " "))
    add("to_upper", [STR], STR, plain(S.to_upper), str.upper)
    add("to_lower", [STR], STR, plain(S.to_lower), str.lower)
    add("distance", [STR, STR], NUM, plain(S.distance))
    add("to_str", [ANY], STR, lambda v: c.shown(v))
    add("to_num", [STR], NUM, plain(S.to_num), float)
    add("to_qscores", [STR], ListOf(NUM), plain(S.to_qscores))
    for name, fn in (("min", S.list_min), ("max", S.list_max), ("mean", S.list_mean)):
        add(name, [ListOf(NUM)], NUM, plain(fn))
    for name, fn, fold in (("round", S.round_half_away, None), ("floor", S.floor, np.floor), ("ceil", S.ceil, np.ceil)):
        add(name, [NUM], NUM, plain(fn), fold)
    for name in S.FLAGS:
        add(name, [NUM], BOOL, plain(lambda x, name=name: S.flag(name, x)))
        out[f"flag_{name}"] = out[name]

    def contains(xs: Value, x: Value) -> Value:
        if xs.items is not None:
            return Value(BOOL, reduce(lambda p, q: p | q, (equal(i, x).col() for i in xs.items), F.lit(False)))
        if isinstance(xs.type.of, Record):
            return Value(BOOL, reduce(lambda p, q: p | q, (equal(constant(r), x).col() for r in xs.constant), F.lit(False)))
        if xs.type.of != x.type:
            return Value(BOOL, constant=False)
        return Value(BOOL, S.contains(xs.col(), x.col()))

    add("contains", [ListOf(ANY), ANY], BOOL, contains)

    def needed(v: Value, what: str) -> Any:
        if v.constant is NOTHING:
            raise ValueError(f"{what} can't depend on the read")
        return v.constant

    add("count_matches", [with_seq, STR], NUM, lambda r, s, rate: matching.count_matches(r.col()["seq"], needed(s, "the pattern"), float(needed(rate, "the rate"))), error_rate=(NUM, 0.0))
    add("describe", [with_seq, Record.of({}, True)], STR, lambda r, terms, rc, rate: matching.describe(r.col()["seq"], needed(terms, "the terms"), bool(needed(rc, "the strand")), float(needed(rate, "the rate"))), reverse_complement=(BOOL, False), error_rate=(NUM, 0.0))

    # Tables, read when the script is compiled.

    def table(kind: str) -> Callable:
        def load(path: Value) -> Value:
            where = needed(path, "the file's name")
            types = registry.field_types(c.spark, where, kind)
            rows = [r.asDict() for r in registry.scan(c.spark, where, kind).orderBy("_row_id").drop("_row_id").collect()]  # a reference table fits the driver by its use
            return Value(ListOf(Record.of({n: PRIMITIVES[t] for n, t in types.items()})), constant=rows)

        return load

    for kind in ("csv", "tsv", "fasta"):
        add(kind, [STR], ListOf(ANY), table(kind))
    for name, kind in (("csv_ty", "csv"), ("tsv_ty", "tsv"), ("read_ty", None)):
        add(name, [STR], TYPE, lambda path, kind=kind: Value(TYPE, constant=Record.of({n: PRIMITIVES[t] for n, t in registry.field_types(c.spark, needed(path, "the file's name"), kind).items()})))

    # Effects.

    def effect(kind: str, **parts: Value) -> Value:
        return Value(EFFECT, constant=(kind, parts))

    add("stdout!", [ANY], EFFECT, lambda v: effect("stdout", value=v))
    add("out!", [ANY, STR], EFFECT, lambda v, f: effect("out", value=v, filename=f))
    add("count!", [ANY], EFFECT, lambda v, name: effect("count", value=v, name=name), name=(STR, "count"))
    add("mean!", [NUM], EFFECT, lambda v, name: effect("mean", value=v, name=name), name=(STR, "mean"))
    out["average!"] = out["mean!"]
    return out


def compile_script(spark: SparkSession, script: str, reads: DataFrame, *, args: str | None = None, error: float = 0.0, mode: str = "all", strict: bool = False) -> Program:
    """Effects of a script over ``reads(_row_id, read)`` (and ``_strand``), as DataFrames that nothing has run yet."""
    c = Compiler(spark, error=error, mode=mode, strict=strict)
    env = {"read": Value(of_spark(reads.schema["read"].dataType), F.col("read"))}
    if args is not None:
        env["args"] = c.term(parse_term("{" + args + "}"), {})
    first = [F.col("_strand")] if "_strand" in reads.columns else []
    c.run(parse(script).stmts, Frame(reads, None, first), env)
    frames: dict[int, list[Effect]] = {}
    for e in c.effects:
        frames.setdefault(id(e.frame.rows), []).append(e)
    views = {}
    for kind in ("stdout", "out", "count", "mean"):
        own = [some for every in frames.values() if (some := [e for e in every if e.kind == kind])]
        views[kind] = reduce(DataFrame.unionByName, (evaluated(c, some).select("_row_id", "_seq", *_columns(kind)) for some in own)) if own else None
    events = reduce(DataFrame.unionByName, (evaluated(c, every) for every in frames.values())) if frames else None
    return Program(**views, effects=c.effects, events=events)


def _columns(kind: str) -> list[Column]:
    """The columns of an effect's rows, from those that all effects share."""
    name, text, number = F.col("name"), F.col("text"), F.col("number")
    return {"stdout": [text.alias("value")], "out": [name.alias("filename"), text.alias("body")], "count": [name, text.alias("value")], "mean": [name, number.alias("value")]}[kind]


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind of effect among all."""
    return events.where(F.col("kind") == kind).select("_row_id", "_seq", *_columns(kind))


def evaluated(c: Compiler, effects: list[Effect]) -> DataFrame:
    """``kind, _row_id, _seq, name, text, number`` of effects over one frame: each row of it is looked at once, and gives a row for each effect whose guard it meets."""

    def parts(e: Effect) -> list[Column]:
        v, name, text, number = e.parts["value"], F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("float")
        if e.kind == "out":
            name = e.parts["filename"].col()
            text = body_for(v.col(), spark_type(v.known), name)
        elif e.kind == "mean":
            name, number = e.parts["name"].col(), v.col().cast("float")
        else:
            text = c.shown(v).col()
            name = e.parts["name"].col() if e.kind == "count" else name
        path = F.array(*(x.cast("int") if isinstance(x, Column) else F.lit(x) for x in e.frame.path))
        return [F.lit(e.kind).alias("kind"), path.alias("_seq"), name.alias("name"), text.alias("text"), number.alias("number")]

    rows = effects[0].frame.rows
    if len(effects) == 1:
        return effects[0].frame.filtered().select("_row_id", *parts(effects[0]))
    each = [F.struct(*parts(e)) if e.frame.guard is None else F.when(e.frame.guard, F.struct(*parts(e))) for e in effects]
    if all(e.frame.guard is not None for e in effects):
        rows = rows.where(reduce(lambda a, b: a | b, (e.frame.guard for e in effects)))
    some = F.filter(F.array(*each), lambda x: x.isNotNull())
    return rows.select("_row_id", F.explode(some).alias("_e")).select("_row_id", "_e.kind", "_e._seq", "_e.name", "_e.text", "_e.number")
