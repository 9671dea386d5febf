"""Types of the script language, and Spark's for them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    name: str

    def __str__(self) -> str:
        return self.name


BOOL, NUM, STR, ANY, EFFECT, TYPE = (Type(x) for x in ("Bool", "Num", "Str", "Any", "Effect", "Type"))
PRIMITIVES = {t.name: t for t in (BOOL, NUM, STR, ANY, EFFECT, TYPE)}


@dataclass(frozen=True)
class ListOf:
    of: object

    def __str__(self) -> str:
        return f"$[{self.of}]"


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, object], ...]
    open: bool = False

    @classmethod
    def of(cls, fields: dict, open: bool = False) -> Record:
        return cls(tuple(fields.items()), open)

    def get(self, name: str):
        return dict(self.fields).get(name)

    def __str__(self) -> str:
        return "{ " + ", ".join(f"{n}: {t}" for n, t in self.fields) + (" .. }" if self.open else " }")


@dataclass(frozen=True)
class Function:
    params: tuple
    result: object
    opts: tuple[tuple[str, object], ...] = field(default=())

    def __str__(self) -> str:
        return f"({', '.join(map(str, self.params))}) -> {self.result}"


def fits(have, want) -> bool:
    """Whether a value of one type may stand where another is asked for."""
    if ANY in (have, want):
        return True
    if isinstance(have, ListOf) and isinstance(want, ListOf):
        return fits(have.of, want.of)
    if isinstance(have, Record) and isinstance(want, Record):
        a, b = dict(have.fields), dict(want.fields)
        shared = all(fits(a[n], b[n]) for n in a.keys() & b.keys())
        return shared and (have.open or b.keys() <= a.keys()) and (want.open or a.keys() <= b.keys())
    if isinstance(have, Function) and isinstance(want, Function):
        return len(have.params) == len(want.params) and all(map(fits, want.params, have.params)) and fits(have.result, want.result)
    return have == want


def spark_type(kind) -> T.DataType:
    if isinstance(kind, ListOf):
        return T.ArrayType(spark_type(kind.of))
    if isinstance(kind, Record):
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in kind.fields])
    simple = {BOOL: T.BooleanType(), NUM: T.FloatType(), STR: T.StringType(), ANY: T.StringType()}
    if kind not in simple:
        raise TypeError(f"no column holds a {kind}")
    return simple[kind]


def of_spark(kind: T.DataType):
    if isinstance(kind, T.StructType):
        return Record.of({f.name: of_spark(f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return ListOf(of_spark(kind.elementType))
    if isinstance(kind, T.BooleanType):
        return BOOL
    return NUM if isinstance(kind, T.NumericType) else STR
