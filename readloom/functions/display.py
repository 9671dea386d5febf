"""How values look when they are printed, counted or put into strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from readloom.functions.scalar import number_text


def display(x: Column, kind: DataType) -> Column:
    """Strings as they are, numbers without needless points, ``[a, b]``, and ``{ a = 1, b = x }`` by field name."""
    if isinstance(kind, StringType):
        return x
    if isinstance(kind, BooleanType):
        return F.when(x, "true").otherwise("false")
    if isinstance(kind, NumericType):
        return number_text(x)
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: display(e, kind.elementType)), ", "), F.lit("]"))
    if isinstance(kind, StructType):
        cells = [F.concat(F.lit(f"{f.name} = "), display(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{ "), F.concat_ws(", ", *cells), F.lit(" }")) if cells else F.lit("{  }")
    raise TypeError(f"nothing says how to show {kind.simpleString()}")
