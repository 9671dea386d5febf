"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with the value computed once however often ``fn`` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), fn), 1)
