"""What scripts do with constants on the driver, as the column functions do with rows."""

from __future__ import annotations

import numpy as np

from readloom.functions.scalar import BASES, COMPLEMENTS

_TABLE = str.maketrans(BASES, COMPLEMENTS)


def revcomp(s: str) -> str:
    return s.translate(_TABLE)[::-1]


def number_text(x: float) -> str:
    """As ``functions.scalar.number_text``."""
    x = np.float32(x)
    if np.isnan(x):
        return "NaN"
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(x, unique=True, trim="-")
