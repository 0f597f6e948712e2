"""Helpers for tables of vectors."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for a vector without null or non-finite components that is not zero or empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ~bad
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pair_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of unit vectors, by the same order of sums wherever a pair is met."""
    return np.minimum(1.0, np.maximum(-1.0, (a * b).sum(axis=1)))
