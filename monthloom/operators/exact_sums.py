"""Sums of doubles without rounding, whatever the order of the rows.

A double is a whole number times a power of two. It is split, without error, into pieces of 32 bits
at fixed places of one very long number; pieces of equal place add up as whole numbers, first in
each task and then across tasks, so a hot group moves as few rows as any other. The long number is
rounded once, at the end, to the nearest double.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from monthloom.shipping import ship_package

_PLACE = 32
_LOWEST = 1152  # the last of 53 bits of the smallest double, 2 ** -1074, lies above 2 ** -1152
_NOT_A_NUMBER, _PLUS, _MINUS = -1, -2, -3  # places of values that are not finite


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole-number pieces of each value, three each; zero pieces are harmless."""
    fraction, exponent = np.frexp(x)
    whole = (fraction * 2.0**53).astype(np.int64)
    at = exponent.astype(np.int64) - 53 + _LOWEST
    place, shift = at // _PLACE, (at % _PLACE).astype(np.uint64)
    size, sign = np.abs(whole).astype(np.uint64), np.sign(whole)
    low = (size & np.uint64(0xFFFFFFFF)) << shift
    high = (size >> np.uint64(32)) << shift  # 21 bits moved by less than 32
    mask = np.uint64(0xFFFFFFFF)
    pieces = [low & mask, (low >> np.uint64(32)) + (high & mask), high >> np.uint64(32)]
    return (np.stack([place, place + 1, place + 2]),
            np.stack([p.astype(np.int64) * sign for p in pieces]))


def _rounded(places: Sequence[int], totals: Sequence[int]) -> float:
    special = {p for p, t in zip(places, totals) if p < 0 and t}
    if special:
        if _NOT_A_NUMBER in special or {_PLUS, _MINUS} <= special:
            return float("nan")
        return float("inf") if _PLUS in special else float("-inf")
    whole = sum(int(t) << (_PLACE * p) for p, t in zip(places, totals))
    try:
        return float(Fraction(whole, 1 << _LOWEST))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def exact_sums(df: DataFrame, group: Sequence[str], value: str | Column, name: str = "total"
               ) -> DataFrame:
    """``group`` columns and the correctly rounded sum of a value; NULL and text that is no number
    count as nothing, and a group of nothing sums to NULL. NaN and infinities follow the usual
    rules. Groups may be NULL."""
    ship_package(df.sparkSession)
    x = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    rows = df.select(*group, x.alias("__x"))
    keep = len(group)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(keep)
            x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            there = ~np.asarray(column.is_null())
            finite = np.isfinite(x)
            place, piece = split(np.where(finite, x, 0.0))
            other = np.where(np.isnan(x), _NOT_A_NUMBER, np.where(x > 0, _PLUS, _MINUS))
            place[0] = np.where(finite, place[0], other)
            piece[0] = np.where(finite, piece[0], 1)
            for i, (p, v) in enumerate(zip(place, piece)):
                if i == 0 or v.any():
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:keep], pa.array(p), pa.array(v),
                         pa.array(there.astype(np.int64) if i == 0 else np.zeros_like(v))],
                        names=[*batch.schema.names[:keep], "__place", "__piece", "__there"])

    fields = [StructField(f.name, f.dataType, True) for f in rows.schema.fields[:keep]]
    schema = StructType(fields + [StructField(c, LongType()) for c in
                                  ("__place", "__piece", "__there")])
    # Halves keep a sum of more than 2 ** 31 pieces within a long.
    halves = rows.mapInArrow(pieces, schema).groupBy(*group, "__place").agg(
        F.sum(F.shiftright("__piece", 16)).alias("__high"),
        F.sum(F.col("__piece").bitwiseAND(F.lit(0xFFFF))).alias("__low"),
        F.sum("__there").alias("__there"))
    cell = F.struct("__place", "__high", "__low")
    lists = halves.groupBy(*group).agg(  # at most some seventy places each
        F.collect_list(cell).alias("__cells"), F.sum("__there").alias("__there"))

    def total(cells: pd.Series) -> pd.Series:
        return pd.Series([
            _rounded([c["__place"] for c in row],
                     [(int(c["__high"]) << 16) + int(c["__low"]) for c in row])
            for row in cells], dtype="float64")

    # NaN comes back from pandas as NULL.
    rounded = F.coalesce(F.pandas_udf(total, "double")("__cells"), F.lit(float("nan")))
    return lists.select(*group, F.when(F.col("__there") > 0, rounded).alias(name))
