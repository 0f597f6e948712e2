"""Exact ranks and quantiles inside groups of any size.

A window partitioned by month would put a whole month into one task. Here the
rows are range-partitioned on (group, value, key) instead, so a large group or a
heavily repeated value spreads over many tasks. Each row's position inside its
task plus the group rows in earlier tasks gives the exact rank. The table of
per-task group spans has at most one row per (group, task) pair that actually
touch: groups + tasks rows in total.

Mean ranks and quantiles need no row order: ranks come from counts per value,
quantiles from brackets that a sketch gives and exact counts around them.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from monthloom.staging import stage

_POS, _TASK, _START, _BEFORE = "__pos", "__task", "__start", "__before"


def ordered_index(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    rank_col: str = "rank_in_group",
    size_col: str = "group_size",
) -> DataFrame:
    """Add the exact 1-based rank and the group size.

    ``order`` should end in a unique key. Rows must have non-NULL group columns.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_POS, F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(_TASK, F.shiftright(_POS, 33).cast("int"))
    w = Window.partitionBy(*group)
    before = w.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    spans = stage(
        placed.groupBy(*group, _TASK)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min(_POS).alias(_START),
        )
        .select(
            *group,
            _TASK,
            _START,
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BEFORE),
            F.sum("__n").over(w).alias(size_col),
        ),
        "spans",
    )
    return (
        placed.join(spans, [*group, _TASK])
        .withColumn(rank_col, F.col(_BEFORE) + F.col(_POS) - F.col(_START) + 1)
        .drop(_POS, _TASK, _START, _BEFORE)
    )


def _running_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of ``keys``, with the total of ``__n`` up to each within its task."""
    placed = counts.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            run = np.cumsum(np.asarray(batch.column("__n"))) + total
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(run), pa.array(np.full(len(run), task, np.int32))],
                names=[*batch.schema.names, _POS, _TASK])

    fields = [*placed.schema.fields, StructField(_POS, LongType()), StructField(_TASK, IntegerType())]
    return placed.mapInArrow(add, StructType([StructField(f.name, f.dataType) for f in fields]))


def value_ranks(
    df: DataFrame, group: Sequence[str], value: str, rank_col: str = "avg_rank",
    size_col: str = "group_size", count_col: str | None = None,
) -> DataFrame:
    """One staged row per (group, value): the mean rank of its rows and the group size.

    ``count_col`` also names the number of rows of the value.

    Rows are counted per value before anything is shuffled or ordered, so a value that fills a
    third of the table is one row here; two running sums over the counts give the mean rank.
    """
    keys = [*group, value]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    placed = stage(_running_totals(counts, keys), "value-counts")
    w = Window.partitionBy(*group)
    before = w.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        placed.groupBy(*group, _TASK)
        .agg(F.sum("__n").alias("__total"), F.min(F.col(_POS) - F.col("__n")).alias(_START))
        .select(
            *group, _TASK, _START,
            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(_BEFORE),
            F.sum("__total").over(w).alias(size_col),
        )
    )
    lower = F.col(_BEFORE) + F.col(_POS) - F.col("__n") - F.col(_START)
    return stage(
        placed.join(spans, [*group, _TASK]).select(
            *keys, (lower + (F.col("__n") + 1) / 2.0).alias(rank_col), size_col,
            *([F.col("__n").alias(count_col)] if count_col else [])),
        "value-ranks",
    )


def average_ranks(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    rank_col: str = "avg_rank",
    size_col: str = "group_size",
) -> DataFrame:
    """Add the rank of ``value`` in its group, ties sharing the mean of their ranks.

    Rows of a repeated value share one row of ranks, so AQE can split that key's rows.
    """
    return df.join(value_ranks(df, group, value, rank_col, size_col), [*group, value])


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    A mergeable sketch brackets each quantile within four parts in ``accuracy`` of its group; exact
    counts say how many rows lie below each bracket, and only the values inside are put in order,
    counted per value first. A bracket that missed its quantile would raise an error.
    """
    v = F.col("__v")
    rows = stage(
        df.select(*group, F.col(value).cast("double").alias("__v")).where(v.isNotNull()), "values")
    margin = 2.0 / accuracy
    cuts = [c for p in probs.values() for c in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = stage(rows.groupBy(*group).agg(
        F.percentile_approx("__v", cuts, accuracy).alias("__cuts")), "brackets")
    tagged = rows.join(sketch, list(group))
    bounds = {n: (F.get("__cuts", F.lit(2 * i)), F.get("__cuts", F.lit(2 * i + 1)))
              for i, n in enumerate(probs)}
    around = tagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[c for n, (lo, hi) in bounds.items() for c in (
            F.count_if(v < lo).alias(f"__below_{n}"),
            F.max(F.when(v < lo, v)).alias(f"__last_{n}"),
            F.min(F.when(v > hi, v)).alias(f"__next_{n}"))])
    held = F.array_compact(F.array(*[
        F.when((v >= lo) & (v <= hi), F.lit(n)) for n, (lo, hi) in bounds.items()]))
    inside = tagged.select(*group, F.explode(held).alias("__p"), "__v").groupBy(
        *group, "__p", "__v").agg(F.count(F.lit(1)).alias("__n"))
    in_order = Window.partitionBy(*group, "__p").orderBy("__v")
    ranked = inside.withColumn("__upto", F.sum("__n").over(in_order)).join(around, list(group))
    parts = []
    for n, p in probs.items():
        below, h = F.col(f"__below_{n}"), (F.col("__rows") - 1) * F.lit(float(p))
        mine = F.col("__p") == n
        parts.append(F.max(F.when(mine, F.col("__upto"))).alias(f"__size_{n}"))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            parts.append(F.min(F.when(mine & (below + F.col("__upto") > rank), v))
                         .alias(f"__{side}_{n}"))
    counted = [c for c in around.columns if c not in group]
    wide = ranked.groupBy(*group).agg(*parts, *[F.first(c).alias(c) for c in counted])
    out = [F.col(g) for g in group]
    for n, p in probs.items():
        h, below = (F.col("__rows") - 1) * F.lit(float(p)), F.col(f"__below_{n}")

        def value_at(rank: Column, found: Column) -> Column:
            # The bracket is exact up to one row on either side.
            return F.when(rank == below - 1, F.col(f"__last_{n}")).when(
                rank == below + F.col(f"__size_{n}"), F.col(f"__next_{n}")).when(
                (rank < below) | found.isNull(),
                F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
            ).otherwise(found)

        lo = value_at(F.floor(h), F.col(f"__lo_{n}"))
        hi = value_at(F.ceil(h), F.col(f"__hi_{n}"))
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(n))
    return wide.select(*out)


def spread_group_stats(df: DataFrame, group: Sequence[str], *aggs: Column) -> DataFrame:
    """Group totals joined back to the rows.

    The totals are pre-aggregated on the map side and staged, so their exact size
    decides between a broadcast and a shuffle join; AQE splits skewed groups there.
    """
    stats = stage(df.groupBy(*group).agg(*aggs), "groupstats")
    return df.join(stats, list(group))


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One row from several one-row tables, by scalar subqueries instead of joins."""
    first, *rest = parts
    return first.select(
        "*", *[p.select(c).scalar().alias(c) for p in rest for c in p.columns]
    )
