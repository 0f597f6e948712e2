"""Expanding windows, forward-chaining folds and historical-mean benchmarks.

Month tables hold one row per calendar month.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import month_index
from monthloom.schema import FORMATION, TARGET
from monthloom.staging import stage


def months_of(rows: DataFrame, date: str = FORMATION) -> DataFrame:
    return rows.where(F.col(date).isNotNull()).groupBy(date).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def expanding_splits(
    rows: DataFrame, start_train: str, start_test: str, end: str, date: str = FORMATION
) -> DataFrame:
    """Per test month the extent of its training window; months without one are left out."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col(date) >= F.lit(start_train).cast("date")
    months = months_of(rows, date).where(inside | (F.col(date) >= F.lit(start_test).cast("date")))
    history = months.withColumns({
        "train_months": F.count_if(inside).over(w),
        "train_rows": F.coalesce(F.sum(F.when(inside, F.col("n_rows"))).over(w), F.lit(0))
        .cast("bigint"),
        "train_start": F.min(F.when(inside, F.col(date))).over(w),
        "train_end": F.max(F.when(inside, F.col(date))).over(w),
    })
    in_test = F.col(date).between(F.lit(start_test).cast("date"), F.lit(end).cast("date"))
    return history.where(in_test & (F.col("train_months") > 0)).select(
        F.col(date).alias("test_month"), "train_months", "train_rows", "train_start",
        "train_end", F.col("n_rows").alias("test_rows"),
    )


def forward_folds(
    rows: DataFrame, n_splits: int = 5, min_train_months: int = 12, date: str = FORMATION
) -> DataFrame:
    """One validation month per fold, boundaries spread evenly over the later months."""
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    position = F.row_number().over(Window.orderBy(date)) - 1
    months = months_of(rows, date).withColumn("__m", m).withColumn("__at", position)
    last = F.col("__m") - 1
    first = F.least(F.lit(min_train_months), last)
    count = F.least(F.lit(n_splits), last)
    step = F.when(count > 1, (last - first) / (count - 1)).otherwise(F.lit(0.0))
    spots = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.when(i == count - 1, F.when(count > 1, last).otherwise(first)).otherwise(
            F.floor(first + i * step)
        ).cast("int"),
    )
    return (
        months.where((F.col("__m") > min_train_months) & (F.col("__at") > 0))
        .where(F.array_contains(spots, F.col("__at")))
        .select(
            F.dense_rank().over(Window.orderBy(date)).cast("int").alias("fold"),
            F.col(date).alias("validation_month"),
            F.col("__at").cast("int").alias("train_months"),
        )
    )


def pooled_benchmark(rows: DataFrame, date: str = FORMATION, target: str = TARGET) -> DataFrame:
    """Per month the mean of all targets realised by then."""
    monthly = rows.where(F.col(target).isNotNull()).groupBy(date).agg(
        F.sum(target).alias("__s"), F.count(target).alias("__n")
    )
    seen = Window.orderBy("__mi").rangeBetween(Window.unboundedPreceding, -1)
    return monthly.withColumn("__mi", month_index(date)).select(
        date,
        F.try_divide(F.sum("__s").over(seen), F.sum("__n").over(seen)).alias(
            "benchmark_prediction"
        ),
    )


def stock_benchmark(rows: DataFrame, date: str = FORMATION, target: str = TARGET) -> DataFrame:
    """Each security's own mean of realised targets, else the pooled mean."""
    seen = Window.partitionBy("permno").orderBy("__mi").rangeBetween(
        Window.unboundedPreceding, -1
    )
    own = rows.withColumn("__mi", month_index(date)).withColumn(
        "__own", F.avg(target).over(seen)
    ).drop("__mi")
    # Staged, so that Catalyst knows how small a table of months is.
    pooled = stage(pooled_benchmark(rows, date, target), "benchmark").withColumnRenamed(
        "benchmark_prediction", "__pooled"
    )
    return own.join(pooled, date, "left").withColumn(
        "benchmark_prediction", F.coalesce("__own", "__pooled")
    ).drop("__own", "__pooled")
