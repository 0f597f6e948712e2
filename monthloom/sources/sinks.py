"""Sinks: Parquet, CSV and JSON tables, read-through tables and resumable months."""
from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom.operators.contracts import ContractViolation
from monthloom.schema import FORMATION
from monthloom.staging import stage


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    if partition_by:
        # Few, evenly sized files per folder: AQE splits large folders and merges small ones.
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Text table; doubles print in their shortest form that reads back unchanged."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_through(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """Return the stored table, building and storing it first if it is absent or stale."""
    if refresh or not _exists(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def pending_months(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """Months of ``rows`` that the stored table does not hold yet."""
    months = rows.select(FORMATION).distinct()
    if done is None:
        return months
    return months.join(done.select(FORMATION).distinct(), FORMATION, "left_anti")


def month_prints(inputs: DataFrame) -> DataFrame:
    """Per month the hash of all input rows up to it, whatever their order; months are few."""
    monthly = inputs.groupBy(FORMATION).agg(
        F.sum(F.xxhash64(*sorted(inputs.columns)).cast("decimal(38,0)")).alias("__hash"),
        F.count(F.lit(1)).alias("__rows"),
    )
    so_far = Window.orderBy(FORMATION).rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        FORMATION,
        F.concat_ws(":", F.sum("__rows").over(so_far).cast("string"),
                    F.sum("__hash").over(so_far).cast("string")).alias("inputs"),
    )


def append_parts(df: DataFrame, path: str, by: str) -> str:
    """Replace the partitions that ``df`` holds and leave the others."""
    df.hint("rebalance", by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def resume_months(
    spark: SparkSession,
    path: str,
    inputs: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    settings: Mapping[str, Any] | None = None,
    run_key: str | None = None,
) -> DataFrame:
    """Compute and append only the months that are not stored.

    A manifest beside the table holds, per stored month, the settings, the run key and the hash of
    all inputs up to that month. Another design, or inputs that differ in a stored month's past,
    is refused; further months of input are an increment. ``compute`` receives the pending months.
    """
    design = json.dumps([run_key, dict(settings or {})], sort_keys=True, default=str)
    manifest = f"{path.rstrip('/')}_manifest"
    prints = stage(month_prints(inputs), "month_prints")
    done = None
    if _exists(spark, manifest):
        done = spark.read.parquet(manifest)
        if done.where(F.col("design") != design).limit(1).collect():
            raise ContractViolation("Stored months belong to another run; use a new folder")
        changed = done.join(prints, FORMATION, "left").where(
            ~F.col("stored_inputs").eqNullSafe(F.col("inputs")))
        if changed.limit(1).collect():
            raise ContractViolation("Inputs of stored months have changed; use a new folder")
    todo = stage(pending_months(inputs, done), "pending")
    fresh = compute(todo).withColumn("formation_month", F.date_format(FORMATION, "yyyy-MM"))
    append_parts(fresh, path, "formation_month")
    # The manifest follows the data: a run that fails in between repeats its months.
    stored = spark.read.parquet(path).select(FORMATION).distinct().join(todo, FORMATION)
    stored.join(prints, FORMATION).select(
        FORMATION, F.lit(design).alias("design"), F.col("inputs").alias("stored_inputs")
    ).write.mode("append").parquet(manifest)
    return spark.read.parquet(path)
