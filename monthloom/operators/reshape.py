"""Wide and long forms of predictions and portfolios."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.schema import MODEL_COLUMNS


def models_to_rows(
    wide: DataFrame, models: Mapping[str, str] = MODEL_COLUMNS, value: str = "prediction"
) -> DataFrame:
    """One row per model from one prediction column per model."""
    ids = [c for c in wide.columns if c not in models.values()]
    named = wide.select(*ids, *[F.col(c).alias(m) for m, c in models.items()])
    return named.unpivot(ids, list(models), "model", value)


def models_to_columns(
    long: DataFrame, keys: Sequence[str], models: Sequence[str],
    facts: Sequence[str] = (), value: str = "prediction",
) -> DataFrame:
    """One prediction column per model; ``facts`` are values shared by a key's rows."""
    return long.groupBy(*keys).agg(
        *[F.min(f).alias(f) for f in facts],
        *[F.max(F.when(F.col("model") == m, F.col(value))).alias(f"{m}_prediction")
          for m in models],
    )


def union_with_panel(tables: Mapping[str, DataFrame], label: str = "panel") -> DataFrame:
    """Stack tables with differing columns, naming the part each row comes from."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def prediction_export(long: DataFrame) -> DataFrame:
    """Fixed column set of the prediction table; absent columns become NULL."""
    columns = (
        "formation_date", "realized_return_date", "permno", "ticker", "model", "prediction",
        "actual_next_month_return", "regime", "me_lag", "value_weight_date",
        "train_feature_end_date", "train_target_end_date",
    )
    return long.select(
        *[F.col(c) if c in long.columns else F.lit(None).alias(c) for c in columns]
    )


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values on one side only, with the side that has them."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return (
        a.join(b, column, "left_anti").withColumn("found_in", F.lit("left_only"))
        .unionByName(b.join(a, column, "left_anti").withColumn("found_in", F.lit("right_only")))
    )
