"""Cross-sectional transforms that use only the row's own month."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import ratio
from monthloom.operators.ordering import grouped_quantiles, spread_group_stats
from monthloom.staging import stage


def standardize_by_month(df: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Add ``<col>_z``; a month without spread gives NULL."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}")]
    out = spread_group_stats(df, [date], *aggs)
    for c in cols:
        out = out.withColumn(f"{c}_z", ratio(F.col(c) - F.col(f"__m_{c}"), f"__s_{c}"))
    return out.drop(*[f"__{k}_{c}" for c in cols for k in ("m", "s")])


def winsorize_by_month(
    df: DataFrame,
    cols: Sequence[str],
    lower: float = 0.01,
    upper: float = 0.99,
    date: str = "date",
) -> DataFrame:
    """Clip each column to its exact monthly quantiles; NULL stays NULL."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("Winsorization quantiles must satisfy 0 <= lower < upper <= 1.")
    long = df.select(
        date, F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols
        ])).alias("__v")
    ).select(date, "__v.name", "__v.value")
    bounds = grouped_quantiles(
        long, [date, "name"], "value", {"lo": lower, "hi": upper}
    )
    wide = stage(
        bounds.groupBy(date).agg(*[
            F.max(F.when(F.col("name") == c, F.col(k))).alias(f"__{k}_{c}")
            for c in cols for k in ("lo", "hi")
        ]),
        "bounds",
    )
    out = df.join(wide, [date], "left")
    for c in cols:
        clipped = F.least(F.greatest(F.col(c), F.col(f"__lo_{c}")), F.col(f"__hi_{c}"))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), clipped))
    return out.drop(*[f"__{k}_{c}" for c in cols for k in ("lo", "hi")])
