"""Monthly cross-sectional correlation between predictions and realised returns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import finite_double, safe_corr
from monthloom.operators.ordering import value_ranks
from monthloom.operators.reshape import models_to_rows
from monthloom.schema import FORMATION, REALIZED
from monthloom.staging import stage


def ranked_pairs(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Average ranks of two variables over the rows where both are finite.

    One table of ranks per (group, variable, value) serves both; rows are not put in order.
    """
    both = stage(rows.select(
        *group, finite_double(x).alias("__x"), finite_double(y).alias("__y")
    ).where(F.col("__x").isNotNull() & F.col("__y").isNotNull()), "pairs")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v"))
                      for s in ("__x", "__y")])
    long = both.select(*group, F.explode(sides).alias("__s")).select(
        *group, F.col("__s.side").alias("__side"), F.col("__s.v").alias("__v"))
    ranks = value_ranks(long, [*group, "__side"], "__v", "__r", "__size")
    out = both
    for side, rank in (("__x", "__rx"), ("__y", "__ry")):
        mine = ranks.where(F.col("__side") == side).select(
            *group, F.col("__v").alias(side), F.col("__r").alias(rank))
        out = out.join(mine, [*group, side])
    return out


def cross_section_ic(
    rows: DataFrame, group: Sequence[str] = (FORMATION, "model"), x: str = "prediction",
    y: str = "actual_next_month_return",
) -> DataFrame:
    """Spearman and Pearson correlation per group; NULL when a side is constant."""
    return ranked_pairs(rows, group, x, y).groupBy(*group).agg(
        safe_corr("__rx", "__ry").alias("spearman"),
        safe_corr("__x", "__y").alias("pearson"),
        F.count(F.lit(1)).alias("n_valid"),
    )


def _group_facts(rows: DataFrame, facts: Sequence[str]) -> DataFrame:
    return rows.groupBy(FORMATION, "model").agg(
        F.count(F.lit(1)).alias("n_group"), *[F.min(c).alias(c) for c in facts]
    )


def monthly_rank_ic(predictions: DataFrame) -> DataFrame:
    """Spearman IC of both models, with the regimes of the month."""
    long = models_to_rows(predictions)
    ic = cross_section_ic(long)
    return (
        _group_facts(long, ["regime_binary", "regime_3state"])
        .join(ic, [FORMATION, "model"], "left")
        .select(FORMATION, "model", "regime_binary", "regime_3state",
                F.col("spearman").alias("spearman_ic"),
                F.coalesce("n_valid", F.lit(0)).cast("bigint").alias("n_stocks"))
    )


def monthly_rank_metrics(predictions: DataFrame) -> DataFrame:
    """Spearman IC of long-form predictions, with the realised date and regime."""
    ic = cross_section_ic(predictions)
    return (
        _group_facts(predictions, [REALIZED, "regime"])
        .join(ic, [FORMATION, "model"], "left")
        .select(FORMATION, REALIZED, "model", "regime",
                F.coalesce("n_valid", F.lit(0)).cast("bigint").alias("n_stocks"), "spearman")
    )


def monthly_rank_metrics_strict(predictions: DataFrame) -> DataFrame:
    """As above plus distinct predictions and their range."""
    p = finite_double("prediction")
    paired = predictions.where(p.isNotNull() & finite_double("actual_next_month_return").isNotNull())
    spread = paired.groupBy(FORMATION, "model").agg(
        F.countDistinct(p).alias("n_unique_predictions"),
        (F.max(p) - F.min(p)).alias("prediction_range"),
    )
    return monthly_rank_metrics(predictions).join(spread, [FORMATION, "model"], "left")


def monthly_rank_correlations(predictions: DataFrame) -> DataFrame:
    """Spearman and Pearson IC; ``n`` is the size of the whole group."""
    long = models_to_rows(predictions)
    ic = cross_section_ic(long)
    return (
        _group_facts(long, ["regime"])
        .join(ic, [FORMATION, "model"], "left")
        .select(F.col(FORMATION).alias("date"), F.upper("regime").alias("regime"), "model",
                F.col("spearman").alias("spearman_ic"), F.col("pearson").alias("pearson_ic"),
                F.col("n_group").alias("n"))
    )
