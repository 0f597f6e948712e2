"""Prediction sorts and decile portfolio returns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import all_of, finite_double, is_finite, ratio, safe_double
from monthloom.operators.contracts import enforce, require_columns, stage_checked
from monthloom.operators.ordering import ordered_index, value_ranks
from monthloom.operators.reshape import models_to_rows
from monthloom.schema import FORMATION, N_PORTFOLIOS, REALIZED, WEIGHTINGS
from monthloom.staging import stage

# Smallest usable cross-section and range tolerances.
MIN_CROSS_SECTION = 10
RANGE_ATOL = 1e-12
RANGE_RTOL = 1e-10


def ordinal_bucket(rank: Column, size: Column, k: int = N_PORTFOLIOS) -> Column:
    """Bucket of a 1-based rank among ``size`` rows; not the same as ``ntile``."""
    return (F.floor((rank - 1) * k / size) + 1).cast("int")


def assign_deciles(
    df: DataFrame, prediction: str = "prediction", group: Sequence[str] = (FORMATION, "model"),
    key: str = "permno", k: int = N_PORTFOLIOS,
) -> DataFrame:
    """Equal-count sorts by (prediction, key); groups with fewer than k rows stay unassigned.

    Only group, value and key are put in order. The first row of each bucket bounds it; a group's
    ``k - 1`` bounds join the rows, which are neither shuffled by value nor written.
    """
    if k < 2:
        raise ValueError("At least two portfolios are needed.")
    value = safe_double(prediction)
    usable = value.isNotNull() & F.col(key).isNotNull()
    place = F.struct("__value", "__key")
    placed = ordered_index(
        df.where(usable).select(*group, value.alias("__value"), F.col(key).alias("__key")),
        group, ["__value", "__key"], "__rank", "__size",
    )
    rank, size = F.col("__rank"), F.col("__size")
    opens = ordinal_bucket(rank, size, k) > ordinal_bucket(rank - 1, size, k)
    bounds = stage(
        placed.groupBy(*group).agg(
            F.max(size).alias("__size"),
            F.collect_list(F.when(opens & (rank > 1) & (size >= k), place)).alias("__opens")),
        "decile-bounds",
    )
    enough = F.coalesce(F.col("__size") >= k, F.lit(False))
    own = F.struct(value.alias("__value"), F.col(key).alias("__key"))
    passed = F.size(F.filter("__opens", lambda b: b <= own))
    return (
        df.join(bounds, list(group), "left")
        .withColumn("decile", F.when(enough & usable, passed + 1).cast("int"))
        .withColumn(
            "decile_status", F.when(enough, "assigned").otherwise("insufficient_securities")
        )
        .drop("__size", "__opens")
    )


def assign_tie_preserving(
    df: DataFrame, prediction: str = "prediction", group: Sequence[str] = (FORMATION, "model"),
    key: str = "permno", k: int = N_PORTFOLIOS, out: str = "portfolio",
) -> DataFrame:
    """Sorts by average percentile rank: equal predictions share a bucket, some may be empty.

    The largest value of each bucket bounds it; a group's bounds, ``k`` at most, join the rows, which
    are neither shuffled by value nor written.
    """
    if k < 2:
        raise ValueError("At least two portfolios are needed.")
    value = finite_double(prediction)
    usable = df.where(value.isNotNull())
    ranks = value_ranks(usable.select(*group, value.alias("__value")), group, "__value", "__rank",
                        "__size")
    bucket = F.ceil(F.lit(float(k)) * (F.col("__rank") / F.col("__size")))
    bounds = stage(
        ranks.withColumn("__bucket", F.least(F.greatest(bucket, F.lit(1)), F.lit(k)).cast("int"))
        .groupBy(*group, "__bucket").agg(F.max("__value").alias("__top"))
        .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("__top", "__bucket")))
                             .alias("__bounds")),
        "bucket-bounds",
    )
    # The first bound that is not below the value is that of its bucket.
    own = F.filter("__bounds", lambda b: b["__top"] >= value)
    return usable.join(bounds, list(group)).withColumn(
        out, F.get(own, F.lit(0))["__bucket"]).drop("__bounds")


def skipped_months(assignments: DataFrame) -> DataFrame:
    """(month, model) groups without any assigned row."""
    return (
        assignments.groupBy(FORMATION, "model")
        .agg(F.count("decile").alias("__n"), F.count("prediction").alias("n_stocks"))
        .where("__n = 0")
        .select(FORMATION, "model", F.lit("fewer_than_10_valid_predictions").alias("reason"),
                "n_stocks")
    )


_LINEAGE = ("value_weight_date", "train_feature_end_date", "train_target_end_date")


def _scored_rows(predictions: DataFrame, weight: str) -> DataFrame:
    require_columns(
        predictions,
        [FORMATION, REALIZED, "permno", "model", "prediction", "actual_next_month_return",
         "regime", weight],
    )
    out = predictions.where(
        F.col("prediction").isNotNull() & F.col("actual_next_month_return").isNotNull()
    ).withColumn("weighting_variable", safe_double(weight))
    if "ticker" not in out.columns:
        out = out.withColumn("ticker", F.lit(None).cast("string"))
    return out


_ASSIGNMENT = (
    FORMATION, REALIZED, "permno", "ticker", "model", "prediction", "decile", "decile_status",
    "regime", "actual_next_month_return", "weighting_variable",
)


def portfolio_assignments(predictions: DataFrame, weight: str = "me_lag") -> DataFrame:
    """Lenient assignment of long-form predictions."""
    out = assign_deciles(_scored_rows(predictions, weight))
    return out.select(*_ASSIGNMENT, *[c for c in _LINEAGE if c in out.columns])


def prediction_diagnostics_by_group(predictions: DataFrame) -> DataFrame:
    """Whether each (month, model) cross-section carries ranking information."""
    require_columns(predictions, [FORMATION, "model", "prediction"])
    p = finite_double("prediction")
    stocks = F.countDistinct("permno") if "permno" in predictions.columns else F.count(F.lit(1))
    stats = predictions.groupBy(FORMATION, "model").agg(
        stocks.alias("n_stocks"),
        F.count(p).alias("n_valid_predictions"),
        F.countDistinct(p).alias("n_unique_predictions"),
        F.min(p).alias("__lo"),
        F.max(p).alias("__hi"),
    )
    scale = F.greatest(F.lit(1.0), F.abs("__lo"), F.abs("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    tolerance = F.when(
        F.col("__lo").isNotNull(), F.lit(RANGE_ATOL) + F.lit(RANGE_RTOL) * scale
    )
    status = (
        F.when(F.col("n_valid_predictions") < MIN_CROSS_SECTION, "fewer_than_10_valid_predictions")
        .when(F.col("n_unique_predictions") < MIN_CROSS_SECTION,
              "fewer_than_10_distinct_predictions")
        .when(spread <= tolerance, "near_constant_predictions")
        .otherwise("sortable")
    )
    return stats.select(
        FORMATION, "model", "n_stocks", "n_valid_predictions", "n_unique_predictions",
        spread.alias("prediction_range"), tolerance.alias("range_tolerance"),
        status.alias("prediction_status"),
    )


def strict_assignments(
    predictions: DataFrame, weight: str = "me_lag"
) -> tuple[DataFrame, DataFrame]:
    """Deciles for sortable groups only, and the report of skipped groups."""
    rows = _scored_rows(predictions, weight)
    stats = stage(prediction_diagnostics_by_group(rows), "diagnostics")
    tagged = rows.join(
        stats.select(FORMATION, "model", "n_unique_predictions", "prediction_range",
                     "prediction_status"),
        [FORMATION, "model"],
    )
    sortable = F.col("prediction_status") == "sortable"
    assigned = assign_deciles(tagged.where(sortable))
    rest = tagged.where(~sortable).withColumn("decile", F.lit(None).cast("int")).withColumn(
        "decile_status", F.col("prediction_status")
    )
    columns = [*_ASSIGNMENT, "n_unique_predictions", "prediction_range",
               *[c for c in _LINEAGE if c in rows.columns]]
    skipped = stats.where(~sortable).select(
        FORMATION, "model", F.col("prediction_status").alias("reason"), "n_stocks",
        "n_valid_predictions", "n_unique_predictions", "prediction_range",
    )
    return assigned.select(*columns).unionByName(rest.select(*columns)), skipped


def assign_from_wide(predictions: DataFrame, strict: bool = False) -> DataFrame:
    """Deciles of both models from wide predictions with regime columns.

    ``strict`` raises on a month with too few securities; otherwise such months drop out.
    """
    long = models_to_rows(predictions).where(
        is_finite("prediction") & is_finite("actual_next_month_return")
    )
    out = assign_deciles(long)
    if strict:
        enforce(out.where(F.col("decile").isNull()).select(FORMATION, "model"),
                "Too few securities to form portfolios")
    ticker = F.col("ticker") if "ticker" in out.columns else F.lit(None).cast("string")
    return out.where(F.col("decile").isNotNull()).select(
        FORMATION, REALIZED, "permno", ticker.alias("ticker"), "model", "prediction", "decile",
        finite_double("actual_next_month_return").alias("realized_next_month_return"),
        safe_double("me_lag").alias("weighting_variable"),
        "vix", "vix_expanding_median", "vix_expanding_q33", "vix_expanding_q67",
        "regime_binary", "regime_3state",
    )


def _amount(weighting: Column, me: Column) -> Column:
    """Unnormalised portfolio weight; value weights need a positive finite size."""
    return F.when(weighting == "EW", F.lit(1.0)).otherwise(F.when(me > 0, me))


def with_weightings(rows: DataFrame, ret: str, me: str) -> DataFrame:
    """Each eligible row once per weighting, with its unnormalised weight ``amount``."""
    return (
        rows.withColumn("__ret", finite_double(ret))
        .withColumn("__me", finite_double(me))
        .where(F.col("__ret").isNotNull())
        .withColumn("weighting", F.explode(F.array(*[F.lit(w) for w in WEIGHTINGS])))
        .withColumn("amount", _amount(F.col("weighting"), F.col("__me")))
        .where(F.col("amount").isNotNull())
        .withColumn(ret, F.col("__ret"))
        .drop("__ret", "__me")
    )


def decile_returns_long(
    assignments: DataFrame, ret: str = "realized_next_month_return",
    me: str = "weighting_variable",
    keys: Sequence[str] = (FORMATION, REALIZED, "model", "regime_binary", "regime_3state"),
) -> DataFrame:
    """Equal- and value-weighted decile returns by month, in a single aggregate."""
    r, m = finite_double(ret), finite_double(me)
    w = F.when(r.isNotNull() & (m > 0), m)
    stats = assignments.where(F.col("decile").isNotNull()).groupBy(*keys, "decile").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(r).alias("ew"), F.count(r).alias("n_ew"),
        F.sum(w * r).alias("wr"), F.sum(w).alias("w"), F.count(w).alias("n_vw"),
    )
    both = F.array(
        F.struct(F.lit("EW").alias("weighting"), F.col("ew").alias("decile_return"),
                 F.col("n_ew").alias("n_weight")),
        F.struct(F.lit("VW").alias("weighting"), ratio("wr", "w").alias("decile_return"),
                 F.col("n_vw").alias("n_weight")),
    )
    return stats.select(*keys, "decile", "n_rows", F.explode(both).alias("__w")).select(
        *keys, "decile", "n_rows", "__w.weighting", "__w.decile_return", "__w.n_weight"
    )


def _spread(value: str, cols: Sequence[int], name: str, number: str) -> list[Column]:
    return [F.max(F.when(F.col("decile") == d, F.col(value))).alias(name.format(d))
            for d in cols]


def decile_returns_wide(
    long: DataFrame,
    keys: Sequence[str] = (FORMATION, REALIZED, "model", "regime_binary", "regime_3state",
                           "weighting"),
    strict: bool = False,
) -> DataFrame:
    """Columns D1..D10, counts and the D10-D1 spread; one row per month and series."""
    deciles = range(1, N_PORTFOLIOS + 1)
    out = long.groupBy(*keys).agg(
        *_spread("decile_return", deciles, "D{}", "decile"),
        *_spread("n_weight", deciles, "n_D{}", "decile"),
        F.sum("n_weight").alias("n_stocks"),
    ).withColumn("D10_minus_D1", F.col("D10") - F.col("D1"))
    if strict:
        out = stage_checked(out, "decile-returns", {
            "A decile has no return": all_of(F.col(f"D{d}").isNotNull() for d in deciles)
        })
    return out


def decile_returns_lenient(assignments: DataFrame) -> DataFrame:
    """Variant with member and weight counts per decile and one regime column."""
    keys = [FORMATION, REALIZED, "model", "regime"]
    long = decile_returns_long(assignments, "actual_next_month_return", keys=keys)
    deciles = range(1, N_PORTFOLIOS + 1)
    return long.groupBy(*keys, "weighting").agg(
        F.sum("n_rows").alias("n_stocks"),
        *_spread("n_rows", deciles, "D{}_n", "decile"),
        *_spread("decile_return", deciles, "D{}", "decile"),
        *_spread("n_weight", deciles, "D{}_n_weight", "decile"),
    ).withColumn("D10_minus_D1", F.col("D10") - F.col("D1"))


def long_short(wide: DataFrame) -> DataFrame:
    """Spread series of the wide decile table."""
    kept = [c for c in (FORMATION, REALIZED, "model", "regime", "regime_binary", "regime_3state",
                        "weighting") if c in wide.columns]
    counts = [c for c in ("D10_n_weight", "D1_n_weight") if c in wide.columns]
    return wide.select(
        *kept, F.col("D10").alias("D10_return"), F.col("D1").alias("D1_return"),
        "D10_minus_D1", "n_stocks", *counts,
    )
