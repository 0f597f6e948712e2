"""Expanding-window out-of-sample predictions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import all_of, finite_double, month_end, month_end_shift
from monthloom.operators import boosted_trees
from monthloom.operators.contracts import (
    duplicate_keys, enforce, enforce_rows, incomplete_model_inputs, leakage_rules,
    require_columns,
)
from monthloom.operators.elastic_net import (
    coefficient_rows, expanding_moments, fit_windows, linear_score, monthly_moments,
)
from monthloom.operators.splits import months_of, pooled_benchmark, stock_benchmark
from monthloom.schema import FEATURES, FORMATION, REALIZED, TARGET
from monthloom.staging import stage


def refit_calendar(
    rows: DataFrame, start: str, end: str | None = None, min_train_months: int = 12,
    every: int = 1,
) -> DataFrame:
    """Test months with the month whose fit they use.

    A fit happens at every ``every``-th test month, counted over all of them, and at the
    first one with enough history.
    """
    if every < 1:
        raise ValueError("Refits must be at least one month apart.")
    w = Window.orderBy(FORMATION)
    months = months_of(rows).select(
        FORMATION,
        (F.row_number().over(w) - 1).alias("train_months"),
        F.lag(FORMATION).over(w).alias("train_formation_end_date"),
    )
    last = F.lit(end).cast("date") if end is not None else F.lit("9999-12-31").cast("date")
    tests = months.where(
        (F.col(FORMATION) >= F.last_day(F.lit(start).cast("date")))
        & (F.col(FORMATION) <= F.last_day(last))
    ).withColumn("test_index", F.row_number().over(w) - 1)
    usable = tests.where(F.col("train_months") >= min_train_months).withColumn(
        "is_refit", (F.col("test_index") % every == 0) | (F.row_number().over(w) == 1)
    )
    return usable.select(
        F.col(FORMATION).alias("test_month"),
        "train_months",
        "train_formation_end_date",
        month_end_shift("train_formation_end_date", 1).alias("train_realized_return_end_date"),
        "is_refit",
        F.last(F.when(F.col("is_refit"), F.col(FORMATION)), ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fit_month"),
    )


def elastic_net_fits(
    rows: DataFrame, calendar: DataFrame, alpha: float, l1_ratio: float,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Coefficients at each refit month, from one pass over the rows."""
    windows = expanding_moments(monthly_moments(rows, features), features)
    refits = calendar.select(F.col("fit_month").alias(FORMATION)).distinct()
    return stage(
        fit_windows(windows.join(refits, FORMATION), alpha, l1_ratio, features), "fits"
    )


def elastic_net_predictions(
    rows: DataFrame, calendar: DataFrame, fits: DataFrame, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Scored test rows; month-level coefficients join by size-checked broadcast."""
    by_month = stage(
        calendar.select("test_month", "fit_month", "train_months").join(
            fits.drop("train_months", "n").withColumnsRenamed(
                {FORMATION: "fit_month", "train_formation_end_date": "fit_formation_end_date"}
            ),
            "fit_month",
        ).withColumnRenamed("test_month", FORMATION),
        "coefficients",
    )
    return rows.join(by_month, FORMATION).withColumn(
        "elastic_net_prediction", linear_score(features)
    )


_CARRY = ("date", FORMATION, REALIZED, "permno", "ticker", "regime", "vix", *FEATURES, "me_lag",
          "me_lag_date", "market_equity")


def expanding_baseline(
    sample: DataFrame, start: str, end: str | None = None, min_train_months: int = 12,
    every: int = 1, elastic: Mapping[str, float] | None = None,
    trees: Mapping[str, Any] | None = None, seed: int = 42, months: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wide predictions of both models with the pooled benchmark and current train ends.

    Also returns the elastic-net coefficients and the tree importances per refit. With
    ``months`` only those test months, and the fits that they use, are computed.
    """
    enforce(incomplete_model_inputs(sample), "Models need complete rows")
    elastic = elastic or {"alpha": 0.001, "l1_ratio": 0.5}
    plan = refit_calendar(sample, start, end, min_train_months, every)
    if months is not None:
        plan = plan.join(
            months.select(F.col(FORMATION).alias("test_month")), "test_month", "left_semi"
        )
    calendar = stage(plan, "calendar")
    fits = elastic_net_fits(sample, calendar, elastic["alpha"], elastic["l1_ratio"])
    scored = elastic_net_predictions(sample, calendar, fits)
    tree_scores, importances = boosted_trees.score_refits(sample, calendar, trees, seed=seed)
    ends = calendar.select(
        F.col("test_month").alias(FORMATION), "train_formation_end_date",
        "train_realized_return_end_date",
        F.col("train_formation_end_date").alias("train_feature_end_date"),
        F.col("train_realized_return_end_date").alias("train_target_end_date"),
    )
    out = (
        scored.select(
            *[c for c in _CARRY if c in sample.columns],
            F.col(TARGET).alias("actual_next_month_return"), "elastic_net_prediction",
        )
        .join(stage(pooled_benchmark(sample), "benchmark"), FORMATION)
        .join(tree_scores, ["permno", FORMATION])
        .join(ends, FORMATION)
    )
    return out, coefficient_rows(fits), importances


def check_predictions(predictions: DataFrame) -> None:
    """Raise on duplicates, leakage or unusable numbers."""
    enforce_rows(
        predictions, leakage_rules(["elastic_net_prediction", "xgboost_prediction"])
    )
    enforce(duplicate_keys(predictions, ["permno", FORMATION]), "Duplicate predictions")


def expanding_long(
    panel: DataFrame, start: str, end: str | None = None, min_train_months: int = 12,
    every: int = 1, alpha: float = 0.001, l1_ratio: float = 0.5,
    features: Sequence[str] = FEATURES, trees: Mapping[str, Any] | None = None, seed: int = 42,
) -> DataFrame:
    """Long predictions with the security's own historical mean and the fitted train ends.

    With ``trees`` (settings that differ from the defaults, or none) every test row has a second
    row of model ``xgboost``, fitted at the same months on the same rows.
    """
    require_columns(panel, ["permno", TARGET, "regime", "vix", *features])
    rows = panel
    if FORMATION not in rows.columns:
        rows = rows.withColumn(FORMATION, month_end("date"))
    if "date" not in rows.columns:
        rows = rows.withColumn("date", F.col(FORMATION))
    if REALIZED not in rows.columns:
        rows = rows.withColumn(REALIZED, month_end_shift(FORMATION, 1))
    usable = rows.where(
        all_of(finite_double(f).isNotNull() for f in features) & F.col(TARGET).isNotNull()
    )
    calendar = stage(refit_calendar(usable, start, end, min_train_months, every), "calendar")
    fits = elastic_net_fits(usable, calendar, alpha, l1_ratio, features)
    scored = elastic_net_predictions(stock_benchmark(usable), calendar, fits, features)
    carry = [c for c in ("date", FORMATION, REALIZED, "permno", "ticker", "regime", "vix",
                         "me_lag", "me_lag_date", "market_equity") if c in usable.columns]
    fitted_end = F.col("fit_formation_end_date")
    fitted_target = month_end_shift("fit_formation_end_date", 1)

    def block(table: DataFrame, prediction: str, model: str) -> DataFrame:
        return table.select(
            *carry, F.col(TARGET).alias("actual"),
            F.col(TARGET).alias("actual_next_month_return"), "benchmark_prediction",
            F.col(prediction).alias("prediction"), F.lit(model).alias("model"),
            fitted_end.alias("train_formation_end_date"),
            fitted_target.alias("train_realized_return_end_date"),
            fitted_end.alias("train_feature_end_date"),
            fitted_target.alias("train_target_end_date"),
            fitted_end.alias("train_end"),
        )

    out = block(scored, "elastic_net_prediction", "elastic_net")
    if trees is not None:
        scored = stage(scored, "scored")
        tree_scores, _ = boosted_trees.score_refits(usable, calendar, trees, features, seed)
        out = block(scored, "elastic_net_prediction", "elastic_net").unionByName(
            block(scored.join(tree_scores, ["permno", FORMATION]), boosted_trees.PREDICTION,
                  "xgboost"))
    if "me_lag_date" in out.columns:
        out = out.withColumn("value_weight_date", F.col("me_lag_date"))
    return out
