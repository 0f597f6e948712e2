"""Boosted regression trees over expanding windows: refits, importances and tuning.

All refits, and all folds and parameter sets of a tuning run, grow together (``joint_boosting``).
"""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.operators.contracts import enforce, incomplete_model_inputs
from monthloom.operators.joint_boosting import DEFAULTS, FitSpec, Forests
from monthloom.operators.splits import forward_folds
from monthloom.schema import FEATURES, FORMATION
from monthloom.staging import stage

__all__ = ["DEFAULTS", "PRODUCTION_GRID", "score_refits", "tune"]

# The parameter grid that is searched in production.
PRODUCTION_GRID = tuple(
    {"n_estimators": n, "max_depth": d, "learning_rate": r, "subsample": s, "colsample_bytree": c}
    for n in (200, 500) for d in (2, 3, 4) for r in (0.01, 0.05, 0.1) for s in (0.7, 1.0)
    for c in (0.7, 1.0))
PREDICTION = "xgboost_prediction"


def refit_forests(
    sample: DataFrame, calendar: DataFrame, params: Mapping[str, Any] | None = None,
    features: Sequence[str] = FEATURES, seed: int = 42,
) -> Forests | None:
    """One forest per refit month, holding that refit's test months."""
    enforce(incomplete_model_inputs(sample), "Models need complete rows")
    plan: dict = {}
    for test, month in calendar.select("test_month", "fit_month").collect():
        plan.setdefault(month, []).append(test)
    if not plan:
        return None
    specs = [FitSpec(month, tuple(sorted(plan[month])), params or {}) for month in sorted(plan)]
    forests = Forests(sample, specs, features, seed)
    forests.months = [s.month for s in specs]
    return forests


def score_refits(
    sample: DataFrame, calendar: DataFrame, params: Mapping[str, Any] | None = None,
    features: Sequence[str] = FEATURES, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of each refit's test months, and the feature importances."""
    spark = sample.sparkSession
    forests = refit_forests(sample, calendar, params, features, seed)
    rows = [] if forests is None else [
        (month, "xgboost", f, v) for month, shares in zip(forests.months, forests.importances())
        for f, v in zip(features, shares, strict=True)]
    table = spark.createDataFrame(
        rows, "refit_date DATE, model STRING, predictor STRING, feature_importance DOUBLE")
    if forests is None:
        return spark.createDataFrame(
            [], f"permno BIGINT, {FORMATION} DATE, {PREDICTION} DOUBLE"), table
    return stage(forests.predictions(PREDICTION).drop("fit"), "tree-scores"), table


def tune(
    rows: DataFrame, grid: Sequence[Mapping[str, Any]] = PRODUCTION_GRID, n_splits: int = 5,
    min_train_months: int = 12, features: Sequence[str] = FEATURES, seed: int = 42,
) -> DataFrame:
    """Mean validation error per parameter set over forward-chaining folds, least first.

    Sets that differ in the number of trees alone share one fit per fold: the error with fewer
    trees is that of a prefix. Equal errors are ordered by the set's place in the grid.
    """
    enforce(incomplete_model_inputs(rows), "Tuning needs complete rows")
    folds = [r[0] for r in forward_folds(rows, n_splits, min_train_months)
             .select("validation_month").orderBy("validation_month").collect()]
    if not folds or not grid:
        raise ValueError("Not enough months for forward-chaining selection.")
    full = [{**DEFAULTS, **p} for p in grid]

    def shape(p: Mapping[str, Any]) -> tuple:
        return tuple(sorted((k, float(v)) for k, v in p.items() if k != "n_estimators"))

    largest: dict[tuple, dict] = {}
    for p in full:
        held = largest.setdefault(shape(p), p)
        if p["n_estimators"] > held["n_estimators"]:
            largest[shape(p)] = p
    specs = [FitSpec(month, (month,), p) for p in largest.values() for month in folds]
    forests = Forests(rows, specs, features, seed)
    errors = {(shape(s.params), s.month): forests.errors[i]
              for i, s in enumerate(specs) if forests.fits[i].rows}
    cells = []
    for i, p in enumerate(full):
        found = [errors[shape(p), m][int(p["n_estimators"])] for m in folds
                 if (shape(p), m) in errors]
        if found:
            cells.append((i, "xgboost", json.dumps(dict(grid[i]), sort_keys=True),
                          float(sum(found) / len(found)), len(found)))
    if not cells:
        raise ValueError("No fold has observable training rows.")
    table = rows.sparkSession.createDataFrame(
        cells, "grid_index INT, model STRING, params STRING, mean_cv_mse DOUBLE, n_folds BIGINT")
    best = Window.partitionBy(F.lit(1)).orderBy("mean_cv_mse", "grid_index")
    return table.withColumn("selected", F.row_number().over(best) == 1)
