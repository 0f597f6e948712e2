"""Queries on splits, tuning, model fits and out-of-sample predictions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import is_finite
from monthloom.operators import boosted_trees, elastic_net, oos, splits
from monthloom.plans.catalog import query
from monthloom.schema import FORMATION
from monthloom.sources.market_tables import MarketTables
from monthloom.staging import stage

_START, _MIN_MONTHS, _EVERY = "1999-01-31", 24, 6
_ELASTIC = {"alpha": 0.01, "l1_ratio": 0.5}
_TREES = boosted_trees.DEFAULTS
#: One split on all rows and features: what SQL can follow to the last leaf.
_STUMP = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "subsample": 1.0,
          "colsample_bytree": 1.0}


@query("oos_01_expanding_splits", "test_month:d train_months:i train_rows:i train_start:d "
       "train_end:d test_rows:i")
def _(m: MarketTables) -> DataFrame:
    return splits.expanding_splits(m.sample(), "1997-01-31", "1998-01-31", "2001-03-31")


@query("oos_02_forward_folds", "fold:i validation_month:d train_months:i")
def _(m: MarketTables) -> DataFrame:
    return splits.forward_folds(m.sample(), 5, 24)


@query("oos_03_time_cv", "alpha:6 l1_ratio:4 mean_cv_mse:9 n_folds:i selected:b")
def _(m: MarketTables) -> DataFrame:
    return elastic_net.tune(m.sample(), [0.001, 0.01, 0.1], [0.1, 0.9], 5, 24)


@query("oos_03_tree_cv", "grid_index:i params mean_cv_mse:9 n_folds:i selected:b")
def _(m: MarketTables) -> DataFrame:
    """Every set of one shape is a prefix of one fit per fold; all fits grow together."""
    grid = [{"n_estimators": n, "max_depth": d, "learning_rate": r}
            for n in (20, 40, 80) for d in (2, 3) for r in (0.03, 0.08)]
    return boosted_trees.tune(m.sample(), grid, 5, 24)


@query("oos_03_stump_cv", "grid_index:i mean_cv_mse:9 n_folds:i selected:b")
def _(m: MarketTables) -> DataFrame:
    grid = [{**_STUMP, "learning_rate": r} for r in (0.25, 1.0)]
    return boosted_trees.tune(m.sample(), grid, 5, 24)


def _calendar(m: MarketTables, every: int = _EVERY) -> DataFrame:
    return stage(
        oos.refit_calendar(m.sample(), _START, None, _MIN_MONTHS, every), "calendar"
    )


@query("oos_04_refit_calendar", "test_month:d train_months:i train_formation_end_date:d "
       "train_realized_return_end_date:d is_refit:b fit_month:d")
def _(m: MarketTables) -> DataFrame:
    return oos.refit_calendar(m.sample(), _START, None, _MIN_MONTHS, _EVERY)


@query("oos_04_expanding_long", "permno:i formation_date:d realized_return_date:d regime "
       "actual:8 benchmark_prediction:8 prediction:8 train_formation_end_date:d "
       "train_realized_return_end_date:d")
def _(m: MarketTables) -> DataFrame:
    return oos.expanding_long(
        m.sample(), _START, None, _MIN_MONTHS, _EVERY, _ELASTIC["alpha"], _ELASTIC["l1_ratio"]
    )


@query("oos_04_expanding_wide", "permno:i formation_date:d actual_next_month_return:8 "
       "benchmark_prediction:8 elastic_net_prediction:8 train_formation_end_date:d "
       "train_target_end_date:d tree_scored:b")
def _(m: MarketTables) -> DataFrame:
    out, _coefficients, _importances = oos.expanding_baseline(
        m.sample(), _START, None, _MIN_MONTHS, _EVERY, _ELASTIC, _TREES
    )
    return out.withColumn("tree_scored", is_finite(boosted_trees.PREDICTION))


@query("oos_04_expanding_wide_stump", "permno:i formation_date:d actual_next_month_return:8 "
       "benchmark_prediction:8 elastic_net_prediction:8 xgboost_prediction:8 "
       "train_formation_end_date:d train_target_end_date:d")
def _(m: MarketTables) -> DataFrame:
    return oos.expanding_baseline(
        m.sample(), _START, None, _MIN_MONTHS, _EVERY, _ELASTIC, _STUMP)[0]


@query("oos_04_expanding_long_stump", "permno:i formation_date:d realized_return_date:d regime "
       "model actual:8 benchmark_prediction:8 prediction:8 train_formation_end_date:d "
       "train_realized_return_end_date:d")
def _(m: MarketTables) -> DataFrame:
    return oos.expanding_long(
        m.sample(), _START, None, _MIN_MONTHS, _EVERY, _ELASTIC["alpha"], _ELASTIC["l1_ratio"],
        trees=_STUMP)


@query("oos_04_expanding_long_models", "permno:i formation_date:d model actual:8 "
       "benchmark_prediction:8 prediction:8 train_formation_end_date:d")
def _(m: MarketTables) -> DataFrame:
    return oos.expanding_long(
        m.sample(), _START, None, _MIN_MONTHS, _EVERY, _ELASTIC["alpha"], _ELASTIC["l1_ratio"],
        trees=_TREES)


@query("ml_01_elastic_net", "formation_date:d train_months:i intercept:8 raw0:8 raw1:8 raw2:8")
def _(m: MarketTables) -> DataFrame:
    return oos.elastic_net_fits(m.sample(), _calendar(m), **_ELASTIC)


@query("ml_02_boosted_trees", "permno:i formation_date:d xgboost_prediction:8")
def _(m: MarketTables) -> DataFrame:
    return boosted_trees.score_refits(m.sample(), _calendar(m), _TREES)[0]


@query("ml_02_stump", "permno:i formation_date:d xgboost_prediction:8")
def _(m: MarketTables) -> DataFrame:
    return boosted_trees.score_refits(m.sample(), _calendar(m), _STUMP)[0]


@query("ml_02_tree_facts", "formation_date:d n_rows:i n_scored:i")
def _(m: MarketTables) -> DataFrame:
    """What holds of tree predictions whatever the library: one per test row."""
    rows = m.sample().join(_calendar(m).select(F.col("test_month").alias(FORMATION)), FORMATION)
    scores = boosted_trees.score_refits(m.sample(), _calendar(m), _TREES)[0]
    return rows.join(scores, ["permno", FORMATION], "left").groupBy(FORMATION).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("xgboost_prediction").alias("n_scored"))


@query("ml_03_importance_facts", "refit_date:d n_predictors:i nonnegative:b sums_to_one:b")
def _(m: MarketTables) -> DataFrame:
    rows = boosted_trees.score_refits(m.sample(), _calendar(m), _TREES)[1]
    v = F.col("feature_importance")
    return rows.groupBy("refit_date").agg(
        F.count(F.lit(1)).alias("n_predictors"), F.min(v >= 0).alias("nonnegative"),
        (F.abs(F.sum(v) - 1) < 1e-9).alias("sums_to_one"))


@query("ml_03_stump_importances", "refit_date:d model predictor feature_importance:6")
def _(m: MarketTables) -> DataFrame:
    return boosted_trees.score_refits(m.sample(), _calendar(m), _STUMP)[1]


@query("ml_03_coefficients", "refit_date:d model predictor standardized_coefficient:8")
def _(m: MarketTables) -> DataFrame:
    return elastic_net.coefficient_rows(
        oos.elastic_net_fits(m.sample(), _calendar(m), **_ELASTIC)
    )


@query("ml_03_importances", "refit_date:d model predictor feature_importance:6")
def _(m: MarketTables) -> DataFrame:
    return boosted_trees.score_refits(m.sample(), _calendar(m), _TREES)[1]
