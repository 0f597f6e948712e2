"""Tuning, expanding-window estimation and prediction reports."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import boosted_trees, elastic_net, oos, rank_ic, reports, summaries
from monthloom.operators.contracts import ContractViolation
from monthloom.operators.panel import complete_case_sample, observable_as_of
from monthloom.operators.universe import monthly_hash_sample
from monthloom.sources.sinks import append_parts, resume_months, write_csv
from monthloom.staging import frees_staged, stage

# Elastic-net grid of the production design.
ALPHAS = (0.0001, 0.001, 0.01, 0.1)
L1_RATIOS = (0.1, 0.5, 0.9)


def tune_models(
    sample: DataFrame, start: str, n_folds: int = 5, min_train_months: int = 60,
    tree_rows_per_month: int | None = None, seed: int = 42, alphas: Sequence[float] = ALPHAS,
    l1_ratios: Sequence[float] = L1_RATIOS,
    tree_grid: Sequence[Mapping[str, Any]] = (),
) -> tuple[dict[str, float], dict[str, Any] | None, dict[str, DataFrame]]:
    """Select parameters on the history that is observable before the first test month.

    The elastic net is tuned on all of it. ``tree_rows_per_month`` may bound the rows per month
    that the tree grid is tuned on, by hash of the security; by default it sees all rows, too.
    """
    history = stage(observable_as_of(sample, start), "tuning")
    table = elastic_net.tune(history, alphas, l1_ratios, n_folds, min_train_months)
    best = table.where("selected").first()
    if best is None:
        raise ContractViolation("Not enough months for forward-chaining selection")
    tables, trees = {"elastic_net": table}, None
    if tree_grid:
        drawn = stage(monthly_hash_sample(history, tree_rows_per_month, seed), "tuning")
        scores = boosted_trees.tune(drawn, tree_grid, n_folds, min_train_months, seed=seed)
        tables["boosted_trees"] = scores
        trees = dict(tree_grid[scores.orderBy("mean_cv_mse", "grid_index").first()["grid_index"]])
    return {"alpha": best["alpha"], "l1_ratio": best["l1_ratio"]}, trees, tables


@frees_staged
def run_estimation(
    panel: DataFrame, out: str, start: str, end: str | None = None, min_train_months: int = 60,
    every: int = 1, elastic: Mapping[str, float] | None = None,
    trees: Mapping[str, Any] | None = None, run_key: str | None = None, seed: int = 42,
) -> dict[str, str]:
    """Predict every month that ``out`` does not hold yet, then write the reports.

    The refit schedule counts all test months, so a resumed run refits in the same
    months as an uninterrupted one.
    """
    sample = stage(complete_case_sample(panel), "sample")
    refits = {"elastic_net_coefficients": f"{out}/coefficients_by_refit",
              "tree_importances": f"{out}/importances_by_refit"}

    def compute(months: DataFrame) -> DataFrame:
        rows, coefficients, importances = oos.expanding_baseline(
            sample, start, end, min_train_months, every, elastic, trees, seed, months
        )
        for name, df in (("elastic_net_coefficients", coefficients),
                         ("tree_importances", importances)):
            append_parts(df.withColumn("refit", F.date_format("refit_date", "yyyy-MM")),
                         refits[name], "refit")
        return rows

    path = f"{out}/predictions"
    settings = {"start": start, "min_train_months": min_train_months, "every": every,
                "elastic": elastic, "trees": trees, "seed": seed}
    spark = sample.sparkSession
    predictions = resume_months(spark, path, sample, compute, settings, run_key)
    models = {name: spark.read.parquet(parts).drop("refit") for name, parts in refits.items()}
    oos.check_predictions(predictions)
    monthly = stage(rank_ic.monthly_rank_correlations(predictions), "monthly_ic")
    metrics = reports.model_metrics(predictions)
    summary = summaries.rank_correlation_summary(monthly)
    diagnostics = stage(reports.prediction_diagnostics(predictions), "diagnostics")
    reports.check_prediction_diagnostics(diagnostics)
    tables = {
        "model_metrics": metrics,
        "monthly_rank_ic": monthly,
        "rank_ic_summary": summary,
        "prediction_diagnostics": diagnostics,
        "model_comparison": reports.model_comparison(metrics, summary),
        "rolling_rmse": reports.rolling_rmse(predictions),
        **models,
    }
    return {"predictions": path,
            **{name: write_csv(df, f"{out}/{name}") for name, df in tables.items()}}


def fit_one_security(panel: DataFrame, ticker: str, **settings: Any) -> DataFrame:
    """Long predictions of a single named security from models fitted on the whole panel."""
    return oos.expanding_long(panel, **settings).where(F.upper("ticker") == ticker.upper())
