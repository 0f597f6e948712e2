"""Queries on panel, prediction and run reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import accounting, panel, rank_ic, regimes, reports, summaries
from monthloom.plans.catalog import query
from monthloom.schema import TARGET
from monthloom.sources import scans
from monthloom.sources.market_tables import MarketTables

_Q = "p0_1:6 p1:6 p5:6 p25:6 p50:6 p75:6 p95:6 p99:6 p99_9:6"


@query("agg_01_monthly_last", "date:d vix:12")
def _(m: MarketTables) -> DataFrame:
    return regimes.daily_to_monthly(m.index_daily())


@query("agg_02_complete_group_sum", "gvkey characteristic_year:i linked_permnos:i "
       "permnos_with_december_me:i me_dec:6")
def _(m: MarketTables) -> DataFrame:
    rows = accounting.annual_book_to_market(m.linked(), m.features())
    return rows.groupBy("gvkey", "characteristic_year").agg(*[
        F.max(c).alias(c) for c in ("linked_permnos", "permnos_with_december_me", "me_dec")
    ])


@query("agg_06_quantile_profile", f"variable n:i missing:i mean:6 std:6 min:6 max:6 {_Q}")
def _(m: MarketTables) -> DataFrame:
    return reports.distribution_report(
        m.panel(), ["book_equity", "me_dec", "book_to_market", "log_me", "mom_12_2", TARGET]
    )


@query("agg_07_sample_flow", "stage_order:i observations:i")
def _(m: MarketTables) -> DataFrame:
    return reports.sample_flow(m.panel())


@query("agg_07_sample_flow_securities", "stage_order:i observations:i securities:i")
def _(m: MarketTables) -> DataFrame:
    return reports.sample_flow_securities(m.panel())


@query("agg_08_missingness", "variable missing_count:i missing_percentage:6 nonmissing_count:i")
def _(m: MarketTables) -> DataFrame:
    return reports.missingness(m.panel())


_VALID = ("valid_size:i valid_book_to_market:i valid_momentum:i complete_baseline:i")


@query("agg_09_coverage_by_year", "year:i stock_month_observations:i unique_securities:i "
       f"{_VALID} HIGH_months:i LOW_months:i")
def _(m: MarketTables) -> DataFrame:
    return reports.coverage_by_year(m.panel())


@query("agg_10_coverage_by_month", "formation_date:d eligible_securities:i "
       f"{_VALID} all_three_predictors:i")
def _(m: MarketTables) -> DataFrame:
    return reports.coverage_by_month(m.panel())


@query("agg_11_monthly_count_range", "minimum:i median:4 maximum:i")
def _(m: MarketTables) -> DataFrame:
    return reports.monthly_count_range(reports.coverage_by_month(m.panel()))


@query("agg_12_construction_summary", "fundamentals_rows:i fundamentals_firms:i fiscal_start:d "
       "fiscal_end:d missing_seq:i missing_ceq:i missing_at:i missing_lt:i link_rows:i "
       "panel_rows:i panel_start:d panel_end:d panel_unique_permnos:i unmatched_securities:i "
       "book_equity_missing_months:i book_equity_zero_months:i book_equity_negative_months:i "
       "valid_book_to_market_months:i complete_predictor_rows:i coverage_log_me:8 "
       "coverage_mom_12_2:8 coverage_book_to_market:8 coverage_next_month_return:8 "
       "coverage_regime:8")
def _(m: MarketTables) -> DataFrame:
    return reports.construction_summary(m.fundamentals(), m.links(), m.panel())


@query("agg_12_code_distribution", "field code n:i")
def _(m: MarketTables) -> DataFrame:
    return reports.code_distribution(m.links())


@query("agg_13_pooled_correlations", "scope method feature_1 feature_2 correlation:8 "
       "observations:i")
def _(m: MarketTables) -> DataFrame:
    return reports.pooled_correlations(m.panel())


@query("agg_14_monthly_correlations", "scope method feature_1 feature_2 correlation:8 months:i")
def _(m: MarketTables) -> DataFrame:
    return reports.average_monthly_correlations(m.panel())


@query("agg_15_extreme_summary", "variable count:i minimum:6 p0_1:6 p99_9:6 maximum:6 "
       "count_at_or_below_p0_1:i count_at_or_above_p99_9:i")
def _(m: MarketTables) -> DataFrame:
    return reports.extreme_summary(m.panel())


@query("agg_16_panel_report", "check value:6")
def _(m: MarketTables) -> DataFrame:
    names = ["log_me", "book_to_market", "mom_12_2"]
    return reports.check_value_report(m.panel(), [*names, TARGET], [*names, "ret"])


@query("agg_16_security_report", "check value:6")
def _(m: MarketTables) -> DataFrame:
    raw = scans.security_monthly(m.security_file(), "1995-01-01", "2001-12-31").drop("me_lag")
    rows = scans.normalize_security_monthly(raw, "ciz", "security_file")
    names = ["ret", "prc", "shrout", "market_equity", "me_lag"]
    return reports.check_value_report(rows, names, names, regime=None)


@query("agg_17_forecast_metrics", "model regime n_obs:i mse:8 rmse:8 mae:8 r2:8 oos_r2:8 "
       "oos_r2_vs_zero:8 correlation:8")
def _(m: MarketTables) -> DataFrame:
    return reports.metrics_table(m.predictions_long(), "actual_next_month_return")


@query("agg_18_model_metrics", "model regime n:i mse:8 rmse:8 mae:8 oos_r2:8 correlation:8 "
       "realized_return_std:8 normalized_rmse:8 benchmark_rmse:8")
def _(m: MarketTables) -> DataFrame:
    return reports.model_metrics(m.predictions())


@query("agg_19_prediction_diagnostics", "model regime n_rows:i prediction_coverage:8 "
       "min_monthly_coverage:8 missing_predictions:i infinite_predictions:i prediction_mean:8 "
       "prediction_std:8 prediction_min:8 prediction_p01:8 prediction_p05:8 prediction_p50:8 "
       "prediction_p95:8 prediction_p99:8 prediction_max:8 actual_mean:8 actual_std:8")
def _(m: MarketTables) -> DataFrame:
    k = F.col("permno")
    faulty = m.predictions().withColumn(
        "xgboost_prediction",
        F.when(k % 25 == 3, F.lit(None)).when(k % 25 == 4, F.lit(float("inf")))
        .otherwise(F.col("xgboost_prediction")),
    )
    return reports.prediction_diagnostics(faulty)


@query("agg_20_model_comparison", "model overall_rmse:8 high_rmse:8 low_rmse:8 overall_oos_r2:8 "
       "high_oos_r2:8 low_oos_r2:8 high_minus_low_oos_r2:8 overall_mean_spearman_ic:8 "
       "high_mean_spearman_ic:8 low_mean_spearman_ic:8")
def _(m: MarketTables) -> DataFrame:
    ic = summaries.rank_correlation_summary(rank_ic.monthly_rank_correlations(m.predictions()))
    return reports.model_comparison(reports.model_metrics(m.predictions()), ic)


@query("agg_20_comparison_columns", "model regime n_obs:i rmse:8 oos_r2_vs_zero:8")
def _(m: MarketTables) -> DataFrame:
    return reports.comparison_columns(
        reports.metrics_table(m.predictions_long(), "actual_next_month_return")
    )


@query("agg_22_regime_validation", "regime oos_month_count:i oos_stock_month_count:i "
       "earliest_valid_threshold:d q33_min:10 q33_median:10 q33_max:10 q67_min:10 q67_median:10 "
       "q67_max:10 q33_le_q67_all_valid:b")
def _(m: MarketTables) -> DataFrame:
    return regimes.regime_validation(m.three_regimes(), m.three_state_predictions())


@query("agg_23_transition_counts", "from_regime to_regime count:i")
def _(m: MarketTables) -> DataFrame:
    return regimes.transition_counts(regimes.expanding_regimes(m.index_monthly(), 12))


@query("agg_28_economic_sanity", "me_error_small:b bm_error_small:b book_to_market_median:8 "
       "book_to_market_p999:6 unit_sanity_status")
def _(m: MarketTables) -> DataFrame:
    return reports.economic_sanity(m.panel()).withColumns({
        "me_error_small": F.col("market_equity_identity_max_abs_error") < 1e-6,
        "bm_error_small": F.col("book_to_market_identity_max_abs_error") < 1e-9,
    })


@query("agg_29_count_audit", "total_stock_months:i complete_predictor_rows:i "
       "final_screened_rows:i duplicate_permno_date_rows:i")
def _(m: MarketTables) -> DataFrame:
    return reports.count_audit(m.panel(), panel.model_eligible(m.panel()))


@query("agg_30_run_report", "check model part value:2")
def _(m: MarketTables) -> DataFrame:
    return reports.portfolio_run_report(m.predictions_long(), m.deciles_wide())



