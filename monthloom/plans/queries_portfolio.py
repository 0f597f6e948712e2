"""Queries on sorts, decile returns, rank IC, costs and inference."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import costs, inference, portfolios, rank_ic, reshape, summaries
from monthloom.operators.features import build_features
from monthloom.plans.catalog import query
from monthloom.schema import FORMATION
from monthloom.sources.market_tables import MarketTables

_DECILES = " ".join(f"D{d}:8 n_D{d}:i" for d in range(1, 11))
_HAC = "hac_se:8 t_stat:5 p_value:7 ci_lower:8 ci_upper:8 n_months:i hac_lag:i"


@query("slice_momentum_spread", "formation_date:d weighting D1:8 D10:8 n_D1:i n_D10:i "
       "D10_minus_D1:8 n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    """What a momentum decile spread earns each month, straight from the lineitem file."""
    rows = build_features(m.prices().drop("caldt")).select(
        F.col("date").alias(FORMATION), "realized_return_date", "permno",
        F.lit("mom_12_2").alias("model"), F.col("mom_12_2").alias("prediction"),
        "next_month_return", "me_lag",
    ).where("prediction IS NOT NULL AND next_month_return IS NOT NULL")
    sorted_rows = portfolios.assign_deciles(rows)
    long = portfolios.decile_returns_long(
        sorted_rows, "next_month_return", "me_lag", [FORMATION, "model"]
    )
    return portfolios.decile_returns_wide(long, [FORMATION, "model", "weighting"])


# --- portfolios ------------------------------------------------------------------------
def _with_gaps(m: MarketTables) -> DataFrame:
    """Long predictions with missing scores, thin months and constant months."""
    mth = F.month(FORMATION)
    return m.predictions_long().where(
        ~((mth == 3) & (F.col("permno") % 12 != 0))
    ).withColumns({
        "prediction": F.when((F.col("permno") % 15 == 4) & (mth == 6), F.lit(None))
        .when(mth == 9, F.lit(0.01))
        .when(mth == 11, F.lit(0.01) + (F.col("permno") % 4) / 100.0)
        .otherwise(F.col("prediction")),
        "value_weight_date": F.col("me_lag_date"),
    })


@query("pf_01_assignments", "permno:i formation_date:d model decile:i decile_status "
       "weighting_variable:6 value_weight_date:d")
def _(m: MarketTables) -> DataFrame:
    return portfolios.portfolio_assignments(_with_gaps(m))


@query("pf_01_skipped_months", "formation_date:d model reason n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    rows = _with_gaps(m).where(
        (F.month(FORMATION) != 3) | (F.col("permno") % 120 == 0)
    )
    return portfolios.skipped_months(portfolios.portfolio_assignments(rows))


@query("pf_02_degeneracy_gate", "formation_date:d model n_stocks:i n_valid_predictions:i "
       "n_unique_predictions:i prediction_range:8 prediction_status")
def _(m: MarketTables) -> DataFrame:
    return portfolios.prediction_diagnostics_by_group(_with_gaps(m))


@query("pf_03_strict_assignments", "permno:i formation_date:d model decile:i decile_status "
       "n_unique_predictions:i prediction_range:8")
def _(m: MarketTables) -> DataFrame:
    return portfolios.strict_assignments(_with_gaps(m))[0]


@query("pf_03_strict_skipped", "formation_date:d model reason n_valid_predictions:i "
       "n_unique_predictions:i")
def _(m: MarketTables) -> DataFrame:
    return portfolios.strict_assignments(_with_gaps(m))[1]


@query("pf_04_wide_assignments", "permno:i formation_date:d model decile:i "
       "realized_next_month_return:8 weighting_variable:6 regime_binary regime_3state")
def _(m: MarketTables) -> DataFrame:
    return portfolios.assign_from_wide(m.three_state_predictions(), strict=True)


@query("pf_05_decile_returns", "formation_date:d realized_return_date:d model weighting "
       f"regime_binary regime_3state {_DECILES} D10_minus_D1:8 n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    return portfolios.decile_returns_wide(
        portfolios.decile_returns_long(m.assignments()), strict=True
    )


@query("pf_05_decile_returns_lenient", "formation_date:d model weighting regime n_stocks:i "
       "D1_n:i D1:8 D1_n_weight:i D10_n:i D10:8 D10_n_weight:i D10_minus_D1:8")
def _(m: MarketTables) -> DataFrame:
    me = F.when(F.col("permno") % 6 != 0, F.col("me_lag"))
    rows = m.predictions_long().withColumn("me_lag", me)
    return portfolios.decile_returns_lenient(portfolios.portfolio_assignments(rows))


@query("pf_06_extreme_portfolios", "date:d model weighting regime n_long:i n_short:i "
       "gross_long_short_return:8 long_turnover:8 short_turnover:8 total_turnover:8 "
       "transaction_cost:8 net_long_short_return:8")
def _(m: MarketTables) -> DataFrame:
    return m.extreme_portfolios()


# --- rank IC ---------------------------------------------------------------------------
@query("ic_01_rank_ic", "formation_date:d model regime_binary regime_3state spearman_ic:8 "
       "n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    return rank_ic.monthly_rank_ic(m.three_state_predictions())


@query("ic_01_rank_metrics", "formation_date:d realized_return_date:d model regime n_stocks:i "
       "spearman:8")
def _(m: MarketTables) -> DataFrame:
    return rank_ic.monthly_rank_metrics(m.predictions_long())


@query("ic_01_rank_metrics_strict", "formation_date:d model n_stocks:i n_unique_predictions:i "
       "prediction_range:8 spearman:8")
def _(m: MarketTables) -> DataFrame:
    return rank_ic.monthly_rank_metrics_strict(_with_gaps(m))


@query("ic_02_rank_correlations", "date:d regime model spearman_ic:8 pearson_ic:8 n:i")
def _(m: MarketTables) -> DataFrame:
    return rank_ic.monthly_rank_correlations(m.predictions())


# --- summaries -------------------------------------------------------------------------
@query("agg_03_grouping_sets_summary", "model weighting regime_definition regime n_months:i "
       "mean_D10_minus_D1:8 fraction_positive:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.spread_summary(m.deciles_wide())


@query("agg_04_spread_summary", "model weighting regime_definition regime n_months:i mean_D1:8 "
       "mean_D10:8 mean_D10_minus_D1:8 sd_D10_minus_D1:8 annualized_D10_minus_D1:8 "
       "annualized_volatility:8 descriptive_sharpe:8 fraction_positive:8 min_monthly_spread:8 "
       "max_monthly_spread:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.spread_summary(m.deciles_wide())


def _one_regime(m: MarketTables) -> DataFrame:
    return portfolios.long_short(m.deciles_wide()).withColumnRenamed("regime_binary", "regime")


@query("agg_05_regime_summary", "model weighting regime n_months:i average_D1_monthly_return:8 "
       "average_D10_monthly_return:8 mean_monthly_D10_minus_D1:8 sd_monthly_D10_minus_D1:8 "
       "descriptive_sharpe:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.spread_summary_by_regime(_one_regime(m))


@query("agg_05_regime_comparison", "model regime weighting regime_order:i "
       "mean_monthly_D10_minus_D1:8 annualized_arithmetic_mean:8 annualized_volatility:8 "
       "fraction_positive:8 n_months:i")
def _(m: MarketTables) -> DataFrame:
    return summaries.regime_comparison(summaries.spread_summary_by_regime(_one_regime(m)))


@query("agg_21_rank_ic_summary", "model regime_definition regime n_months:i mean_spearman:8 "
       "median_spearman:8 sd_spearman:8 fraction_positive:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.rank_ic_summary(m.monthly_ic())


@query("agg_21_rank_correlation_summary", "model regime mean_monthly_spearman_ic:8 "
       "median_spearman_ic:8 std_spearman_ic:8 fraction_months_ic_gt_zero:8 n_months:i "
       "mean_monthly_pearson_ic:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.rank_correlation_summary(
        rank_ic.monthly_rank_correlations(m.predictions())
    )


@query("agg_24_decile_profiles", "model weighting regime_definition regime decile:i "
       "mean_realized_return:8 n_months:i")
def _(m: MarketTables) -> DataFrame:
    return summaries.decile_profiles(m.deciles_long())


@query("agg_25_monotonicity", "model weighting regime_definition regime "
       "decile_return_spearman:8 adjacent_increases:i adjacent_comparisons:i")
def _(m: MarketTables) -> DataFrame:
    return summaries.monotonicity(summaries.decile_profiles(m.deciles_long()))


@query("jon_18_central_summary", "model weighting regime n_months:i mean_D10_minus_D1:8 "
       "descriptive_sharpe:8 mean_rank_ic:8")
def _(m: MarketTables) -> DataFrame:
    return summaries.central_summary(
        summaries.spread_summary(m.deciles_wide()), summaries.rank_ic_summary(m.monthly_ic())
    )


# --- costs -----------------------------------------------------------------------------
@query("tc_01_target_weights", "permno:i formation_date:d model weighting decile:i "
       "target_weight:10")
def _(m: MarketTables) -> DataFrame:
    return costs.target_weights(m.assignments())


@query("tc_02_drifted_weights", "permno:i formation_date:d model weighting decile:i "
       "drifted_weight:10")
def _(m: MarketTables) -> DataFrame:
    return costs.target_weights(m.assignments())


@query("jon_15_aligned_weights", "permno:i formation_date:d model weighting decile:i "
       "target_weight:10 pretrade_weight:10")
def _(m: MarketTables) -> DataFrame:
    rows = m.assignments()
    return costs.aligned_weights(costs.target_weights(rows), costs.month_calendar(rows))


@query("jon_16_previous_month", "permno:i formation_date:d model weighting decile:i "
       "pretrade_weight:10")
def _(m: MarketTables) -> DataFrame:
    rows = m.assignments()
    return costs.aligned_weights(
        costs.target_weights(rows), costs.month_calendar(rows)
    ).where("pretrade_weight > 0")


@query("tc_03_turnover", "formation_date:d model weighting decile:i turnover:8 n_stocks:i "
       "initial_formation:b")
def _(m: MarketTables) -> DataFrame:
    rows = m.assignments()
    calendar = costs.month_calendar(rows)
    return costs.one_way_turnover(
        costs.aligned_weights(costs.target_weights(rows), calendar), calendar
    )


_TURN = " ".join(f"D{d}_turnover:8" for d in range(1, 11))


@query("tc_04_reconstruction", f"formation_date:d model weighting regime_3state {_DECILES} {_TURN} "
       "D10_minus_D1:8 n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    return costs.reconstruct(m.assignments())[0]


@query("tc_04_turnover_by_decile", "formation_date:d model weighting decile turnover:8 "
       "n_stocks:i regime_binary initial_formation:b")
def _(m: MarketTables) -> DataFrame:
    return m.reconstruction()[1]


@query("tc_04_weight_audit", "formation_date:d permno:i ticker model weighting decile "
       "target_weight:10 pretrade_weight:10 absolute_weight_change:10 initial_formation:b")
def _(m: MarketTables) -> DataFrame:
    return m.reconstruction()[2]


@query("tc_05_cost_scenarios", "formation_date:d model weighting transaction_cost_bps:i "
       "D1_gross:8 D10_gross:8 D1_cost:8 D10_cost:8 D1_net:8 D10_net:8 "
       "D1_short_leg_net_contribution:8 long_short_total_turnover:8 long_short_cost:8 "
       "D10_minus_D1_net:8")
def _(m: MarketTables) -> DataFrame:
    return costs.apply_cost_scenarios(m.reconstruction()[0])


@query("agg_26_turnover_summary", "model weighting decile regime_definition regime n_months:i "
       "mean_turnover:8 median_turnover:8 std_turnover:8 p25:8 p75:8 p95:8 maximum:8")
def _(m: MarketTables) -> DataFrame:
    monthly, by_decile, _audit = m.reconstruction()
    return summaries.turnover_summary(monthly, by_decile)


@query("agg_27_cost_summary", "model weighting regime_definition regime transaction_cost_bps:i "
       "n_months:i mean_gross_D10_minus_D1:8 mean_total_turnover:8 mean_transaction_cost:8 "
       "mean_net_D10_minus_D1:8 annualized_net_volatility:8 descriptive_net_sharpe:8 "
       "fraction_net_positive:8 cost_attrition:8 cost_attrition_ratio:6")
def _(m: MarketTables) -> DataFrame:
    return summaries.cost_summary(m.net_returns())


@query("agg_27_breakeven", "model weighting regime_definition regime n_months:i "
       "mean_gross_spread:8 mean_traded_notional:8 breakeven_cost_decimal:8 breakeven_cost_bps:4")
def _(m: MarketTables) -> DataFrame:
    return summaries.breakeven_costs(m.net_returns())


@query("jon_09_gross_replication", "check n_rows:i")
def _(m: MarketTables) -> DataFrame:
    from monthloom.operators.contracts import reconcile

    numeric = [f"D{d}" for d in range(1, 11)] + ["D10_minus_D1"]
    exact = [f"n_D{d}" for d in range(1, 11)] + ["n_stocks", "regime_binary", "regime_3state"]
    keys = [FORMATION, "model", "weighting"]
    rebuilt, stored = m.reconstruction()[0], m.deciles_wide()
    diff = reconcile(rebuilt, stored, keys, numeric, exact)
    n = F.count(F.lit(1)).alias("n_rows")
    return diff.agg(n).withColumn("check", F.lit("differences")).unionByName(
        stored.agg(n).withColumn("check", F.lit("stored"))
    )


# --- inference -------------------------------------------------------------------------
@query("inf_01_hac_means", "model weighting regime_definition regime estimate:8 hac_se:8 "
       "t_stat:5 p_value:7 ci_lower:8 ci_upper:8 n_months:i")
def _(m: MarketTables) -> DataFrame:
    from monthloom.operators.regimes import with_regime_definitions

    rows = with_regime_definitions(m.deciles_wide(), ["overall", "three_state"])
    return inference.hac_means(
        rows, ["model", "weighting", "regime_definition", "regime"], "D10_minus_D1"
    )


@query("inf_02_regime_differences", "model weighting comparison estimated_difference:8 "
       "left_mean:8 right_mean:8 hac_se:8 t_stat:5 n_months:i")
def _(m: MarketTables) -> DataFrame:
    return inference.hac_differences(
        m.deciles_wide(), ["model", "weighting"], "D10_minus_D1", "regime_3state"
    )


@query("inf_03_long_short_table", "model weighting regime_definition regime "
       f"mean_monthly_return:8 {_HAC} significance")
def _(m: MarketTables) -> DataFrame:
    return inference.long_short_inference(m.deciles_wide())


@query("inf_03_rank_ic_table", f"model regime_definition regime mean_spearman_ic:8 {_HAC} "
       "significance")
def _(m: MarketTables) -> DataFrame:
    return inference.rank_ic_inference_table(m.monthly_ic())


_DIFF = ("comparison estimated_difference:8 hac_se:8 t_stat:5 raw_p_value:7 holm_p_value:7 "
         "bh_fdr_p_value:7 ci_lower:8 ci_upper:8 n_months:i raw_significance "
         "adjusted_significance")


@query("inf_04_long_short_differences", f"model weighting {_DIFF}")
def _(m: MarketTables) -> DataFrame:
    return inference.long_short_differences(m.deciles_wide())


@query("inf_04_rank_ic_differences", f"model {_DIFF}")
def _(m: MarketTables) -> DataFrame:
    return inference.rank_ic_differences(m.monthly_ic())


@query("inf_04_binary_inference", "outcome model weighting regime estimate:8 hac_se:8 t_stat:5 "
       "n_months:i")
def _(m: MarketTables) -> DataFrame:
    ls = inference.binary_means(m.deciles_wide(), ["model", "weighting"], "D10_minus_D1")
    ic = inference.binary_means(m.monthly_ic(), ["model"], "spearman_ic")
    return reshape.union_with_panel({"D10_minus_D1": ls, "spearman_ic": ic}, "outcome")


@query("inf_04_binary_differences", "model weighting comparison estimated_difference:8 hac_se:8 "
       "t_stat:5 p_value:7")
def _(m: MarketTables) -> DataFrame:
    return inference.binary_differences(
        m.deciles_wide(), ["model", "weighting"], "D10_minus_D1"
    )


@query("inf_05_multiple_testing", "model weighting decile:i p_value:7 holm_p_value:7 "
       "bh_fdr_p_value:7")
def _(m: MarketTables) -> DataFrame:
    """Mean returns of all deciles, one family per model and weighting."""
    from monthloom.functions.scalars import two_sided_normal_p

    x = F.col("decile_return")
    t = F.avg(x) / (F.stddev_samp(x) / F.sqrt(F.count(x)))
    tests = m.deciles_long().groupBy("model", "weighting", "decile").agg(t.alias("t")).select(
        "model", "weighting", "decile", two_sided_normal_p("t").alias("p_value"))
    return inference.adjust_p_values(tests, ["model", "weighting"], "p_value")


@query("inf_06_performance", "model weighting regime months:i gross_mean_monthly:8 "
       "gross_annualized_mean:8 gross_hac_t:5 gross_p_value:7 average_total_turnover:8 "
       "average_transaction_cost:8 net_mean_monthly:8 net_annualized_mean:8 "
       "net_annualized_volatility:8 net_sharpe:8 net_hac_t:5 net_p_value:7 "
       "net_fraction_positive:8")
def _(m: MarketTables) -> DataFrame:
    return inference.performance_summary(m.extreme_portfolios())


@query("inf_06_regime_tests", "model weighting return_type high_mean:8 low_mean:8 "
       "low_minus_high:8 hac_se:8 hac_t:5 p_value:7")
def _(m: MarketTables) -> DataFrame:
    return inference.regime_difference_tests(m.extreme_portfolios())


@query("inf_06_rank_ic_means", "model regime months:i mean_spearman_ic:8 hac_se:8 hac_t:5")
def _(m: MarketTables) -> DataFrame:
    return inference.rank_ic_inference(
        rank_ic.monthly_rank_correlations(m.predictions())
    )[0]


@query("inf_06_rank_ic_test", "model high_mean:8 low_mean:8 low_minus_high:8 hac_se:8 p_value:7")
def _(m: MarketTables) -> DataFrame:
    return inference.rank_ic_inference(
        rank_ic.monthly_rank_correlations(m.predictions())
    )[1]


@query("inf_07_publication_table", "panel model weighting regime comparison "
       "mean_monthly_return:8 estimated_difference:8 mean_spearman_ic:8 hac_se:8 t_stat:5 "
       "n_months:i")
def _(m: MarketTables) -> DataFrame:
    return reshape.union_with_panel({
        "D10-D1 mean inference": inference.long_short_inference(m.deciles_wide()),
        "D10-D1 regime differences": inference.long_short_differences(m.deciles_wide()),
        "Rank IC mean inference": inference.rank_ic_inference_table(m.monthly_ic()),
        "Rank IC regime differences": inference.rank_ic_differences(m.monthly_ic()),
    })


@query("inf_07_cost_table", "model weighting regime_definition regime n_months:i "
       "mean_gross_D10_minus_D1:8 mean_total_turnover:8 mean_net_D10_minus_D1:8 hac_se:8 "
       "t_stat:5 p_value:7")
def _(m: MarketTables) -> DataFrame:
    from monthloom.plans.cost_study import publication_table

    return publication_table(m.net_returns())
