"""Oracle bodies for sorts, decile returns, rank IC, costs and inference."""
from oracle.render import body
from oracle.tables import (
    STARS, adjusted, avg_rank, correlation, erfc_p, hac_diff, hac_mean, table,
)

table("momrank", """
SELECT *, CAST(floor((rn - 1) * 10 / n) AS BIGINT) + 1 AS decile FROM (
SELECT date AS formation_date, next_month_return AS r, me_lag,
       row_number() OVER (PARTITION BY date ORDER BY mom_12_2, permno) AS rn,
       count(*) OVER (PARTITION BY date) AS n
FROM features WHERE mom_12_2 IS NOT NULL AND next_month_return IS NOT NULL) WHERE n >= 10""")
body("slice_momentum_spread", """
SELECT formation_date, weighting, max(CASE WHEN decile = 1 THEN v END) AS D1,
  max(CASE WHEN decile = 10 THEN v END) AS D10, max(CASE WHEN decile = 1 THEN k END) AS n_D1,
  max(CASE WHEN decile = 10 THEN k END) AS n_D10, sum(k) AS n_stocks,
  max(CASE WHEN decile = 10 THEN v END) - max(CASE WHEN decile = 1 THEN v END) AS D10_minus_D1
FROM (SELECT formation_date, decile, 'EW' AS weighting, avg(r) AS v, count(*) AS k
      FROM momrank GROUP BY 1, 2
      UNION ALL SELECT formation_date, decile, 'VW', sum(me_lag * r) / sum(me_lag), count(*)
      FROM momrank WHERE me_lag > 0 GROUP BY 1, 2) GROUP BY 1, 2""")

table("gappy", """
SELECT * REPLACE (CASE WHEN permno % 15 = 4 AND month(formation_date) = 6 THEN NULL
  WHEN month(formation_date) = 9 THEN CAST(0.01 AS DOUBLE)
  WHEN month(formation_date) = 11 THEN CAST(0.01 AS DOUBLE) + (permno % 4) / 100.0
  ELSE prediction END AS prediction)
FROM predlong WHERE NOT (month(formation_date) = 3 AND permno % 12 <> 0)""")


def _lenient(source: str) -> str:
    return f"""
SELECT *, CASE WHEN n >= 10 THEN floor((rn - 1) * 10 / n) + 1 END AS decile,
  CASE WHEN n >= 10 THEN 'assigned' ELSE 'insufficient_securities' END AS decile_status
FROM (SELECT *, row_number() OVER (PARTITION BY formation_date, model
               ORDER BY prediction, permno) AS rn,
             count(*) OVER (PARTITION BY formation_date, model) AS n
      FROM {source} WHERE prediction IS NOT NULL)"""


body("pf_01_assignments", f"""SELECT *, me_lag AS weighting_variable,
me_lag_date AS value_weight_date FROM ({_lenient('gappy')})""")
body("pf_01_skipped_months", """SELECT formation_date, model,
'fewer_than_10_valid_predictions' AS reason, count(*) AS n_stocks FROM gappy
WHERE prediction IS NOT NULL AND (month(formation_date) <> 3 OR permno % 120 = 0)
GROUP BY 1, 2 HAVING count(*) < 10""")

table("gapdiag", """
SELECT *, CASE WHEN n_valid_predictions < 10 THEN 'fewer_than_10_valid_predictions'
  WHEN n_unique_predictions < 10 THEN 'fewer_than_10_distinct_predictions'
  WHEN prediction_range <= 1e-12 + 1e-10 THEN 'near_constant_predictions'
  ELSE 'sortable' END AS prediction_status
FROM (SELECT formation_date, model, count(*) AS n_all, count(DISTINCT permno) AS n_stocks,
  count(prediction) AS n_valid_predictions, count(DISTINCT prediction) AS n_unique_predictions,
  max(prediction) - min(prediction) AS prediction_range FROM gappy GROUP BY 1, 2)""")
table("gapdiag_valid", """
SELECT *, CASE WHEN n_valid_predictions < 10 THEN 'fewer_than_10_valid_predictions'
  WHEN n_unique_predictions < 10 THEN 'fewer_than_10_distinct_predictions'
  ELSE 'sortable' END AS prediction_status
FROM (SELECT formation_date, model, count(prediction) AS n_valid_predictions,
  count(DISTINCT prediction) AS n_unique_predictions,
  max(prediction) - min(prediction) AS prediction_range
  FROM gappy WHERE prediction IS NOT NULL GROUP BY 1, 2)""")
body("pf_02_degeneracy_gate", "SELECT * FROM gapdiag")
body("pf_03_strict_assignments", f"""
SELECT a.permno, a.formation_date, a.model,
  CASE WHEN g.prediction_status = 'sortable' THEN a.decile END AS decile,
  CASE WHEN g.prediction_status = 'sortable' THEN 'assigned' ELSE g.prediction_status END
    AS decile_status, g.n_unique_predictions, g.prediction_range
FROM ({_lenient('gappy')}) a JOIN gapdiag_valid g USING (formation_date, model)""")
body("pf_03_strict_skipped", """SELECT formation_date, model, prediction_status AS reason,
n_valid_predictions, n_unique_predictions FROM gapdiag_valid
WHERE prediction_status <> 'sortable'""")
body("pf_04_wide_assignments", "SELECT * FROM assign")
body("pf_05_decile_returns", "SELECT * FROM dwide")

table("lenient5", f"""
SELECT * REPLACE (CASE WHEN permno % 6 <> 0 THEN me_lag END AS me_lag)
FROM ({_lenient('predlong')})""")
body("pf_05_decile_returns_lenient", """
SELECT *, D10 - D1 AS D10_minus_D1 FROM (
SELECT formation_date, model, regime, weighting, sum(k) AS n_stocks,
  max(CASE WHEN decile = 1 THEN k END) AS D1_n, max(CASE WHEN decile = 1 THEN v END) AS D1,
  max(CASE WHEN decile = 1 THEN w END) AS D1_n_weight,
  max(CASE WHEN decile = 10 THEN k END) AS D10_n, max(CASE WHEN decile = 10 THEN v END) AS D10,
  max(CASE WHEN decile = 10 THEN w END) AS D10_n_weight
FROM (SELECT formation_date, model, regime, decile, 'EW' AS weighting, count(*) AS k,
        avg(actual_next_month_return) AS v, count(*) AS w FROM lenient5 GROUP BY 1, 2, 3, 4
      UNION ALL
      SELECT formation_date, model, regime, decile, 'VW', count(*),
        sum(me_lag * actual_next_month_return) / sum(me_lag), count(me_lag)
      FROM lenient5 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4)""")
body("pf_06_extreme_portfolios", """SELECT *, gross AS gross_long_short_return,
cost AS transaction_cost, net_return AS net_long_short_return FROM extreme""")

body("ic_01_rank_ic", "SELECT * FROM ic")
body("ic_01_rank_metrics", "SELECT *, spearman_ic AS spearman FROM ic")
body("ic_01_rank_metrics_strict", f"""
SELECT formation_date, model, count(*) AS n_stocks,
  count(DISTINCT prediction) AS n_unique_predictions,
  max(prediction) - min(prediction) AS prediction_range, {correlation('rx', 'ry')} AS spearman
FROM (SELECT *, {avg_rank('prediction', 'formation_date, model')} AS rx,
             {avg_rank('actual_next_month_return', 'formation_date, model')} AS ry
      FROM gappy WHERE prediction IS NOT NULL) GROUP BY 1, 2""")
body("ic_02_rank_correlations",
     "SELECT *, formation_date AS date, n_stocks AS n FROM ic")

_S = """count(D10_minus_D1) AS n_months, avg(D1) AS mean_D1, avg(D10) AS mean_D10,
avg(D10_minus_D1) AS mean_D10_minus_D1, stddev_samp(D10_minus_D1) AS sd_D10_minus_D1,
12 * avg(D10_minus_D1) AS annualized_D10_minus_D1,
sqrt(12) * stddev_samp(D10_minus_D1) AS annualized_volatility,
sqrt(12) * avg(D10_minus_D1) / nullif(stddev_samp(D10_minus_D1), 0) AS descriptive_sharpe,
avg(CASE WHEN D10_minus_D1 > 0 THEN 1.0 ELSE 0.0 END) AS fraction_positive,
min(D10_minus_D1) AS min_monthly_spread, max(D10_minus_D1) AS max_monthly_spread"""
table("spreadsum", f"""SELECT model, weighting, regime_definition, regime, {_S}
FROM dwide_r GROUP BY 1, 2, 3, 4""")
body("agg_03_grouping_sets_summary", "SELECT * FROM spreadsum")
body("agg_04_spread_summary", "SELECT * FROM spreadsum")
table("spreadsum2", """SELECT *, mean_D1 AS average_D1_monthly_return,
mean_D10 AS average_D10_monthly_return, mean_D10_minus_D1 AS mean_monthly_D10_minus_D1,
sd_D10_minus_D1 AS sd_monthly_D10_minus_D1,
annualized_D10_minus_D1 AS annualized_arithmetic_mean,
CASE regime WHEN 'OVERALL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END AS regime_order
FROM spreadsum WHERE regime_definition <> 'three_state'""")
body("agg_05_regime_summary", "SELECT * FROM spreadsum2")
body("agg_05_regime_comparison", "SELECT * FROM spreadsum2")
table("icsum", """SELECT model, regime_definition, regime, count(spearman_ic) AS n_months,
avg(spearman_ic) AS mean_spearman, median(spearman_ic) AS median_spearman,
stddev_samp(spearman_ic) AS sd_spearman,
avg(CASE WHEN spearman_ic > 0 THEN 1.0 ELSE 0.0 END) AS fraction_positive
FROM ic_r GROUP BY 1, 2, 3""")
body("agg_21_rank_ic_summary", "SELECT * FROM icsum")
body("agg_21_rank_correlation_summary", """SELECT model, r AS regime,
avg(spearman_ic) AS mean_monthly_spearman_ic, median(spearman_ic) AS median_spearman_ic,
stddev_samp(spearman_ic) AS std_spearman_ic,
avg(CASE WHEN spearman_ic > 0 THEN 1.0 ELSE 0.0 END) AS fraction_months_ic_gt_zero,
count(spearman_ic) AS n_months, avg(pearson_ic) AS mean_monthly_pearson_ic
FROM (SELECT *, 'OVERALL' AS r FROM ic UNION ALL SELECT *, regime AS r FROM ic) GROUP BY 1, 2""")
table("profiles", """SELECT model, weighting, 'overall' AS regime_definition, 'OVERALL' AS regime,
decile, avg(decile_return) AS mean_realized_return, count(*) AS n_months FROM dlong
GROUP BY 1, 2, 5
UNION ALL SELECT model, weighting, 'three_state', regime_3state, decile, avg(decile_return),
count(*) FROM dlong GROUP BY 1, 2, 4, 5""")
body("agg_24_decile_profiles", "SELECT * FROM profiles")
body("agg_25_monotonicity", """SELECT model, weighting, regime_definition, regime,
corr(decile, rk) AS decile_return_spearman,
count(*) FILTER (mean_realized_return > before) AS adjacent_increases, 9 AS adjacent_comparisons
FROM (SELECT *, rank() OVER (PARTITION BY model, weighting, regime_definition, regime
                             ORDER BY mean_realized_return) AS rk,
             lag(mean_realized_return) OVER (PARTITION BY model, weighting, regime_definition,
                             regime ORDER BY decile) AS before FROM profiles)
GROUP BY 1, 2, 3, 4 HAVING count(*) = 10""")
body("jon_18_central_summary", """SELECT s.model, s.weighting, s.regime, s.n_months,
s.mean_D10_minus_D1, s.descriptive_sharpe, i.mean_spearman AS mean_rank_ic
FROM spreadsum s LEFT JOIN icsum i ON i.model = s.model AND i.regime = s.regime
 AND i.regime_definition = 'three_state' WHERE s.regime_definition = 'three_state'""")

body("tc_01_target_weights", "SELECT * FROM held")
body("tc_02_drifted_weights", "SELECT * FROM held")
body("jon_15_aligned_weights", "SELECT * FROM aligned")
body("jon_16_previous_month", "SELECT * FROM aligned WHERE pretrade_weight > 0")
body("tc_03_turnover", "SELECT * FROM turn")
body("tc_04_reconstruction", "SELECT * FROM rebuilt")
body("tc_04_turnover_by_decile",
     "SELECT * REPLACE ('D' || CAST(decile AS VARCHAR) AS decile) FROM turn")
body("tc_04_weight_audit", """SELECT * REPLACE ('D' || CAST(decile AS VARCHAR) AS decile),
abs(target_weight - pretrade_weight) AS absolute_weight_change,
formation_date = (SELECT min(formation_date) FROM held) AS initial_formation
FROM aligned WHERE decile IN (1, 10)""")
body("tc_05_cost_scenarios", "SELECT *, bps AS transaction_cost_bps FROM net")
body("agg_26_turnover_summary", """
SELECT model, weighting, decile, regime_definition, regime, count(*) AS n_months,
  avg(turnover) AS mean_turnover, median(turnover) AS median_turnover,
  stddev_samp(turnover) AS std_turnover, quantile_cont(turnover, 0.25) AS p25,
  quantile_cont(turnover, 0.75) AS p75, quantile_cont(turnover, 0.95) AS p95,
  max(turnover) AS maximum
FROM (SELECT t.*, d.regime_definition, CASE d.regime_definition WHEN 'overall' THEN 'OVERALL'
        WHEN 'binary' THEN t.regime_binary ELSE t.regime_3state END AS regime
      FROM (SELECT model, weighting, 'D' || CAST(decile AS VARCHAR) AS decile, turnover,
              regime_binary, regime_3state FROM turn
            UNION ALL SELECT model, weighting, 'D10-D1', D10_turnover + D1_turnover,
              regime_binary, regime_3state FROM rebuilt) t,
           (VALUES ('overall'), ('binary'), ('three_state')) d(regime_definition))
GROUP BY 1, 2, 3, 4, 5""")
body("agg_27_cost_summary", """
SELECT *, mean_gross_D10_minus_D1 - mean_net_D10_minus_D1 AS cost_attrition,
  CASE WHEN abs(mean_gross_D10_minus_D1) > 1e-10 THEN
    (mean_gross_D10_minus_D1 - mean_net_D10_minus_D1) / abs(mean_gross_D10_minus_D1) END
    AS cost_attrition_ratio
FROM (SELECT model, weighting, regime_definition, regime, bps AS transaction_cost_bps,
  count(*) AS n_months, avg(D10_minus_D1_gross) AS mean_gross_D10_minus_D1,
  avg(long_short_total_turnover) AS mean_total_turnover,
  avg(long_short_cost) AS mean_transaction_cost, avg(D10_minus_D1_net) AS mean_net_D10_minus_D1,
  sqrt(12) * stddev_samp(D10_minus_D1_net) AS annualized_net_volatility,
  sqrt(12) * avg(D10_minus_D1_net) / nullif(stddev_samp(D10_minus_D1_net), 0)
    AS descriptive_net_sharpe,
  avg(CASE WHEN D10_minus_D1_net > 0 THEN 1.0 ELSE 0.0 END) AS fraction_net_positive
  FROM net_r GROUP BY 1, 2, 3, 4, 5)""")
body("agg_27_breakeven", """
SELECT *, breakeven_cost_decimal * 10000 AS breakeven_cost_bps FROM (
SELECT model, weighting, regime_definition, regime, count(*) AS n_months,
  avg(D10_minus_D1_gross) AS mean_gross_spread,
  avg(long_short_total_turnover) AS mean_traded_notional,
  CASE WHEN avg(D10_minus_D1_gross) > 0 AND avg(long_short_total_turnover) > 0
       THEN avg(D10_minus_D1_gross) / avg(long_short_total_turnover) END
    AS breakeven_cost_decimal FROM net_r WHERE bps = 50 GROUP BY 1, 2, 3, 4)""")
body("jon_09_gross_replication", """SELECT 'differences' AS "check", count(*) AS n_rows
FROM rebuilt r FULL OUTER JOIN dwide d ON d.formation_date = r.formation_date
 AND d.model = r.model AND d.weighting = r.weighting
WHERE r.model IS NULL OR d.model IS NULL OR abs(r.D10_minus_D1 - d.D10_minus_D1) > 1e-9
UNION ALL SELECT 'stored', count(*) FROM dwide""")

body("inf_01_hac_means", f"SELECT *, {erfc_p('t_stat')} AS p_value FROM ls_means")
body("inf_02_regime_differences", "SELECT * FROM ls_diffs")


def _means(source: str, name: str) -> str:
    return (f"SELECT *, estimate AS {name}, 6 AS hac_lag, {STARS.format(p='p_value')} "
            f"AS significance FROM (SELECT *, {erfc_p('t_stat')} AS p_value FROM {source})")


body("inf_03_long_short_table", _means("ls_means", "mean_monthly_return"))
body("inf_03_rank_ic_table", _means("ic_means", "mean_spearman_ic"))


def _diffs(source: str) -> str:
    return (f"SELECT *, {STARS.format(p='raw_p_value')} AS raw_significance, "
            f"{STARS.format(p='holm_p_value')} AS adjusted_significance FROM {source}")


body("inf_04_long_short_differences", _diffs("ls_diffs_adj"))
body("inf_04_rank_ic_differences", _diffs("ic_diffs_adj"))
_LSB = hac_mean("(SELECT *, regime_binary AS regime FROM dwide)", "model, weighting, regime",
                "D10_minus_D1")
_ICB = hac_mean("(SELECT *, regime_binary AS regime FROM ic_plain)", "model, regime",
                "spearman_ic")
body("inf_04_binary_inference", f"""
SELECT 'D10_minus_D1' AS outcome, model, weighting, regime, estimate, hac_se, t_stat, n_months
FROM ({_LSB}) UNION ALL
SELECT 'spearman_ic', model, NULL, regime, estimate, hac_se, t_stat, n_months FROM ({_ICB})""")
_LSBD = hac_diff("dwide", "model, weighting", "D10_minus_D1", "regime_binary", [("HIGH", "LOW")])
body("inf_04_binary_differences", f"SELECT *, {erfc_p('t_stat')} AS p_value FROM ({_LSBD})")
_TESTS = """SELECT model, weighting, decile,
avg(decile_return) / (stddev_samp(decile_return) / sqrt(count(*))) AS t
FROM dlong GROUP BY 1, 2, 3"""
body("inf_05_multiple_testing", adjusted(
    f"SELECT model, weighting, decile, {erfc_p('t')} AS p_value FROM ({_TESTS})",
    "model, weighting", "p_value"))

table("extreme_r", """SELECT *, 'OVERALL' AS r FROM extreme
UNION ALL SELECT *, regime FROM extreme""")
_GROSS = hac_mean("extreme_r", "model, weighting, r", "gross", "date")
_NET = hac_mean("extreme_r", "model, weighting, r", "net_return", "date")
body("inf_06_performance", f"""
SELECT g.model, g.weighting, g.r AS regime, n.n_months AS months,
  g.estimate AS gross_mean_monthly, 12 * g.estimate AS gross_annualized_mean,
  g.t_stat AS gross_hac_t, {erfc_p('g.t_stat')} AS gross_p_value,
  x.average_total_turnover, x.average_transaction_cost, n.estimate AS net_mean_monthly,
  12 * n.estimate AS net_annualized_mean, sqrt(12) * x.sd AS net_annualized_volatility,
  sqrt(12) * n.estimate / x.sd AS net_sharpe, n.t_stat AS net_hac_t,
  {erfc_p('n.t_stat')} AS net_p_value, x.net_fraction_positive
FROM ({_GROSS}) g JOIN ({_NET}) n USING (model, weighting, r)
JOIN (SELECT model, weighting, r, avg(total_turnover) AS average_total_turnover,
        avg(cost) AS average_transaction_cost, stddev_samp(net_return) AS sd,
        avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS net_fraction_positive
      FROM extreme_r GROUP BY 1, 2, 3) x USING (model, weighting, r)""")
table("extreme_long", """SELECT model, weighting, 'gross' AS return_type, date, regime, gross AS v
FROM extreme UNION ALL SELECT model, weighting, 'net', date, regime, net_return FROM extreme""")
_LMH = hac_diff("extreme_long", "model, weighting, return_type", "v", "regime",
                [("LOW", "HIGH")], "date")
body("inf_06_regime_tests", f"""SELECT *, right_mean AS high_mean, left_mean AS low_mean,
estimated_difference AS low_minus_high, t_stat AS hac_t, {erfc_p('t_stat')} AS p_value
FROM ({_LMH})""")
_ICW = hac_mean("""(SELECT *, 'OVERALL' AS r FROM ic UNION ALL SELECT *, regime FROM ic)""",
                "model, r", "spearman_ic")
body("inf_06_rank_ic_means", f"""SELECT *, r AS regime, n_months AS months,
estimate AS mean_spearman_ic, t_stat AS hac_t FROM ({_ICW})""")
_ICD = hac_diff("ic", "model", "spearman_ic", "regime", [("LOW", "HIGH")])
body("inf_06_rank_ic_test", f"""SELECT *, right_mean AS high_mean, left_mean AS low_mean,
estimated_difference AS low_minus_high, {erfc_p('t_stat')} AS p_value FROM ({_ICD})""")
body("inf_07_publication_table", """
SELECT 'D10-D1 mean inference' AS panel, model, weighting, regime, NULL AS comparison,
  estimate AS mean_monthly_return, CAST(NULL AS DOUBLE) AS estimated_difference,
  CAST(NULL AS DOUBLE) AS mean_spearman_ic, hac_se, t_stat, n_months FROM ls_means
UNION ALL SELECT 'D10-D1 regime differences', model, weighting, NULL, comparison, NULL,
  estimated_difference, NULL, hac_se, t_stat, n_months FROM ls_diffs
UNION ALL SELECT 'Rank IC mean inference', model, NULL, regime, NULL, NULL, NULL, estimate, hac_se,
  t_stat, n_months FROM ic_means
UNION ALL SELECT 'Rank IC regime differences', model, NULL, NULL, comparison, NULL,
  estimated_difference, NULL, hac_se, t_stat, n_months FROM ic_diffs""")
_NETM = hac_mean("(SELECT * FROM net_r WHERE bps = 50 AND regime_definition <> 'binary')",
                 "model, weighting, regime_definition, regime", "D10_minus_D1_net")
body("inf_07_cost_table", f"""
SELECT c.*, h.hac_se, h.t_stat, {erfc_p('h.t_stat')} AS p_value
FROM (SELECT model, weighting, regime_definition, regime, count(*) AS n_months,
  avg(D10_minus_D1_gross) AS mean_gross_D10_minus_D1,
  avg(long_short_total_turnover) AS mean_total_turnover,
  avg(D10_minus_D1_net) AS mean_net_D10_minus_D1
  FROM net_r WHERE bps = 50 GROUP BY 1, 2, 3, 4) c
JOIN ({_NETM}) h USING (model, weighting, regime_definition, regime)""")
