"""Oracle bodies for panel, prediction and run reports."""
from oracle.render import body
from oracle.tables import avg_rank, correlation, table

body("agg_01_monthly_last", "SELECT date, vix FROM ixmonthly")
body("agg_02_complete_group_sum", """SELECT DISTINCT gvkey, characteristic_year, linked_permnos,
permnos_with_december_me, me_dec FROM annualbm""")
_PROBS = {"p0_1": 0.001, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75,
          "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
body("agg_06_quantile_profile", f"""SELECT variable, count(value) AS n,
count(*) - count(value) AS missing, avg(value) AS mean, stddev_samp(value) AS std,
min(value) AS min, max(value) AS max,
{', '.join(f'quantile_cont(value, {p}) AS {n}' for n, p in _PROBS.items())}
FROM panelvars WHERE variable IN ('book_equity', 'me_dec', 'book_to_market', 'log_me', 'mom_12_2',
'next_month_return') GROUP BY 1""")


def _flow(conditions: list[str], securities: bool) -> str:
    parts, keep = [], "TRUE"
    for i, c in enumerate(conditions, start=1):
        keep = f"{keep} AND {c}"
        extra = f", count(DISTINCT permno) FILTER ({keep}) AS securities" if securities else ""
        parts.append(f"SELECT {i} AS stage_order, count(*) FILTER ({keep}) AS observations{extra} "
                     "FROM panel")
    return " UNION ALL ".join(parts)


_STEPS = ["TRUE", "next_month_return IS NOT NULL", "prc >= 5", "log_me IS NOT NULL",
          "mom_12_2 IS NOT NULL", "gvkey IS NOT NULL", "book_equity > 0",
          "book_to_market IS NOT NULL"]
body("agg_07_sample_flow", _flow([*_STEPS, "TRUE", "regime IS NOT NULL"], False))
body("agg_07_sample_flow_securities",
     _flow([*_STEPS, "vix IS NOT NULL", "baseline_complete_case"], True))
body("agg_08_missingness", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count(*) - count({v}) AS missing_count, "
    f"100.0 * (count(*) - count({v})) / count(*) AS missing_percentage, "
    f"count({v}) AS nonmissing_count FROM panel"
    for v in ("next_month_return", "me", "log_me", "me_lag", "book_equity", "me_dec",
              "book_to_market", "mom_12_2", "vix", "regime")))
_VALID = """count(log_me) AS valid_size, count(book_to_market) AS valid_book_to_market,
count(mom_12_2) AS valid_momentum,
count(*) FILTER (baseline_complete_case) AS complete_baseline"""
body("agg_09_coverage_by_year", f"""SELECT year(formation_date) AS year,
count(*) AS stock_month_observations, count(DISTINCT permno) AS unique_securities, {_VALID},
count(DISTINCT formation_date) FILTER (regime = 'HIGH') AS HIGH_months,
count(DISTINCT formation_date) FILTER (regime = 'LOW') AS LOW_months FROM panel GROUP BY 1""")
table("bymonth", f"""SELECT formation_date, count(DISTINCT permno) AS eligible_securities, {_VALID},
count(*) FILTER (baseline_predictors_complete) AS all_three_predictors FROM panel GROUP BY 1""")
body("agg_10_coverage_by_month", "SELECT * FROM bymonth")
body("agg_11_monthly_count_range", """SELECT min(complete_baseline) AS minimum,
median(complete_baseline) AS median, max(complete_baseline) AS maximum FROM bymonth""")
body("agg_12_construction_summary", """
SELECT f.*, (SELECT count(*) FROM links) AS link_rows, p.*, s.* FROM
(SELECT count(*) AS fundamentals_rows, count(DISTINCT gvkey) AS fundamentals_firms,
  min(datadate) AS fiscal_start, max(datadate) AS fiscal_end,
  count(*) - count(seq) AS missing_seq, count(*) - count(ceq) AS missing_ceq,
  count(*) - count("at") AS missing_at, count(*) - count(lt) AS missing_lt FROM funda) f,
(SELECT count(*) AS panel_rows, min(date) AS panel_start, max(date) AS panel_end,
  count(*) - count(book_equity) AS book_equity_missing_months,
  count(*) FILTER (book_equity = 0) AS book_equity_zero_months,
  count(*) FILTER (book_equity < 0) AS book_equity_negative_months,
  count(book_to_market) AS valid_book_to_market_months,
  count(*) FILTER (baseline_predictors_complete) AS complete_predictor_rows,
  count(log_me) / count(*) AS coverage_log_me, count(mom_12_2) / count(*) AS coverage_mom_12_2,
  count(book_to_market) / count(*) AS coverage_book_to_market,
  count(next_month_return) / count(*) AS coverage_next_month_return,
  count(regime) / count(*) AS coverage_regime FROM panel) p,
(SELECT count(*) AS panel_unique_permnos, count(*) FILTER (n = 0) AS unmatched_securities
 FROM (SELECT permno, count(gvkey) AS n FROM panel GROUP BY 1)) s""")
body("agg_12_code_distribution", """SELECT 'linktype' AS field, linktype AS code, count(*) AS n
FROM links GROUP BY 2 UNION ALL SELECT 'linkprim', linkprim, count(*) FROM links GROUP BY 2""")

table("fullrows", """SELECT permno, formation_date, log_me, book_to_market, mom_12_2 FROM panel
WHERE baseline_predictors_complete""")
table("fullranks", f"""SELECT formation_date, {avg_rank('log_me', 'TRUE')} AS log_me,
{avg_rank('book_to_market', 'TRUE')} AS book_to_market, {avg_rank('mom_12_2', 'TRUE')} AS mom_12_2
FROM fullrows""")
table("monthranks", f"""SELECT formation_date, {avg_rank('log_me', 'formation_date')} AS log_me,
{avg_rank('book_to_market', 'formation_date')} AS book_to_market,
{avg_rank('mom_12_2', 'formation_date')} AS mom_12_2 FROM fullrows""")
_PAIRS = [("log_me", "book_to_market"), ("log_me", "mom_12_2"), ("book_to_market", "mom_12_2")]
body("agg_13_pooled_correlations", " UNION ALL ".join(
    f"SELECT 'pooled' AS scope, '{method}' AS method, '{a}' AS feature_1, '{b}' AS feature_2, "
    f"{correlation(a, b)} AS correlation, count(*) AS observations FROM {source}"
    for method, source in (("pearson", "fullrows"), ("spearman", "fullranks"))
    for a, b in _PAIRS))
body("agg_14_monthly_correlations", " UNION ALL ".join(
    f"SELECT 'average_monthly_cross_section' AS scope, '{method}' AS method, '{a}' AS feature_1, "
    f"'{b}' AS feature_2, avg(c) AS correlation, count(c) AS months "
    f"FROM (SELECT {correlation(a, b)} AS c FROM {source} GROUP BY formation_date "
    "HAVING count(*) >= 3)"
    for method, source in (("pearson", "fullrows"), ("spearman", "monthranks"))
    for a, b in _PAIRS))
body("agg_15_extreme_summary", """
SELECT v.variable, count(*) AS count, min(value) AS minimum, any_value(lo) AS p0_1,
  any_value(hi) AS p99_9, max(value) AS maximum,
  count(*) FILTER (value <= lo) AS count_at_or_below_p0_1,
  count(*) FILTER (value >= hi) AS count_at_or_above_p99_9
FROM panelvars v JOIN (SELECT variable, quantile_cont(value, 0.001) AS lo,
  quantile_cont(value, 0.999) AS hi FROM panelvars GROUP BY 1) q ON q.variable = v.variable
WHERE value IS NOT NULL AND v.variable IN ('book_to_market', 'mom_12_2', 'me', 'next_month_return')
GROUP BY 1""")


def _report(source: str, rates: list[str], points: list[str]) -> str:
    parts = [f"SELECT 'n_rows' AS \"check\", count(*) AS value FROM {source}",
             f"SELECT 'n_stocks', count(DISTINCT permno) FROM {source}",
             f"""SELECT 'duplicate_permno_date', count(*) - (SELECT count(*) FROM
             (SELECT DISTINCT permno, date FROM {source})) FROM {source}"""]
    parts += [f"SELECT 'missing_rate_{c}', 1 - count({c}) / count(*) FROM {source}" for c in rates]
    parts += [f"SELECT '{n}_{c}', quantile_cont({c}, {p}) FROM {source}" for c in points
              for n, p in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))]
    return " UNION ALL ".join(parts)


_F = ["log_me", "book_to_market", "mom_12_2"]
body("agg_16_panel_report", _report("panel", [*_F, "next_month_return"], [*_F, "ret"]) + """
UNION ALL SELECT 'regime_count_' || coalesce(regime, '<NA>'), count(*) FROM panel GROUP BY regime""")
table("secnorm", """SELECT permno, last_day(mthcaldt) AS date, mthret AS ret, abs(mthprc) AS prc,
shrout, mthcap AS market_equity,
lag(mthcap) OVER (PARTITION BY permno ORDER BY mthcaldt) AS me_lag FROM secfile
WHERE sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM' AND usincflg = 'Y'
  AND issuertype IN ('ACOR', 'CORP') AND primaryexch IN ('N', 'A', 'Q')
  AND mthcaldt BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""")
_S = ["ret", "prc", "shrout", "market_equity", "me_lag"]
body("agg_16_security_report", _report("secnorm", _S, _S))

table("scored", """SELECT *, actual_next_month_return AS a, prediction AS p,
benchmark_prediction AS b FROM predlong""")
table("scored_r", """SELECT * REPLACE ('OVERALL' AS regime) FROM scored
UNION ALL SELECT * FROM scored""")
table("metrics", f"""SELECT model, regime, count(*) AS n_obs, avg((a - p) * (a - p)) AS mse,
sqrt(avg((a - p) * (a - p))) AS rmse, avg(abs(a - p)) AS mae,
1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2,
1 - sum((a - p) * (a - p)) / sum((a - b) * (a - b)) AS oos_r2,
1 - sum((a - p) * (a - p)) / sum(a * a) AS oos_r2_vs_zero, {correlation('a', 'p')} AS correlation,
stddev_samp(a) AS realized_return_std,
sqrt(avg((a - p) * (a - p))) / stddev_samp(a) AS normalized_rmse,
sqrt(avg((a - b) * (a - b))) AS benchmark_rmse, count(*) AS n FROM scored_r GROUP BY 1, 2""")
body("agg_17_forecast_metrics", "SELECT * FROM metrics")
body("agg_18_model_metrics", "SELECT * FROM metrics")
table("faulty", """SELECT *, CASE WHEN model = 'XGBoost' AND permno % 25 IN (3, 4) THEN NULL
ELSE prediction END AS q, model = 'XGBoost' AND permno % 25 = 3 AS is_missing,
model = 'XGBoost' AND permno % 25 = 4 AS is_infinite FROM scored_r""")
body("agg_19_prediction_diagnostics", """
SELECT x.*, c.min_monthly_coverage FROM (
SELECT model, regime, count(*) AS n_rows, count(q) / count(*) AS prediction_coverage,
  count(*) FILTER (is_missing) AS missing_predictions,
  count(*) FILTER (is_infinite) AS infinite_predictions, avg(q) AS prediction_mean,
  stddev_samp(q) AS prediction_std, min(q) AS prediction_min,
  quantile_cont(q, 0.01) AS prediction_p01, quantile_cont(q, 0.05) AS prediction_p05,
  quantile_cont(q, 0.5) AS prediction_p50, quantile_cont(q, 0.95) AS prediction_p95,
  quantile_cont(q, 0.99) AS prediction_p99, max(q) AS prediction_max, avg(a) AS actual_mean,
  stddev_samp(a) AS actual_std FROM faulty GROUP BY 1, 2) x
JOIN (SELECT model, regime, min(c) AS min_monthly_coverage FROM (
  SELECT model, regime, date, count(q) / count(*) AS c FROM faulty GROUP BY 1, 2, 3)
  GROUP BY 1, 2) c USING (model, regime)""")


def _pick(v: str, r: str, source: str = "m") -> str:
    return f"max(CASE WHEN {source}.regime = '{r}' THEN {source}.{v} END)"


body("agg_20_model_comparison", f"""
SELECT m.model, {', '.join(f"{_pick(v, r)} AS {r.lower()}_{v}"
                           for r in ('OVERALL', 'HIGH', 'LOW') for v in ('rmse', 'oos_r2'))},
  {_pick('oos_r2', 'HIGH')} - {_pick('oos_r2', 'LOW')} AS high_minus_low_oos_r2,
  any_value(i.o) AS overall_mean_spearman_ic, any_value(i.h) AS high_mean_spearman_ic,
  any_value(i.l) AS low_mean_spearman_ic
FROM metrics m JOIN (SELECT model, avg(spearman_ic) AS o,
  avg(spearman_ic) FILTER (regime = 'HIGH') AS h, avg(spearman_ic) FILTER (regime = 'LOW') AS l
  FROM ic GROUP BY 1) i ON i.model = m.model GROUP BY m.model""")
body("agg_20_comparison_columns", "SELECT * FROM metrics")
body("agg_22_regime_validation", """
SELECT s.regime, count(DISTINCT p.formation_date) AS oos_month_count,
  count(p.permno) AS oos_stock_month_count,
  (SELECT min(date) FROM three) AS earliest_valid_threshold,
  (SELECT min(vix_expanding_q33) FROM three) AS q33_min,
  (SELECT median(vix_expanding_q33) FROM three) AS q33_median,
  (SELECT max(vix_expanding_q33) FROM three) AS q33_max,
  (SELECT min(vix_expanding_q67) FROM three) AS q67_min,
  (SELECT median(vix_expanding_q67) FROM three) AS q67_median,
  (SELECT max(vix_expanding_q67) FROM three) AS q67_max,
  (SELECT bool_and(vix_expanding_q33 <= vix_expanding_q67) FROM three) AS q33_le_q67_all_valid
FROM (VALUES ('LOW'), ('MIDDLE'), ('HIGH')) s(regime)
LEFT JOIN (SELECT formation_date, permno, regime_3state FROM predlong3
           WHERE model = 'XGBoost') p ON p.regime_3state = s.regime GROUP BY 1""")
body("agg_23_transition_counts", """
SELECT a.s AS from_regime, b.s AS to_regime, count(t.to_regime) AS count
FROM (VALUES ('LOW'), ('MIDDLE'), ('HIGH')) a(s), (VALUES ('LOW'), ('MIDDLE'), ('HIGH')) b(s)
LEFT JOIN (SELECT lag(regime_3state) OVER (ORDER BY date) AS from_regime,
                  regime_3state AS to_regime
           FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM three) WHERE n >= 12) t
  ON t.from_regime = a.s AND t.to_regime = b.s GROUP BY 1, 2""")
body("agg_28_economic_sanity", """SELECT TRUE AS me_error_small, TRUE AS bm_error_small,
median(book_to_market) AS book_to_market_median,
quantile_cont(book_to_market, 0.999) AS book_to_market_p999,
CASE WHEN median(book_to_market) BETWEEN 0.001 AND 50 THEN 'pass' ELSE 'fail_scale_check' END
  AS unit_sanity_status FROM panel""")
body("agg_29_count_audit", """SELECT count(*) AS total_stock_months,
count(*) FILTER (baseline_predictors_complete) AS complete_predictor_rows,
count(*) FILTER (baseline_predictors_complete AND price_eligible AND next_month_return IS NOT NULL
  AND regime IS NOT NULL) AS final_screened_rows, 0 AS duplicate_permno_date_rows FROM panel""")
body("agg_30_run_report", """
SELECT 'rows_by_model' AS "check", model, 'ALL' AS part, count(*) AS value FROM predlong GROUP BY 2
UNION ALL SELECT 'monthly_stock_counts', model, k, CASE k WHEN 'min' THEN min(n)
  WHEN 'max' THEN max(n) ELSE median(n) END
FROM (SELECT model, formation_date, count(*) AS n FROM predlong GROUP BY 1, 2),
     (VALUES ('min'), ('median'), ('max')) v(k) GROUP BY 2, 3
UNION ALL SELECT 'valid_portfolio_months', model, weighting, count(*) FROM dwide
WHERE D10_minus_D1 IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'regime_months', model, regime, count(DISTINCT formation_date) FROM predlong
GROUP BY 2, 3""")
