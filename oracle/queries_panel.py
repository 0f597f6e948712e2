"""Oracle bodies for features, accounting, joins, windows, sorts, sets and contracts."""
from oracle.render import body
from oracle.tables import avg_rank, table

body("fea_01_monthly_features", "SELECT * FROM features")
body("fea_02_annual_accounting", "SELECT * FROM annual")
body("fea_02_annual_audit", """
SELECT (SELECT count(*) FROM booked) AS annual_rows_input,
  (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM booked
     GROUP BY gvkey, year(datadate) HAVING count(*) > 1)) AS duplicate_firm_year_rows,
  (SELECT count(*) FROM booked) - count(*) AS duplicate_firm_year_rows_removed,
  count(*) FILTER (book_equity > 0) AS annual_book_equity_valid,
  count(*) FILTER (book_equity IS NULL) AS annual_book_equity_missing,
  count(*) FILTER (book_equity = 0) AS annual_book_equity_zero,
  count(*) FILTER (book_equity < 0) AS annual_book_equity_negative FROM annual""")
body("fea_03_december_equity", "SELECT * FROM december")
body("fea_04_book_to_market", "SELECT * FROM annualbm")
body("fea_05_panel_build", "SELECT * FROM panel")
body("reg_01_binary_regimes", "SELECT * FROM regimes")
body("reg_02_index_from_panel",
     "SELECT formation_date AS date, max(vix) AS vix FROM panel WHERE vix IS NOT NULL GROUP BY 1")
body("reg_03_attach_three_state", """SELECT p.permno, p.formation_date, t.regime_binary,
t.regime_3state, t.vix_expanding_q33, t.vix_expanding_q67
FROM preds p JOIN three t ON t.date = p.formation_date""")

_UNIVERSE = """b.sharetype = 'NS' AND b.securitytype = 'EQTY' AND b.securitysubtype = 'COM'
  AND b.usincflg = 'Y' AND b.issuertype IN ('ACOR', 'CORP') AND b.primaryexch IN ('N', 'A', 'Q')
  AND b.conditionaltype = 'RW' AND b.tradingstatusflg = 'A'"""
body("jon_01_interval_join", f"""SELECT a.permno, a.mthcaldt AS date, b.ticker, a.mthret AS ret,
a.mthprc AS prc, b.primaryexch, b.issuertype FROM secfile a JOIN secinfo b
ON a.permno = b.permno AND a.mthcaldt BETWEEN b.secinfostartdt AND b.secinfoenddt
WHERE a.mthcaldt BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND {_UNIVERSE}""")
body("jon_02_legacy_interval_join", """SELECT a.permno, a.date, b.ticker, abs(a.prc) AS prc,
abs(a.prc) * a.shrout AS market_equity, b.exchcd, b.shrcd FROM prices a JOIN names b
ON a.permno = b.permno AND b.namedt <= a.date AND a.date <= b.nameendt
WHERE a.date BETWEEN DATE '1992-01-01' AND DATE '2001-12-31'
  AND b.shrcd IN (10, 11) AND b.exchcd IN (1, 2, 3)""")
body("jon_03_link_interval_join", "SELECT * FROM linked")
body("jon_03_link_audit", """
SELECT (SELECT count(*) FROM annual) AS accounting_rows,
  (SELECT count(*) FROM (SELECT DISTINCT gvkey, characteristic_year FROM linked))
    AS accounting_rows_with_valid_ccm,
  (SELECT count(*) FROM annual)
    - (SELECT count(*) FROM (SELECT DISTINCT gvkey, characteristic_year FROM linked))
    AS accounting_rows_unmatched_ccm,
  (SELECT count(*) FROM links) AS ccm_rows_input,
  (SELECT count(*) FROM goodlinks) AS ccm_rows_retained,
  (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM validlinks
     GROUP BY gvkey, characteristic_year, permno HAVING count(*) > 1))
    AS duplicate_ccm_rows_detected,
  (SELECT count(*) FROM validlinks) - (SELECT count(*) FROM pairs)
    AS duplicate_ccm_rows_resolved,
  (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM pairs
     GROUP BY permno, characteristic_year HAVING count(*) > 1))
    AS permno_year_gvkey_conflict_rows,
  (SELECT count(*) FROM pairs) - (SELECT count(*) FROM linked)
    AS permno_year_gvkey_conflicts_resolved""")
body("jon_04_regime_attach", """SELECT f.permno, f.date, r.vix, r.regime
FROM features f LEFT JOIN regimes r ON r.date = f.date""")
body("jon_05_december_join", """SELECT l.permno, l.characteristic_year, l.gvkey, d.me_dec_security
FROM linked l LEFT JOIN december d
  ON d.permno = l.permno AND d.december_year = l.characteristic_year - 1""")
body("jon_06_firm_totals", """
SELECT g.gvkey, f.date, f.permno, g.firm_me, g.n_classes, f.market_equity / g.firm_me AS share
FROM features f JOIN (SELECT lpad(CAST((permno - 10000) // 2 AS VARCHAR), 6, '0') AS gvkey, date,
  sum(market_equity) AS firm_me, count(*) AS n_classes FROM features GROUP BY 1, 2) g
ON g.date = f.date AND g.gvkey = lpad(CAST((f.permno - 10000) // 2 AS VARCHAR), 6, '0')""")
body("jon_07_june_assignment", "SELECT *, she_source AS stockholders_equity_source FROM assigned")

table("groupdiag", """
SELECT *, CASE WHEN n_valid_predictions < 10 THEN 'fewer_than_10_valid_predictions'
  WHEN n_unique_predictions < 10 THEN 'fewer_than_10_distinct_predictions'
  WHEN prediction_range <= range_tolerance THEN 'near_constant_predictions'
  ELSE 'sortable' END AS prediction_status
FROM (SELECT formation_date, model, count(DISTINCT permno) AS n_stocks,
  count(prediction) AS n_valid_predictions, count(DISTINCT prediction) AS n_unique_predictions,
  max(prediction) - min(prediction) AS prediction_range,
  1e-12 + 1e-10 * greatest(1.0, abs(min(prediction)), abs(max(prediction))) AS range_tolerance
  FROM predlong GROUP BY 1, 2)""")
body("jon_08_attach_diagnostics", """SELECT p.permno, p.formation_date, p.model,
g.n_unique_predictions, g.prediction_range, g.prediction_status
FROM predlong p JOIN groupdiag g USING (formation_date, model)""")
body("jon_09_reconciliation", """
SELECT formation_date, model, weighting,
  CASE WHEN formation_date = DATE '1999-03-31' THEN 'left_only' ELSE 'both' END AS found_in,
  TRUE AS differs FROM dwide
WHERE formation_date IN (DATE '1999-03-31', DATE '2000-05-31')""")
body("jon_10_reference_series", """
SELECT date AS formation_date, vix, regime, TRUE AS differs_from_reference FROM regimes
WHERE month(date) = 4 AND date IN (SELECT formation_date FROM panel)""")
body("jon_11_transition_grid", """
SELECT a.s AS from_regime, b.s AS to_regime, count(t.to_regime) AS count
FROM (VALUES ('LOW'), ('MIDDLE'), ('HIGH')) a(s), (VALUES ('LOW'), ('MIDDLE'), ('HIGH')) b(s)
LEFT JOIN (SELECT lag(regime_3state) OVER (ORDER BY date) AS from_regime,
                  regime_3state AS to_regime FROM three) t
  ON t.from_regime = a.s AND t.to_regime = b.s GROUP BY 1, 2""")


def _top(day: str, n: int, extra: str = "") -> str:
    return f"""(SELECT permno FROM features WHERE date = DATE '{day}' {extra}
ORDER BY market_equity DESC NULLS LAST, permno LIMIT {n})"""


body("jon_12_semi_join", f"""SELECT permno, date, market_equity FROM features
WHERE permno IN {_top('1998-01-31', 50)}""")
body("jon_13_semi_join_or", f"""SELECT permno, date, ticker FROM features
WHERE permno IN {_top('1998-01-31', 30, 'AND abs(prc) >= 5')} OR upper(ticker) = 'T10007'""")
body("jon_14_anti_join", """SELECT gvkey, characteristic_year FROM annual a
WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.gvkey = a.gvkey
                  AND l.characteristic_year = a.characteristic_year)""")
body("jon_17_lookup_with_default", """
SELECT s.permno, s.formation_date, coalesce(
  (SELECT avg(t.next_month_return) FROM sample t
   WHERE t.permno = s.permno AND t.formation_date < DATE '1999-01-01'),
  (SELECT avg(t.next_month_return) FROM sample t WHERE t.formation_date < DATE '1999-01-01'))
  AS benchmark_prediction FROM sample s WHERE s.formation_date >= DATE '1999-01-01'""")
body("jon_18_report_merge", """
SELECT p.year, p.rows, r.high_months, r.low_months
FROM (SELECT year(formation_date) AS year, count(*) AS rows FROM panel GROUP BY 1) p
LEFT JOIN (SELECT year(date) AS year, count(*) FILTER (regime = 'HIGH') AS high_months,
           count(*) FILTER (regime = 'LOW') AS low_months FROM regimes GROUP BY 1) r
  ON r.year = p.year""")

table("folds", """
WITH months AS (SELECT formation_date, row_number() OVER (ORDER BY formation_date) - 1 AS i,
                       count(*) OVER () AS m
                FROM (SELECT DISTINCT formation_date FROM sample)),
bounds AS (SELECT DISTINCT CAST(floor(24 + j * ((m - 1 - 24) / 4.0)) AS BIGINT) AS b
           FROM (SELECT DISTINCT m FROM months), range(0, 5) r(j))
SELECT row_number() OVER (ORDER BY formation_date) AS fold, formation_date AS validation_month,
       i AS train_months FROM months JOIN bounds ON bounds.b = months.i WHERE m > 24""")
body("jon_19_parameter_grid", """SELECT f.*, a.alpha, r.l1_ratio FROM folds f,
(VALUES (0.0001), (0.001), (0.01), (0.1)) a(alpha), (VALUES (0.1), (0.5), (0.9)) r(l1_ratio)""")

body("win_01_calendar_lead_lag", "SELECT permno, date, next_month_return, me_lag FROM features")
body("win_02_momentum", "SELECT permno, date, mom_12_2 FROM features")
body("win_03_expanding_median", "SELECT date, vix_expanding_median FROM regimes")
body("win_04_expanding_terciles", """
SELECT date, CASE WHEN n >= 6 THEN vix_expanding_median END AS vix_expanding_median,
  CASE WHEN n >= 6 THEN vix_expanding_q33 END AS vix_expanding_q33,
  CASE WHEN n >= 6 THEN vix_expanding_q67 END AS vix_expanding_q67,
  CASE WHEN n >= 6 THEN regime_binary END AS regime_binary,
  CASE WHEN n >= 6 THEN regime_3state END AS regime_3state
FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM three)""")
body("win_05_row_lag", """SELECT permno, date,
lag(market_equity) OVER (PARTITION BY permno ORDER BY date) AS previous_row_me
FROM features WHERE month(date) <> 7""")
body("win_06_average_rank", f"""SELECT permno, formation_date, model,
{avg_rank('prediction', 'formation_date, model')} AS avg_rank,
{avg_rank('prediction', 'formation_date, model')}
  / count(*) OVER (PARTITION BY formation_date, model) AS pct_rank FROM predlong""")
body("win_07_deciles", """SELECT permno, formation_date, model,
CASE WHEN n >= 10 THEN floor((rn - 1) * 10 / n) + 1 END AS decile,
CASE WHEN n >= 10 THEN 'assigned' ELSE 'insufficient_securities' END AS decile_status FROM ranked""")
body("win_08_tie_preserving_deciles", "SELECT permno, formation_date, model, portfolio FROM tied")
body("win_09_priority_dedup", "SELECT * FROM pairs")
body("win_10_keep_last", "SELECT gvkey, datadate, fyear, accounting_year FROM annual")
body("win_11_keep_last_per_date", "SELECT date, vix FROM ixmonthly")
body("win_12_standardize", """SELECT permno, date,
(log_me - avg(log_me) OVER d) / nullif(stddev_samp(log_me) OVER d, 0) AS log_me_z,
(mom_12_2 - avg(mom_12_2) OVER d) / nullif(stddev_samp(mom_12_2) OVER d, 0) AS mom_12_2_z
FROM features WINDOW d AS (PARTITION BY date)""")
body("win_13_winsorize", """SELECT f.permno, f.date,
CASE WHEN log_me IS NOT NULL THEN least(greatest(log_me, a), b) END AS log_me,
CASE WHEN mom_12_2 IS NOT NULL THEN least(greatest(mom_12_2, c), d) END AS mom_12_2
FROM features f JOIN (SELECT date, quantile_cont(log_me, 0.05) AS a,
  quantile_cont(log_me, 0.95) AS b, quantile_cont(mom_12_2, 0.05) AS c,
  quantile_cont(mom_12_2, 0.95) AS d FROM features GROUP BY 1) q ON q.date = f.date""")
body("win_14_rolling_rmse", """SELECT model, date, rmse,
CASE WHEN count(*) OVER w >= 3 THEN avg(rmse) OVER w END AS rolling_rmse
FROM (SELECT model, date, sqrt(avg((actual_next_month_return - prediction)
        * (actual_next_month_return - prediction))) AS rmse FROM predlong GROUP BY 1, 2)
WINDOW w AS (PARTITION BY model ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
body("win_15_cumulative_return", """SELECT formation_date, model, weighting,
sum(CASE WHEN month(formation_date) = 2 THEN 0 ELSE D10_minus_D1 END)
  OVER (PARTITION BY model, weighting ORDER BY formation_date) AS cumulative_return FROM dwide""")
body("win_16_previous_state", """SELECT date, regime_3state,
lag(regime_3state) OVER (ORDER BY date) AS from_regime FROM three""")
body("win_17_month_gaps", """SELECT permno, date, step AS months_since_previous FROM (
SELECT permno, date, mi - lag(mi) OVER (PARTITION BY permno ORDER BY mi) AS step FROM lots2)
WHERE step > 1""")
body("win_18_adjacent_increases", """SELECT model, weighting, count(*) FILTER (up) AS n_increases
FROM (SELECT model, weighting, D10_minus_D1 > lag(D10_minus_D1) OVER (
  PARTITION BY model, weighting ORDER BY formation_date) AS up FROM dwide) GROUP BY 1, 2""")
body("win_19_pooled_benchmark", """
SELECT m.formation_date, (SELECT avg(s.next_month_return) FROM sample s
  WHERE s.formation_date < m.formation_date) AS benchmark_prediction
FROM (SELECT DISTINCT formation_date FROM sample) m""")
body("win_20_stock_benchmark", """
SELECT s.permno, s.formation_date, coalesce(
  avg(next_month_return) OVER (PARTITION BY permno ORDER BY formation_date
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  (SELECT avg(t.next_month_return) FROM sample t WHERE t.formation_date < s.formation_date))
  AS benchmark_prediction FROM sample s""")

body("srt_01_fixed_universe", f"SELECT permno FROM {_top('1997-06-30', 25)}")
body("srt_02_top_n_history", f"""SELECT permno, date, market_equity FROM features
WHERE permno IN {_top('1999-12-31', 20)}""")
body("srt_03_tail_audit", """
SELECT v.variable AS audit_variable, v.tail, v.tail_rank, v.permno, v.formation_date,
       p.book_to_market, p.me, p.ticker
FROM (SELECT *, 'low' AS tail, row_number() OVER (PARTITION BY variable
        ORDER BY value, permno, formation_date) AS tail_rank FROM panelvars
      WHERE value IS NOT NULL
        AND variable IN ('book_to_market', 'mom_12_2', 'me', 'next_month_return')
      UNION ALL
      SELECT *, 'high', row_number() OVER (PARTITION BY variable
        ORDER BY value DESC, permno, formation_date) FROM panelvars
      WHERE value IS NOT NULL
        AND variable IN ('book_to_market', 'mom_12_2', 'me', 'next_month_return')) v
JOIN panel p ON p.permno = v.permno AND p.formation_date = v.formation_date
WHERE v.tail_rank <= 10""")
body("srt_04_row_limit", f"""SELECT permno, mthcaldt AS date, mthprc AS prc FROM secfile b
WHERE mthcaldt BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND {_UNIVERSE}
ORDER BY mthcaldt, permno LIMIT 40""")
body("srt_05_monthly_sample", """SELECT permno, formation_date, next_month_return FROM sample
QUALIFY row_number() OVER (PARTITION BY formation_date
  ORDER BY md5(permno || '|' || formation_date || '|42'), permno) <= 20""")
body("srt_05_sample_sizes", """SELECT formation_date, least(20, count(*)) AS n_rows FROM sample
GROUP BY 1""")
body("srt_06_sorted_output",
     "SELECT formation_date, model, weighting, D10_minus_D1 FROM dwide")

body("set_01_union_all", """SELECT permno, formation_date, 'sample' AS source FROM sample
UNION ALL SELECT permno, formation_date, 'predictions' FROM preds""")
body("set_02_union_missing_columns", """
SELECT 'spread' AS panel, model, weighting, formation_date, D10_minus_D1,
       CAST(NULL AS DOUBLE) AS spearman_ic FROM dwide
UNION ALL SELECT 'rank_ic', model, NULL, formation_date, NULL, spearman_ic FROM ic""")
body("set_03_distinct_months", "SELECT DISTINCT formation_date, regime_3state FROM predlong3")
body("set_04_domain_difference", """
SELECT DISTINCT gvkey, 'left_only' AS found_in FROM annual
WHERE gvkey NOT IN (SELECT gvkey FROM goodlinks)
UNION ALL SELECT DISTINCT gvkey, 'right_only' FROM goodlinks
WHERE gvkey NOT IN (SELECT gvkey FROM annual)""")
body("set_05_duplicate_counts", """SELECT gvkey, year(datadate) AS year, count(*) AS n_rows,
count(*) - 1 AS excess FROM funda GROUP BY 1, 2 HAVING count(*) > 1""")
body("set_06_models_to_rows", "SELECT permno, formation_date, model, prediction FROM predlong")
body("set_07_models_to_columns", "SELECT * FROM preds")
body("set_08_deciles_to_columns", "SELECT * FROM dwide")
body("set_09_long_short", "SELECT *, D10 AS D10_return, D1 AS D1_return FROM dwide")
body("set_10_prediction_export", """SELECT formation_date, permno, model, prediction,
CAST(NULL AS DATE) AS value_weight_date, me_lag,
last_day(formation_date - INTERVAL 1 MONTH) AS train_feature_end_date FROM predlong""")

table("broken", """
SELECT * REPLACE (
  CASE WHEN permno % 31 = 1 AND hit THEN last_day(realized_return_date + INTERVAL 1 MONTH)
       ELSE realized_return_date END AS realized_return_date,
  CASE WHEN permno % 29 = 2 AND hit THEN me * CAST(1.01 AS DOUBLE) ELSE me END AS me,
  CASE WHEN permno % 23 = 3 AND hit THEN log_me + 0.5 ELSE log_me END AS log_me,
  CASE WHEN permno % 19 = 4 AND hit THEN book_to_market * 2.0 ELSE book_to_market END
    AS book_to_market,
  CASE WHEN permno % 17 = 5 AND hit THEN make_date(year(formation_date) + 1, 6, 30)
       ELSE accounting_eligibility_date END AS accounting_eligibility_date,
  CASE WHEN permno % 13 = 6 AND hit THEN NOT price_eligible ELSE price_eligible END
    AS price_eligible,
  CASE WHEN permno = 10007 AND hit THEN 'HIGH' ELSE regime END AS regime,
  CASE WHEN permno % 11 = 7 AND hit THEN last_day(date + INTERVAL 1 MONTH) ELSE date END AS date)
FROM (SELECT *, month(formation_date) = 9 AS hit FROM panel)""")

body("dq_01_required_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", TRUE AS present, count(*) AS n_rows, count({c}) AS n_values "
    "FROM panel" for c in ("permno", "formation_date", "realized_return_date", "log_me",
                           "book_to_market", "mom_12_2", "next_month_return"))
    + " UNION ALL SELECT 'log_me_z', FALSE, count(*), 0 FROM panel")
body("dq_02_unique_key", """SELECT permno, date, 2 AS n_rows FROM prices WHERE permno % 10 = 3""")
body("dq_03_target_date", """SELECT permno, formation_date, realized_return_date FROM broken
WHERE realized_return_date <> last_day(formation_date + INTERVAL 1 MONTH)""")
body("dq_04_size_identity", """SELECT * FROM (SELECT permno, formation_date,
coalesce(abs(me - abs(prc) * shrout) > greatest(1e-8, abs(prc) * shrout * 1e-10), FALSE) AS bad_me,
coalesce(me <= 0 AND log_me IS NOT NULL, FALSE) AS bad_nonpositive,
coalesce(me > 0 AND abs(log_me - ln(me)) > 1e-10 + 1e-10 * abs(ln(me)), FALSE) AS bad_log
FROM broken) WHERE bad_me OR bad_nonpositive OR bad_log""")
body("dq_05_book_to_market", """SELECT permno, formation_date, book_to_market FROM broken
WHERE book_to_market IS NOT NULL AND NOT coalesce(book_equity > 0 AND me_dec > 0
  AND abs(book_to_market - book_equity / me_dec)
      <= 1e-12 + 1e-9 * abs(book_equity / me_dec), FALSE)""")
body("dq_05_median_range", """SELECT median(book_to_market) AS median,
median(book_to_market) BETWEEN 0.001 AND 50 AS in_range FROM panel""")
body("dq_06_accounting_timing", """SELECT permno, formation_date, accounting_eligibility_date
FROM broken WHERE last_day(accounting_eligibility_date) > formation_date
OR (accounting_datadate IS NOT NULL AND (characteristic_year IS DISTINCT FROM
  (CASE WHEN month(formation_date) >= 6 THEN year(formation_date)
        ELSE year(formation_date) - 1 END)
  OR year(accounting_datadate) IS DISTINCT FROM characteristic_year - 1))""")
body("dq_07_price_flag", """SELECT permno, formation_date, prc, price_eligible FROM broken
WHERE price_eligible <> (abs(prc) >= 5)""")
body("dq_08_regime_constancy", """SELECT formation_date, TRUE AS not_constant FROM (
SELECT formation_date, count(DISTINCT regime) + max(CASE WHEN regime IS NULL THEN 1 ELSE 0 END) AS n
FROM broken GROUP BY 1) WHERE n > 1""")
body("dq_09_leakage", """SELECT permno, formation_date FROM preds
WHERE (permno % 41 = 1 AND month(formation_date) = 5)
   OR (permno % 43 = 2 AND month(formation_date) = 6)""")

table("badassign", """
SELECT * REPLACE (
  CASE WHEN formation_date = DATE '2000-02-29' AND decile = 4 THEN 5
       WHEN formation_date = DATE '1998-07-31' AND permno % 10 = 1 THEN 11 ELSE decile END
    AS decile,
  CASE WHEN formation_date = DATE '1997-03-31' AND permno % 10 = 2 THEN NULL
       ELSE realized_next_month_return END AS realized_next_month_return)
FROM assign WHERE NOT (formation_date = DATE '1999-04-30' AND model = 'XGBoost')""")
body("dq_10_decile_months", """SELECT formation_date, model, n AS n_deciles FROM (
SELECT formation_date, model, count(DISTINCT decile) AS n, min(decile) AS lo, max(decile) AS hi
FROM badassign GROUP BY 1, 2) WHERE n <> 10 OR lo <> 1 OR hi <> 10""")
body("dq_10_spread_arithmetic", """SELECT 'changed' AS "check", count(*) AS n_rows FROM dwide
WHERE month(formation_date) = 10 UNION ALL SELECT 'original', 0""")
body("dq_11_assignment_contract", """
SELECT 'rows' AS "check", count(*) AS n_rows FROM badassign
WHERE decile NOT BETWEEN 1 AND 10 OR realized_next_month_return IS NULL
UNION ALL SELECT 'gaps', count(*) FROM (SELECT year(formation_date) * 12 + month(formation_date)
  - lag(year(formation_date) * 12 + month(formation_date)) OVER (PARTITION BY model
    ORDER BY formation_date) AS step
  FROM (SELECT DISTINCT model, formation_date FROM badassign)) WHERE step <> 1
UNION ALL SELECT 'models', count(*) FROM (SELECT formation_date FROM badassign
  GROUP BY 1 HAVING count(DISTINCT model) < 2)
UNION ALL SELECT 'months', 0 UNION ALL SELECT 'keys', 0""")
body("dq_12_weights", """SELECT formation_date, model, weighting, decile,
sum(target_weight) * 1.5 AS total FROM held WHERE month(formation_date) = 11 GROUP BY 1, 2, 3, 4""")
body("dq_13_summary_consistency", """SELECT DISTINCT model, weighting, regime_definition, regime
FROM dwide_r WHERE regime = 'HIGH'""")
body("dq_14_value_weight_date", """SELECT permno, formation_date, formation_date AS me_lag_date
FROM preds WHERE permno % 37 = 3 AND month(formation_date) = 8""")
body("dq_15_table_fingerprint",
     "SELECT 'prices' AS \"table\", count(*) AS n_rows, TRUE AS same_content FROM prices")
_PRICE_PARTS = ("permno", "ticker", "date", "CAST(floor(shrout) AS BIGINT)",
                "CAST(floor(prc * 1000) AS BIGINT)", "CAST(floor(ret * 1000) AS BIGINT)")
_PRICE_DIGEST = " || '|' || ".join(
    f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"
    for e in _PRICE_PARTS)


def _digest_sum(begin: int) -> str:
    return (f"CAST(sum(CAST(CAST('0x' || substr(h, {begin}, 12) AS BIGINT) AS HUGEINT)) "
            f"% 9007199254740992 AS BIGINT)")


def _price_nodes(level: int) -> str:
    size = 16 * 8 ** level
    if level == 3:
        node, first, last, keys = "0", "min(permno) // 16 * 16", "max(permno) // 16 * 16 + 15", ""
    else:
        node = f"permno // {size}"
        first, last, keys = f"permno // {size} * {size}", f"permno // {size} * {size} + {size - 1}", \
            f"GROUP BY permno // {size}"
    return f"""SELECT {level} AS level, {node} AS node, {first} AS first_key, {last} AS last_key,
count(*) AS n_rows, {_digest_sum(1)} AS low, {_digest_sum(13)} AS high FROM digests {keys}"""


body("dq_15_fingerprint_nodes", f"""WITH digests AS
(SELECT permno, md5({_PRICE_DIGEST}) AS h FROM prices) """
     + " UNION ALL ".join(_price_nodes(level) for level in range(4)))


def _changed_nodes(level: int) -> str:
    size = 16 * 8 ** level
    if level == 3:
        return """SELECT 3 AS level, 0 AS node, min(permno) // 16 * 16 AS first_key,
max(permno) // 16 * 16 + 15 AS last_key, count(*) AS n_left,
count(*) FILTER (NOT missing) AS n_right FROM marked HAVING bool_or(corrected OR missing)"""
    return f"""SELECT {level} AS level, permno // {size} AS node,
permno // {size} * {size} AS first_key, permno // {size} * {size} + {size - 1} AS last_key,
count(*) AS n_left, count(*) FILTER (NOT missing) AS n_right
FROM marked GROUP BY permno // {size} HAVING bool_or(corrected OR missing)"""


# Found from the changed rows themselves, without any hashes.
body("dq_15_changed_ranges", """WITH marked AS (SELECT permno,
permno % 23 = 5 AND month(date) = 3 AS corrected,
permno % 41 = 7 AND year(date) = 1997 AS missing FROM prices) """
     + " UNION ALL ".join(_changed_nodes(level) for level in range(4)))
body("dq_16_panel_metadata", """
SELECT count(*) AS rows, count(DISTINCT permno) AS unique_permnos,
  min(formation_date) AS formation_start, max(formation_date) AS formation_end,
  min(realized_return_date) AS realized_return_start,
  max(realized_return_date) AS realized_return_end,
  count(*) FILTER (baseline_complete_case) AS complete_case_rows,
  count(DISTINCT permno) FILTER (baseline_complete_case) AS complete_case_permnos,
  count(log_me) AS size_valid, count(*) - count(log_me) AS size_missing,
  count(*) FILTER (me <= 0) AS market_equity_nonpositive,
  count(book_to_market) AS book_to_market_valid,
  count(DISTINCT formation_date) FILTER (regime = 'HIGH') AS high_months,
  count(DISTINCT formation_date) FILTER (regime = 'LOW') AS low_months FROM panel""")
body("dq_17_monthly_series",
     "SELECT model, formation_date, spearman_ic, regime_binary, regime_3state FROM ic")
body("dq_18_incomplete_inputs", """SELECT permno, formation_date FROM panel
WHERE log_me IS NULL OR book_to_market IS NULL OR mom_12_2 IS NULL OR next_month_return IS NULL""")
body("dq_19_date_agreement", """SELECT permno, formation_date, date FROM broken
WHERE date <> formation_date""")
body("dq_20_predictions_unchanged", """SELECT 'changed' AS "check", 0 AS n_rows
UNION ALL SELECT 'compared', count(*) FROM assign""")
body("dq_21_one_date_and_regime", """SELECT formation_date, model FROM assign
WHERE month(formation_date) = 12 GROUP BY 1, 2
HAVING count(*) FILTER (permno % 50 = 0) BETWEEN 1 AND count(*) - 1""")

