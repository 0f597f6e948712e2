"""Oracle bodies for scans, sinks, projections, filters and scalar functions."""
from oracle.render import body
from oracle.tables import STARS, erfc_p, stacked

body("src_01_parquet_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
body("src_02_projected_scan", "SELECT l_suppkey, l_shipdate, l_extendedprice FROM lineitem")
body("src_03_csv_scan", """SELECT date, vix, 'public_csv' AS source_type FROM ixdaily
WHERE day(date) <> 13 AND date BETWEEN DATE '1995-02-01' AND DATE '2001-06-30'""")
body("src_04_scan_dispatch", """SELECT 'csv' AS file_format, count(*) AS rows, sum(vix) AS total
FROM ixdaily UNION ALL SELECT 'parquet', count(*), sum(o_totalprice / 10000.0) FROM orders""")
_COMMON = """sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM'
  AND usincflg = 'Y' AND issuertype IN ('ACOR', 'CORP') AND primaryexch IN ('N', 'A', 'Q')
  AND conditionaltype = 'RW' AND tradingstatusflg = 'A'"""
body("src_05_security_monthly", f"""SELECT permno, mthcaldt AS date, ticker, mthret AS ret,
mthprc AS prc, shrout, mthcap AS market_equity, primaryexch, issuertype FROM secfile
WHERE mthcaldt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND abs(mthprc) >= 5 AND {_COMMON}""")
body("src_06_normalize_security", f"""SELECT permno, last_day(mthcaldt) AS date, mthret AS ret,
abs(mthprc) AS prc, shrout, abs(mthprc) * shrout AS market_equity,
lag(abs(mthprc) * shrout) OVER (PARTITION BY permno ORDER BY mthcaldt) AS me_lag,
'ciz' AS source_format, 'security_file' AS source_table FROM secfile
WHERE mthcaldt BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND {_COMMON}""")
body("src_07_fundamentals", """SELECT *, 'fundamentals_annual' AS source_table FROM funda
WHERE datadate BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'
  AND gvkey IN (SELECT gvkey FROM goodlinks)""")
body("src_08_link_history", "SELECT * FROM links")
body("src_09_index_daily", """SELECT date, vix, 'primary' AS source_type,
'vix' AS source_value_col FROM ixdaily
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
body("src_10_read_through", "SELECT date, vix FROM ixmonthly")
body("src_11_source_fallback",
     "SELECT date, vix, 'public_csv' AS source_type FROM ixdaily WHERE day(date) <> 13")

body("snk_01_parquet_sink",
     "SELECT permno, count(*) AS n_rows, sum(shrout) AS total FROM prices GROUP BY permno")
body("snk_02_csv_sink", "SELECT permno, date, prc, ret, TRUE AS equal_after_reading FROM prices")
body("snk_03_resumable_months", """SELECT formation_date, count(*) AS n_rows,
avg(actual_next_month_return) AS mean_return,
CASE WHEN formation_date < DATE '1999-01-01' THEN 'first' ELSE 'second' END AS run
FROM preds GROUP BY formation_date""")
body("snk_04_json_metadata",
     "SELECT count(*) AS rows, min(date) AS first_month, max(date) AS last_month FROM prices")

body("prj_01_safe_numeric", """SELECT p_partkey,
CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size_text,
CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS price_or_null,
CASE WHEN p_size % 5 <> 0 THEN CAST(1.0 AS DOUBLE) / p_size END AS inverse_size,
CAST(NULL AS DOUBLE) AS absent FROM part""")
body("prj_02_month_end", """SELECT d AS day, last_day(d) AS month_end,
last_day(date_trunc('month', d) + INTERVAL 1 MONTH) AS next_end,
last_day(date_trunc('month', d) - INTERVAL 1 MONTH) AS previous_end, last_day(d) AS again,
count(*) AS n_orders FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY d""")
body("prj_03_stockholders_equity", """SELECT gvkey, datadate, she AS stockholders_equity,
she_source AS stockholders_equity_source FROM booked""")
body("prj_04_preferred_stock", """SELECT gvkey, datadate, ps AS preferred_stock,
ps_source AS preferred_stock_source FROM booked""")
body("prj_05_deferred_taxes", """SELECT gvkey, datadate, dt AS deferred_taxes_itc,
dt_source AS deferred_taxes_source FROM booked""")
body("prj_06_book_equity", """SELECT gvkey, datadate, book_equity,
coalesce(book_equity > 0, FALSE) AS book_equity_valid FROM booked""")
body("prj_07_market_equity", """SELECT permno, date, abs(prc) * shrout AS market_equity,
ln(abs(prc) * shrout) AS log_me FROM prices""")
body("prj_08_characteristic_year", """SELECT permno, date, y AS characteristic_year,
make_date(y, 6, 30) AS available_from, make_date(y + 1, 5, 31) AS active_through
FROM (SELECT permno, date, CASE WHEN month(date) >= 6 THEN year(date) ELSE year(date) - 1 END AS y
      FROM prices)""")
body("prj_09_panel_flags", """SELECT permno, formation_date, realized_return_date,
next_month_return IS NOT NULL AS target_available, baseline_predictors_complete, price_eligible,
baseline_complete_case, accounting_eligibility_date, accounting_active_through FROM panel""")
body("prj_10_binary_label", "SELECT * FROM regimes")
body("prj_11_three_state_label", "SELECT date, vix, regime_3state AS regime FROM three")
body("prj_12_significance_stars", f"""SELECT l_orderkey, l_linenumber, l_discount,
{STARS.format(p='l_discount')} AS stars FROM lineitem""")
body("prj_13_one_way_cost", """SELECT permno, formation_date, model,
realized_next_month_return - decile / 10.0 * 0.005 AS net FROM assign""")

body("flt_01_common_stock",
     f"SELECT permno, mthcaldt, primaryexch, issuertype FROM secfile WHERE {_COMMON}")
body("flt_02_legacy_common_stock", """SELECT permno, namedt, shrcd, exchcd FROM names
WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3)""")
body("flt_03_price_screen",
     "SELECT permno, date, prc, next_month_return FROM features WHERE abs(prc) >= 5")
body("flt_04_link_filter", "SELECT *, permno AS lpermno FROM goodlinks")
body("flt_05_complete_case", "SELECT * FROM sample")
body("flt_06_observable", """SELECT permno, formation_date, next_month_return FROM panel
WHERE formation_date < DATE '1998-06-30' AND realized_return_date <= DATE '1998-06-30'""")
body("flt_07_finite_rows", """SELECT p_partkey, p_retailprice AS value FROM part
WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
body("flt_08_regime_subsets", stacked("dwide"))
body("flt_09_date_window", """SELECT permno, date, next_month_return, mom_12_2 FROM features
WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")

body("fn_01_basic_math", """SELECT permno, date, abs(prc) AS a, ln(abs(prc)) AS b,
sqrt(abs(prc)) AS c, floor(prc) AS d, ceil(prc) AS e, least(greatest(prc, 1.0), 10.0) AS f
FROM prices""")
body("fn_02_normal_p", f"""SELECT c_custkey, {erfc_p('t')} AS p_value
FROM (SELECT *, c_acctbal / 2500.0 AS t FROM customer)""")
body("fn_03_normal_interval", """SELECT model, weighting, m - 1.959963984540054 * se AS lower,
m + 1.959963984540054 * se AS upper FROM (SELECT model, weighting, avg(D10_minus_D1) AS m,
stddev_samp(D10_minus_D1) / sqrt(count(D10_minus_D1)) AS se FROM dwide GROUP BY 1, 2)""")
body("fn_04_is_close", """SELECT permno, date, abs(a - b) <= 0.001 AS close,
abs(a - b) <= 0.0001 * abs(b) AS loose
FROM (SELECT permno, date, prc * shrout AS a, floor(prc * 10000.0) / 10000.0 * shrout AS b FROM prices)""")
body("fn_05_text", """SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b,
trim(c_name) || '.' || trim(c_mktsegment) AS c FROM customer""")
body("fn_06_named_security",
     "SELECT permno, mthcaldt, ticker FROM secfile WHERE upper(ticker) = 'T10007'")
body("fn_07_calendar", """SELECT date AS day, year(date) AS y, month(date) AS m,
last_day(date) AS "end", last_day(date_trunc('month', date) + INTERVAL 3 MONTH) AS ahead,
make_date(year(date) + 1, 6, 30) AS made FROM ixdaily""")
body("fn_08_weighted_average", """SELECT formation_date, model,
sum(weighting_variable * realized_next_month_return) / sum(weighting_variable) AS value,
count(*) AS n_valid FROM assign WHERE weighting_variable > 0 GROUP BY 1, 2""")
body("fn_09_exact_sum", """SELECT l_suppkey + 10000 AS permno,
sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, sum(l_tax * l_quantity) AS parts
FROM lineitem GROUP BY 1""")
# A product with a power of two is exact, and so is a sum of whole numbers.
body("fn_09_exact_double_sum", """SELECT permno,
CAST(sum(CAST(x * 8589934592 AS HUGEINT)) AS DOUBLE) / 8589934592 AS total FROM (
SELECT l_suppkey + 10000 AS permno,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1e9 ELSE -1e9 END AS DOUBLE)
  + CAST(l_extendedprice AS DOUBLE) * CAST(l_tax AS DOUBLE) AS x
FROM lineitem) GROUP BY 1""")
body("fn_10_annualize", """SELECT model, weighting, 12 * avg(D10_minus_D1) AS mean_year,
sqrt(12) * stddev_samp(D10_minus_D1) AS sd_year FROM dwide GROUP BY 1, 2""")
body("fn_11_params_json", """SELECT s_suppkey + 10000 AS permno,
'{"max_depth":' || CAST(s_nationkey AS VARCHAR) || ',"tree_method":"hist"}' AS params
FROM supplier""")
body("fn_12_code_rank", """SELECT gvkey, lpermno, linkdt,
CASE linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 9 END AS prim_rank,
CASE linktype WHEN 'LC' THEN 0 WHEN 'LU' THEN 1 ELSE 9 END AS type_rank FROM links""")
