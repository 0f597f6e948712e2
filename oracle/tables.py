"""Named SQL fragments over the test tables; ``with_tables`` adds those a query needs."""
from __future__ import annotations

import re

TABLES: dict[str, str] = {}


def table(name: str, sql: str) -> None:
    TABLES[name] = sql.strip()


table("lots", """
SELECT l_suppkey + 10000 AS permno, last_day(l_shipdate) AS date,
       sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS val,
       sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, min(CAST(l_shipdate AS DATE)) AS caldt
FROM lineitem GROUP BY 1, 2""")

table("lots2", """
SELECT permno, 'T' || CAST(permno AS VARCHAR) AS ticker, caldt, date,
       year(date) * 12 + month(date) AS mi,
       CAST(val AS DOUBLE) / CAST(qty AS DOUBLE) / CAST(300.007 AS DOUBLE) AS p, CAST(qty AS DOUBLE) AS shrout
FROM lots""")

table("prices", """
SELECT a.permno, a.ticker, a.caldt, a.date, a.shrout,
       CASE WHEN (a.permno + a.mi) % 37 = 0 THEN -a.p ELSE a.p END AS prc,
       CASE WHEN (a.permno + a.mi) % 211 <> 0 THEN a.p / b.p - 1.0 END AS ret
FROM lots2 a LEFT JOIN lots2 b ON b.permno = a.permno AND b.mi = a.mi - 1""")


def _codes(k: str) -> str:
    return f"""
CASE WHEN {k} % 4 = 0 THEN 'N' WHEN {k} % 4 = 1 THEN 'A' WHEN {k} % 13 = 5 THEN 'X' ELSE 'Q' END
    AS primaryexch,
CASE WHEN {k} % 10 = 7 THEN 'AD' ELSE 'NS' END AS sharetype,
CASE WHEN {k} % 19 = 3 THEN 'FUND' ELSE 'EQTY' END AS securitytype,
'COM' AS securitysubtype,
CASE WHEN {k} % 17 = 2 THEN 'N' ELSE 'Y' END AS usincflg,
CASE WHEN {k} % 3 = 0 THEN 'ACOR' ELSE 'CORP' END AS issuertype,
'RW' AS conditionaltype, 'A' AS tradingstatusflg"""


table("secfile", f"""
SELECT permno, caldt AS mthcaldt, ticker, ret AS mthret, prc AS mthprc, shrout,
       abs(prc) * shrout AS mthcap, {_codes('(permno - 10000)')} FROM prices""")

table("secinfo", f"""
SELECT s_suppkey + 10000 AS permno,
       CASE WHEN part = 0 THEN DATE '1990-01-01' ELSE DATE '1998-07-01' END AS secinfostartdt,
       CASE WHEN part = 0 THEN DATE '1998-06-30' ELSE DATE '2099-12-31' END AS secinfoenddt,
       'T' || CAST(s_suppkey + 10000 AS VARCHAR) || CASE WHEN part = 0 THEN 'A' ELSE 'B' END
           AS ticker, {_codes('(s_suppkey + part * 7)')}
FROM supplier, (VALUES (0), (1)) v(part)""")

table("names", """
SELECT s_suppkey + 10000 AS permno,
       CASE WHEN part = 0 THEN DATE '1990-01-01' ELSE DATE '1998-07-01' END AS namedt,
       CASE WHEN part = 0 THEN DATE '1998-06-30' ELSE DATE '2099-12-31' END AS nameendt,
       'L' || CAST(s_suppkey + 10000 AS VARCHAR) AS ticker,
       10 + (s_suppkey + part) % 3 AS shrcd, 1 + s_suppkey % 4 AS exchcd
FROM supplier, (VALUES (0), (1)) v(part)""")

table("ixdaily", """
SELECT CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 10000.0 AS vix
FROM orders GROUP BY 1""")

table("ixmonthly", """
SELECT last_day(date) AS date, vix FROM ixdaily
QUALIFY row_number() OVER (PARTITION BY last_day(date) ORDER BY date DESC) = 1""")

table("regimes", """
SELECT date, vix, med AS vix_expanding_median, CASE WHEN vix > med THEN 'HIGH' ELSE 'LOW' END
       AS regime
FROM (SELECT a.date, any_value(a.vix) AS vix, quantile_cont(b.vix, 0.5) AS med
      FROM ixmonthly a JOIN ixmonthly b ON b.date <= a.date GROUP BY a.date)""")

table("three", """
SELECT date, vix, med AS vix_expanding_median, q33 AS vix_expanding_q33, q67 AS vix_expanding_q67,
       CASE WHEN vix > med THEN 'HIGH' ELSE 'LOW' END AS regime_binary,
       CASE WHEN vix <= q33 THEN 'LOW' WHEN vix <= q67 THEN 'MIDDLE' ELSE 'HIGH' END
           AS regime_3state
FROM (SELECT a.date, any_value(a.vix) AS vix, quantile_cont(b.vix, 0.5) AS med,
             quantile_cont(b.vix, CAST(1.0 AS DOUBLE) / 3.0) AS q33,
             quantile_cont(b.vix, CAST(2.0 AS DOUBLE) / 3.0) AS q67
      FROM ixmonthly a JOIN ixmonthly b ON b.date <= a.date GROUP BY a.date)""")

table("yearly", """
SELECT l_suppkey // 2 AS k, year(l_shipdate) AS y,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN p ELSE 0 END) AS DOUBLE) / 2000003.0 AS sa,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN p ELSE 0 END) AS DOUBLE) / 2000003.0 AS sn,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN p ELSE 0 END) AS DOUBLE) / 2000003.0 AS sr,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN p ELSE 0 END) AS DOUBLE) / 2000003.0 AS sf,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN p ELSE 0 END) AS DOUBLE) / 2000003.0 AS so,
       CAST(sum(p) AS DOUBLE) / 2000003.0 AS tot
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1, 2""")

table("fundafile", """
SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS gvkey,
       CASE WHEN copy = 1 THEN make_date(y, 6, 30) WHEN k % 5 = 0 THEN make_date(y, 9, 30)
            ELSE make_date(y, 12, 31) END AS datadate,
       y AS fyear, CASE WHEN copy = 1 THEN 6 WHEN k % 5 = 0 THEN 9 ELSE 12 END AS fyr,
       CASE WHEN (k + y) % 3 <> 0 THEN sa * (CASE WHEN k % 23 = 5 THEN -1.0 ELSE 1.0 END)
            * (CASE WHEN copy = 1 THEN CAST(0.9 AS DOUBLE) ELSE 1.0 END) END AS seq,
       CASE WHEN (k + y) % 5 <> 0 THEN sn END AS ceq,
       CASE WHEN (k + y) % 7 <> 0 THEN tot END AS "at",
       CASE WHEN (k + y) % 7 <> 3 THEN sf END AS lt,
       CASE WHEN (k + y) % 2 <> 0 THEN so / 20.0 END AS txditc,
       CASE WHEN (k + y) % 6 <> 0 THEN so / 40.0 END AS txdb,
       CASE WHEN (k + y) % 8 >= 6 THEN sf / 50.0 END AS itcb,
       CASE WHEN (k + y) % 3 <> 1 THEN sr / 12.0 END AS pstkrv,
       CASE WHEN (k + y) % 9 >= 4 THEN sr / 11.0 END AS pstkl,
       CASE WHEN (k + y) % 4 <> 0 THEN sr / 10.0 END AS pstk,
       CASE WHEN copy = 1 AND k % 2 = 1 THEN 'FS' ELSE 'INDL' END AS indfmt,
       'STD' AS datafmt, 'D' AS popsrc, 'C' AS consol,
       CASE WHEN k % 17 = 16 THEN 'CAD' ELSE 'USD' END AS curcd
FROM yearly, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR (k + y) % 11 = 0""")

table("funda", """
SELECT * FROM fundafile WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D'
  AND consol = 'C' AND curcd = 'USD' AND datadate BETWEEN DATE '1990-01-01' AND DATE '2010-12-31'""")

table("booked", """
SELECT *, she + dt - ps AS book_equity FROM (
SELECT *,
  CASE WHEN seq IS NOT NULL THEN seq WHEN ceq IS NOT NULL AND pstk IS NOT NULL THEN ceq + pstk
       WHEN "at" IS NOT NULL AND lt IS NOT NULL THEN "at" - lt END AS she,
  CASE WHEN seq IS NOT NULL THEN 'seq'
       WHEN ceq IS NOT NULL AND pstk IS NOT NULL THEN 'ceq_plus_pstk'
       WHEN "at" IS NOT NULL AND lt IS NOT NULL THEN 'at_minus_lt' END AS she_source,
  CASE WHEN pstkrv IS NOT NULL THEN pstkrv WHEN pstkl IS NOT NULL THEN pstkl
       WHEN pstk IS NOT NULL THEN pstk ELSE 0.0 END AS ps,
  CASE WHEN pstkrv IS NOT NULL THEN 'pstkrv' WHEN pstkl IS NOT NULL THEN 'pstkl'
       WHEN pstk IS NOT NULL THEN 'pstk' ELSE 'assumed_zero_missing' END AS ps_source,
  CASE WHEN txditc IS NOT NULL THEN txditc
       WHEN txdb IS NOT NULL OR itcb IS NOT NULL THEN ifnull(txdb, 0) + ifnull(itcb, 0)
       ELSE 0.0 END AS dt,
  CASE WHEN txditc IS NOT NULL THEN 'txditc'
       WHEN txdb IS NOT NULL OR itcb IS NOT NULL THEN 'txdb_plus_itcb'
       ELSE 'assumed_zero_missing' END AS dt_source
FROM funda)""")

table("annual", """
SELECT *, year(datadate) AS accounting_year, year(datadate) + 1 AS characteristic_year,
       make_date(year(datadate) + 1, 6, 30) AS accounting_available_from
FROM booked
QUALIFY row_number() OVER (PARTITION BY gvkey, year(datadate)
                           ORDER BY datadate DESC, fyear DESC) = 1""")

table("links", """
SELECT lpad(CAST(s_suppkey // 2 + CASE WHEN part = 2 THEN 1 ELSE 0 END AS VARCHAR), 6, '0')
           AS gvkey, s_suppkey + 10000 AS lpermno,
       CASE WHEN part = 1 THEN 'LU' WHEN part = 2 THEN 'LC' WHEN s_suppkey % 7 = 0 THEN 'LU'
            WHEN s_suppkey % 7 = 3 THEN 'LD' WHEN s_suppkey % 7 = 5 THEN 'lc' ELSE 'LC' END
           AS linktype,
       CASE WHEN part = 1 THEN 'C' WHEN part = 2 THEN 'P' WHEN s_suppkey % 11 = 10 THEN 'J'
            WHEN s_suppkey % 5 = 4 THEN 'c' ELSE 'P' END AS linkprim,
       CASE WHEN part = 2 THEN DATE '1998-01-01' WHEN s_suppkey % 3 = 0 THEN NULL
            ELSE DATE '1992-01-01' END AS linkdt,
       CASE WHEN part = 0 AND s_suppkey % 8 = 1 THEN DATE '1999-06-30' END AS linkenddt
FROM supplier, (VALUES (0), (1), (2)) v(part)
WHERE part = 0 OR (part = 1 AND s_suppkey % 6 = 0) OR (part = 2 AND s_suppkey % 9 = 0)""")

table("goodlinks", """
SELECT gvkey, lpermno AS permno, upper(linktype) AS linktype, upper(linkprim) AS linkprim,
       linkdt, linkenddt
FROM links WHERE upper(linktype) IN ('LC', 'LU') AND upper(linkprim) IN ('P', 'C')""")

table("validlinks", """
SELECT a.*, l.permno, l.linktype, l.linkprim, l.linkdt, l.linkenddt,
       CASE l.linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 9 END AS prim_rank,
       CASE l.linktype WHEN 'LC' THEN 0 WHEN 'LU' THEN 1 ELSE 9 END AS type_rank
FROM annual a JOIN goodlinks l ON a.gvkey = l.gvkey
 AND a.datadate >= coalesce(l.linkdt, DATE '0001-01-01')
 AND a.datadate <= coalesce(l.linkenddt, DATE '9999-12-31')""")

table("pairs", """
SELECT * FROM validlinks QUALIFY row_number() OVER (
  PARTITION BY gvkey, characteristic_year, permno
  ORDER BY prim_rank, type_rank, linkdt DESC NULLS LAST, linkenddt ASC NULLS LAST) = 1""")

table("linked", """
SELECT * FROM pairs QUALIFY row_number() OVER (
  PARTITION BY permno, characteristic_year
  ORDER BY prim_rank, type_rank, datadate DESC, gvkey) = 1""")

table("px", """
SELECT permno, ticker, date, abs(prc) AS prc, shrout, ret, abs(prc) * shrout AS market_equity,
       year(date) * 12 + month(date) AS mi FROM prices""")

table("features", """
SELECT a.permno, a.ticker, a.date, a.mi, a.prc, a.shrout, a.ret, a.market_equity,
       CASE WHEN a.market_equity > 0 THEN ln(a.market_equity) END AS log_me, m.mom_12_2,
       n.ret AS next_month_return, l.market_equity AS me_lag,
       last_day(a.date + INTERVAL 1 MONTH) AS realized_return_date,
       last_day(a.date - INTERVAL 1 MONTH) AS me_lag_date
FROM px a
LEFT JOIN px n ON n.permno = a.permno AND n.mi = a.mi + 1
LEFT JOIN px l ON l.permno = a.permno AND l.mi = a.mi - 1
LEFT JOIN (SELECT x.permno, x.mi, product(1.0 + h.ret) - 1.0 AS mom_12_2
           FROM px x JOIN px h ON h.permno = x.permno AND h.mi BETWEEN x.mi - 12 AND x.mi - 2
           WHERE h.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 11) m
       ON m.permno = a.permno AND m.mi = a.mi""")

table("december", """
SELECT permno, year(date) AS december_year, market_equity / 1000.0 AS me_dec_security,
       date AS me_dec_date FROM features WHERE month(date) = 12""")

table("annualbm", """
SELECT l.*, d.me_dec_security, d.me_dec_date, t.linked_permnos, t.permnos_with_december_me,
       t.me_dec,
       CASE WHEN l.book_equity > 0 AND t.me_dec > 0 THEN l.book_equity / t.me_dec END
           AS book_to_market
FROM linked l
LEFT JOIN december d ON d.permno = l.permno AND d.december_year = l.characteristic_year - 1
JOIN (SELECT gvkey, characteristic_year, count(*) AS linked_permnos,
             count(me_dec_security) AS permnos_with_december_me,
             CASE WHEN count(me_dec_security) = count(*) THEN sum(me_dec_security) END AS me_dec
      FROM linked x LEFT JOIN december d
        ON d.permno = x.permno AND d.december_year = x.characteristic_year - 1
      WHERE x.permno IN (SELECT permno FROM features)
      GROUP BY 1, 2) t
  ON t.gvkey = l.gvkey AND t.characteristic_year = l.characteristic_year
WHERE l.permno IN (SELECT permno FROM features)""")

table("assigned", """
SELECT f.*, CASE WHEN month(f.date) >= 6 THEN year(f.date) ELSE year(f.date) - 1 END
           AS characteristic_year,
       b.gvkey, b.datadate AS accounting_datadate, b.fyear, b.fyr, b.book_equity,
       b.accounting_available_from, b.me_dec, b.book_to_market,
       b.she_source, b.ps_source, b.dt_source, b.linkprim, b.linktype
FROM features f LEFT JOIN annualbm b ON b.permno = f.permno
 AND b.characteristic_year = CASE WHEN month(f.date) >= 6 THEN year(f.date)
                                  ELSE year(f.date) - 1 END""")

table("panel", """
SELECT *, market_equity AS me, date AS formation_date,
       accounting_available_from AS accounting_eligibility_date,
       make_date(characteristic_year + 1, 5, 31) AS accounting_active_through,
       (log_me IS NOT NULL AND book_to_market IS NOT NULL AND mom_12_2 IS NOT NULL)
           AS baseline_predictors_complete,
       (log_me IS NOT NULL AND book_to_market IS NOT NULL AND mom_12_2 IS NOT NULL
        AND next_month_return IS NOT NULL AND regime IS NOT NULL AND price_eligible
        AND gvkey IS NOT NULL) AS baseline_complete_case
FROM (SELECT a.*, r.vix, r.vix_expanding_median, r.regime,
             coalesce(a.prc >= 5.0, FALSE) AS price_eligible
      FROM assigned a LEFT JOIN regimes r ON r.date = a.date)""")

table("sample", "SELECT * FROM panel WHERE baseline_complete_case")

table("preds", """
SELECT f.date, f.date AS formation_date, f.realized_return_date, f.permno, f.ticker, r.regime,
       r.vix, f.next_month_return AS actual_next_month_return, f.me_lag, f.me_lag_date,
       round(CAST(0.02 AS DOUBLE) - log_me * CAST(0.001 AS DOUBLE)
             + mom_12_2 * CAST(0.01 AS DOUBLE), 10) AS elastic_net_prediction,
       round(floor(mom_12_2 * 20.0) / 1000.0
             + CASE WHEN log_me > 7.0 THEN 0.0 ELSE CAST(0.0005 AS DOUBLE) END, 10)
           AS xgboost_prediction,
       CAST(0.01 AS DOUBLE) AS benchmark_prediction
FROM features f JOIN regimes r ON r.date = f.date
WHERE mom_12_2 IS NOT NULL AND log_me IS NOT NULL AND me_lag IS NOT NULL
  AND next_month_return IS NOT NULL""")

table("predlong", """
SELECT * EXCLUDE (elastic_net_prediction, xgboost_prediction), 'Elastic Net' AS model,
       elastic_net_prediction AS prediction FROM preds
UNION ALL
SELECT * EXCLUDE (elastic_net_prediction, xgboost_prediction), 'XGBoost', xgboost_prediction
FROM preds""")

table("predlong3", """
SELECT p.*, t.vix_expanding_median, t.vix_expanding_q33, t.vix_expanding_q67, t.regime_binary,
       t.regime_3state
FROM predlong p JOIN three t ON t.date = p.formation_date""")

table("ranked", """
SELECT *, row_number() OVER (PARTITION BY formation_date, model ORDER BY prediction, permno) AS rn,
       count(*) OVER (PARTITION BY formation_date, model) AS n FROM predlong3""")

table("assign", """
SELECT formation_date, realized_return_date, permno, ticker, model, prediction,
       CAST(floor((rn - 1) * 10 / n) AS BIGINT) + 1 AS decile,
       actual_next_month_return AS realized_next_month_return, me_lag AS weighting_variable,
       vix, vix_expanding_median, vix_expanding_q33, vix_expanding_q67, regime_binary,
       regime_3state
FROM ranked WHERE n >= 10""")

table("dlong", """
SELECT formation_date, realized_return_date, model, regime_binary, regime_3state, decile,
       'EW' AS weighting, avg(realized_next_month_return) AS decile_return, count(*) AS n_weight
FROM assign GROUP BY 1, 2, 3, 4, 5, 6
UNION ALL
SELECT formation_date, realized_return_date, model, regime_binary, regime_3state, decile, 'VW',
       sum(weighting_variable * realized_next_month_return) / sum(weighting_variable), count(*)
FROM assign WHERE weighting_variable > 0 GROUP BY 1, 2, 3, 4, 5, 6""")


def _wide(value: str, name: str) -> str:
    return ", ".join(
        f"max(CASE WHEN decile = {d} THEN {value} END) AS {name.format(d)}" for d in range(1, 11)
    )


table("dwide", f"""
SELECT *, D10 - D1 AS D10_minus_D1 FROM (
SELECT formation_date, realized_return_date, model, regime_binary, regime_3state, weighting,
       {_wide('decile_return', 'D{}')}, {_wide('n_weight', 'n_D{}')}, sum(n_weight) AS n_stocks
FROM dlong GROUP BY 1, 2, 3, 4, 5, 6)""")


def stacked(source: str, definitions: tuple[str, ...] = ("overall", "binary", "three_state")) -> str:
    """Monthly rows repeated under each regime definition."""
    labels = {"overall": "'OVERALL'", "binary": "regime_binary", "three_state": "regime_3state"}
    return " UNION ALL ".join(
        f"SELECT *, '{d}' AS regime_definition, {labels[d]} AS regime FROM {source}"
        for d in definitions
    )


table("dwide_r", stacked("dwide"))


def correlation(x: str, y: str) -> str:
    """Correlation that is NULL when a side is constant."""
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


def avg_rank(value: str, group: str) -> str:
    return (f"(rank() OVER (PARTITION BY {group} ORDER BY {value}) "
            f"+ (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0)")


table("icranks", f"""
SELECT formation_date, realized_return_date, model, regime, regime_binary, regime_3state, permno,
       prediction, actual_next_month_return AS actual,
       {avg_rank('prediction', 'formation_date, model')} AS rx,
       {avg_rank('actual_next_month_return', 'formation_date, model')} AS ry
FROM predlong3""")

table("ic", f"""
SELECT formation_date, realized_return_date, model, regime, regime_binary, regime_3state,
       {correlation('rx', 'ry')} AS spearman_ic, {correlation('prediction', 'actual')}
           AS pearson_ic,
       count(*) AS n_stocks, count(DISTINCT prediction) AS n_unique_predictions,
       max(prediction) - min(prediction) AS prediction_range
FROM icranks GROUP BY 1, 2, 3, 4, 5, 6""")

table("ic_r", stacked("ic_plain"))
table("ic_plain", """
SELECT formation_date, model, regime_binary, regime_3state, spearman_ic, n_stocks FROM ic""")

# --- costs ---------------------------------------------------------------------------
table("held", """
SELECT *, amount / sum(amount) OVER leg AS target_weight,
       amount * (1 + r) / sum(amount * (1 + r)) OVER leg AS drifted_weight
FROM (SELECT formation_date, realized_return_date, model, 'EW' AS weighting, decile, permno,
             ticker, realized_next_month_return AS r, CAST(1.0 AS DOUBLE) AS amount,
             regime_binary, regime_3state FROM assign
      UNION ALL
      SELECT formation_date, realized_return_date, model, 'VW', decile, permno, ticker,
             realized_next_month_return, weighting_variable, regime_binary, regime_3state
      FROM assign WHERE weighting_variable > 0)
WINDOW leg AS (PARTITION BY formation_date, model, weighting, decile)""")

table("aligned", """
SELECT coalesce(a.formation_date, b.formation_date) AS formation_date,
       coalesce(a.model, b.model) AS model, coalesce(a.weighting, b.weighting) AS weighting,
       coalesce(a.decile, b.decile) AS decile, coalesce(a.permno, b.permno) AS permno, a.ticker,
       coalesce(a.target_weight, 0) AS target_weight,
       coalesce(b.drifted_weight, 0) AS pretrade_weight
FROM held a FULL OUTER JOIN
     (SELECT last_day(formation_date + INTERVAL 1 MONTH) AS formation_date, model, weighting,
             decile, permno, drifted_weight FROM held
      WHERE formation_date < (SELECT max(formation_date) FROM held)) b
  ON a.formation_date = b.formation_date AND a.model = b.model AND a.weighting = b.weighting
 AND a.decile = b.decile AND a.permno = b.permno""")

table("turn", """
SELECT t.formation_date, t.model, t.weighting, t.decile,
       t.formation_date = (SELECT min(formation_date) FROM held) AS initial_formation,
       CASE WHEN t.formation_date = (SELECT min(formation_date) FROM held) THEN 1.0
            ELSE t.turnover END AS turnover, t.n_stocks, m.regime_binary, m.regime_3state
FROM (SELECT formation_date, model, weighting, decile,
             sum(abs(target_weight - pretrade_weight)) / 2 AS turnover,
             sum(CASE WHEN target_weight > 0 THEN 1 ELSE 0 END) AS n_stocks
      FROM aligned GROUP BY 1, 2, 3, 4) t
JOIN (SELECT DISTINCT formation_date, model, regime_binary, regime_3state FROM assign) m
  ON m.formation_date = t.formation_date AND m.model = t.model""")

table("rebuilt", f"""
SELECT *, D10 - D1 AS D10_minus_D1 FROM (
SELECT g.formation_date, g.realized_return_date, g.model, g.weighting, g.regime_binary,
       g.regime_3state, {_wide('gross', 'D{}')}, {_wide('n', 'n_D{}')},
       {_wide('turnover', 'D{}_turnover')}, sum(n) AS n_stocks
FROM (SELECT h.formation_date, h.realized_return_date, h.model, h.weighting, h.decile,
             h.regime_binary, h.regime_3state, sum(h.target_weight * h.r) AS gross, count(*) AS n,
             any_value(t.turnover) AS turnover
      FROM held h JOIN turn t ON t.formation_date = h.formation_date AND t.model = h.model
       AND t.weighting = h.weighting AND t.decile = h.decile
      GROUP BY 1, 2, 3, 4, 5, 6, 7) g
GROUP BY 1, 2, 3, 4, 5, 6)""")

table("net", """
SELECT formation_date, realized_return_date, model, weighting, regime_binary, regime_3state, bps,
       D1 AS D1_gross, D10 AS D10_gross, D10_minus_D1 AS D10_minus_D1_gross, D1_turnover,
       D10_turnover, D1_turnover * rate AS D1_cost, D10_turnover * rate AS D10_cost,
       D1 - D1_turnover * rate AS D1_net, D10 - D10_turnover * rate AS D10_net,
       -D1 - D1_turnover * rate AS D1_short_leg_net_contribution,
       D10_turnover + D1_turnover AS long_short_total_turnover,
       D10_turnover * rate + D1_turnover * rate AS long_short_cost,
       D10_minus_D1 - (D10_turnover * rate + D1_turnover * rate) AS D10_minus_D1_net
FROM rebuilt, (VALUES (0, CAST(0.0 AS DOUBLE)), (50, CAST(0.005 AS DOUBLE))) s(bps, rate)""")

table("net_r", stacked("net"))

# --- tie-preserving sorts ------------------------------------------------------------
table("tied", f"""
SELECT *, greatest(least(CAST(ceil(10.0 * (ar / n)) AS BIGINT), 10), 1) AS portfolio
FROM (SELECT *, {avg_rank('prediction', 'formation_date, model')} AS ar,
             count(*) OVER (PARTITION BY formation_date, model) AS n FROM predlong)""")

table("ends", """
SELECT *, amount / sum(amount) OVER leg AS w,
       amount * (1 + r) / sum(amount * (1 + r)) OVER leg AS drifted
FROM (SELECT formation_date, model, portfolio, permno, regime, actual_next_month_return AS r,
             'EW' AS weighting, CAST(1.0 AS DOUBLE) AS amount FROM tied
      WHERE portfolio IN (1, 10)
      UNION ALL
      SELECT formation_date, model, portfolio, permno, regime, actual_next_month_return, 'VW',
             me_lag FROM tied WHERE portfolio IN (1, 10) AND me_lag > 0)
WINDOW leg AS (PARTITION BY formation_date, model, weighting, portfolio)""")

table("endmonths", """
SELECT model, formation_date, lead(formation_date) OVER (PARTITION BY model
       ORDER BY formation_date) AS next_month,
       row_number() OVER (PARTITION BY model ORDER BY formation_date) = 1 AS first_month
FROM (SELECT DISTINCT model, formation_date FROM ends)""")

table("endturn", """
SELECT x.formation_date, x.model, x.weighting, x.portfolio,
       CASE WHEN m.first_month THEN 1.0 ELSE x.turnover END AS turnover
FROM (SELECT formation_date, model, weighting, portfolio, sum(abs(d)) / 2 AS turnover
      FROM (SELECT formation_date, model, weighting, portfolio, permno, sum(d) AS d
            FROM (SELECT formation_date, model, weighting, portfolio, permno, w AS d FROM ends
                  UNION ALL
                  SELECT m.next_month, e.model, e.weighting, e.portfolio, e.permno, -e.drifted
                  FROM ends e JOIN endmonths m ON m.model = e.model
                   AND m.formation_date = e.formation_date AND m.next_month IS NOT NULL)
            GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) x
JOIN endmonths m ON m.model = x.model AND m.formation_date = x.formation_date""")

table("extreme", """
SELECT *, gross - 0.005 * total_turnover AS net_return, 0.005 * total_turnover AS cost FROM (
SELECT g.formation_date AS date, g.model, g.weighting, upper(min(g.regime)) AS regime,
       max(CASE WHEN g.portfolio = 10 THEN g.n END) AS n_long,
       max(CASE WHEN g.portfolio = 1 THEN g.n END) AS n_short,
       max(CASE WHEN g.portfolio = 10 THEN g.ret END)
         - max(CASE WHEN g.portfolio = 1 THEN g.ret END) AS gross,
       max(CASE WHEN g.portfolio = 10 THEN t.turnover END) AS long_turnover,
       max(CASE WHEN g.portfolio = 1 THEN t.turnover END) AS short_turnover,
       max(CASE WHEN g.portfolio = 10 THEN t.turnover END)
         + max(CASE WHEN g.portfolio = 1 THEN t.turnover END) AS total_turnover
FROM (SELECT formation_date, model, weighting, portfolio, min(regime) AS regime,
             sum(w * r) AS ret, count(*) AS n FROM ends GROUP BY 1, 2, 3, 4) g
JOIN endturn t USING (formation_date, model, weighting, portfolio)
GROUP BY 1, 2, 3)""")


# --- HAC -----------------------------------------------------------------------------
def erfc_p(t: str) -> str:
    """Two-sided normal p-value from the erf series with gamma functions."""
    x = f"(abs({t}) / sqrt(2.0))"
    term = (f"exp(i * ln(2.0) + (2 * i + 1) * ln({x}) - (lgamma(2.0 * i + 2) - i * ln(2.0) "
            f"- lgamma(i + 1.0)))")
    series = f"list_sum(list_transform(range(0, 200), lambda i: {term}))"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {x} = 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 "
            f"ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {series}) END")


STARS = ("CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' "
         "ELSE '' END")


def hac_mean(source: str, keys: str, outcome: str, date: str = "formation_date") -> str:
    """Mean, HAC error and t per series: autocovariances by a self-join on positions."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""
SELECT *, CASE WHEN hac_se > 0 THEN estimate / hac_se END AS t_stat,
       estimate - 1.959963984540054 * hac_se AS ci_lower,
       estimate + 1.959963984540054 * hac_se AS ci_upper
FROM (SELECT {keys}, any_value(estimate) AS estimate, any_value(n) AS n_months,
             sqrt(greatest(sum(g), 0)) / any_value(n) AS hac_se
      FROM (SELECT {ak}, any_value(a.m) AS estimate, any_value(a.n) AS n,
                   (CASE WHEN b.pos = a.pos THEN 1 ELSE 2 * (1 - (a.pos - b.pos) / 7.0) END)
                     * ((any_value(a.y) - any_value(a.m)) * (any_value(b.y) - any_value(b.m)))
                   AS g
            FROM ser a JOIN ser b ON {same} AND a.pos - b.pos BETWEEN 0 AND 6
            GROUP BY {ak}, a.pos, b.pos)
      GROUP BY {keys})""".replace(
        "ser a", f"({_series(source, ks, outcome, date)}) a"
    ).replace("ser b", f"({_series(source, ks, outcome, date)}) b")


def _series(source: str, ks: list[str], outcome: str, date: str) -> str:
    k = ", ".join(ks)
    return (f"SELECT {k}, {outcome} AS y, row_number() OVER (PARTITION BY {k} ORDER BY {date}) AS "
            f"pos, avg({outcome}) OVER (PARTITION BY {k}) AS m, count(*) OVER (PARTITION BY {k}) "
            f"AS n FROM {source} WHERE {outcome} IS NOT NULL")


def hac_diff(
    source: str, keys: str, outcome: str, regime: str, pairs: list[tuple[str, str]],
    date: str = "formation_date",
) -> str:
    """Difference of regime means with its HAC error, one block per pair."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    labels = sorted({r for p in pairs for r in p})
    inlist = ", ".join(f"'{r}'" for r in labels)
    parts = []
    for left, right in pairs:
        psi = (f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {date}) AS pos, "
               f"count(*) OVER (PARTITION BY {keys}) AS n, {outcome} AS y, {regime} AS r, "
               f"({outcome} - avg({outcome}) OVER (PARTITION BY {keys}, {regime})) "
               f"/ count(*) OVER (PARTITION BY {keys}, {regime}) "
               f"* (CASE {regime} WHEN '{left}' THEN 1.0 WHEN '{right}' THEN -1.0 ELSE 0.0 END) "
               f"AS psi FROM {source} WHERE {outcome} IS NOT NULL AND {regime} IN ({inlist})")
        parts.append(f"""
SELECT {keys}, '{left} - {right}' AS comparison, lm AS left_mean, rm AS right_mean,
       lm - rm AS estimated_difference, n AS n_months, sqrt(greatest(v, 0)) AS hac_se
FROM (SELECT {keys}, avg(CASE WHEN r = '{left}' THEN y END) AS lm,
             avg(CASE WHEN r = '{right}' THEN y END) AS rm, count(*) AS n
      FROM ({psi}) GROUP BY {keys})
JOIN (SELECT {', '.join('a.' + k for k in ks)},
             sum((CASE WHEN a.pos = b.pos THEN 1 ELSE 2 * (1 - (a.pos - b.pos) / 7.0) END)
                 * a.psi * b.psi) AS v
      FROM ({psi}) a JOIN ({psi}) b ON {same} AND a.pos - b.pos BETWEEN 0 AND 6
      GROUP BY {', '.join('a.' + k for k in ks)}) USING ({keys})""")
    body = " UNION ALL ".join(parts)
    return f"""
SELECT *, CASE WHEN hac_se > 0 THEN estimated_difference / hac_se END AS t_stat,
       estimated_difference - 1.959963984540054 * hac_se AS ci_lower,
       estimated_difference + 1.959963984540054 * hac_se AS ci_upper FROM ({body})"""


table("ls_means", hac_mean("(SELECT * FROM dwide_r WHERE regime_definition <> 'binary')",
                           "model, weighting, regime_definition, regime", "D10_minus_D1"))
table("ic_means", hac_mean("(SELECT * FROM ic_r WHERE regime_definition <> 'binary')",
                           "model, regime_definition, regime", "spearman_ic"))
_PAIRS3 = [("MIDDLE", "LOW"), ("HIGH", "LOW"), ("HIGH", "MIDDLE")]
table("ls_diffs", hac_diff("dwide", "model, weighting", "D10_minus_D1", "regime_3state", _PAIRS3))
table("ic_diffs", hac_diff("ic_plain", "model", "spearman_ic", "regime_3state", _PAIRS3))


def adjusted(source: str, family: str, p: str = "raw_p_value") -> str:
    """Holm and Benjamini-Hochberg values by comparing every test with its family."""
    ks = [k.strip() for k in family.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    return f"""
WITH tests AS (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY {p}) AS k,
                      count(*) OVER (PARTITION BY {family}) AS m FROM ({source}))
SELECT a.*, (SELECT least(1.0, max((b.m - b.k + 1) * b.{p})) FROM tests b
             WHERE {same} AND b.k <= a.k) AS holm_p_value,
       (SELECT least(1.0, min(b.{p} * b.m / b.k)) FROM tests b
        WHERE {same} AND b.k >= a.k) AS bh_fdr_p_value
FROM tests a"""


table("ls_diffs_adj", adjusted(f"SELECT *, {erfc_p('t_stat')} AS raw_p_value FROM ls_diffs",
                               "model, weighting"))
table("ic_diffs_adj", adjusted(f"SELECT *, {erfc_p('t_stat')} AS raw_p_value FROM ic_diffs",
                               "model"))

# --- panel in long form and monthly moments --------------------------------------------
table("panelvars", " UNION ALL ".join(
    f"SELECT permno, formation_date, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM panel"
    for v in ("book_equity", "me_dec", "book_to_market", "log_me", "mom_12_2",
              "next_month_return", "me", "ret", "prc", "shrout", "me_lag")))

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(sql: str, found: list[str], above: tuple[str, ...] = ()) -> None:
    for word in dict.fromkeys(_WORD.findall(re.sub(r"'[^']*'", "", sql))):
        if word in TABLES and word not in found and word not in above:
            _needed(TABLES[word], found, (*above, word))
            found.append(word)


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the fragments it uses, in dependency order."""
    found: list[str] = []
    _needed(sql, found)
    if not found:
        return sql
    parts = ",\n".join(f"{n} AS ({TABLES[n]})" for n in found)
    return f"WITH {parts}\n{sql}"
