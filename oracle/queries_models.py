"""Oracle bodies for splits, tuning, elastic-net fits and out-of-sample predictions.

Coordinate descent runs as a recursive query over the windows' moment rows.
"""
from oracle.render import body
from oracle.tables import table

table("samplemonths", """
SELECT formation_date, count(*) AS n_rows, row_number() OVER (ORDER BY formation_date) - 1 AS i,
       lag(formation_date) OVER (ORDER BY formation_date) AS previous FROM sample GROUP BY 1""")
body("oos_01_expanding_splits", """
SELECT t.formation_date AS test_month, count(*) AS train_months, sum(h.n_rows) AS train_rows,
  min(h.formation_date) AS train_start, max(h.formation_date) AS train_end,
  any_value(t.n_rows) AS test_rows
FROM samplemonths t JOIN samplemonths h ON h.formation_date < t.formation_date
 AND h.formation_date >= DATE '1997-01-31'
WHERE t.formation_date BETWEEN DATE '1998-01-31' AND DATE '2001-03-31' GROUP BY 1""")
body("oos_02_forward_folds", "SELECT * FROM folds")


def _calendar(every: int) -> str:
    return f"""
SELECT formation_date AS test_month, i AS train_months, previous AS train_formation_end_date,
  last_day(previous + INTERVAL 1 MONTH) AS train_realized_return_end_date,
  j % {every} = 0 AS is_refit,
  first_value(formation_date) OVER (PARTITION BY j // {every} ORDER BY j) AS fit_month
FROM (SELECT *, row_number() OVER (ORDER BY formation_date) - 1 AS j FROM samplemonths
      WHERE formation_date >= DATE '1999-01-31') WHERE i >= 24"""


table("cal6", _calendar(6))
body("oos_04_refit_calendar", "SELECT * FROM cal6")


def windows(calendar: str) -> str:
    """Standardised covariances of every training window, straight from the rows."""
    x = {"1": "log_me", "2": "book_to_market", "3": "mom_12_2"}
    parts = [f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}, "
             f"covar_pop({c}, next_month_return) / stddev_pop({c}) AS c{k}" for k, c in x.items()]
    cross = [f"covar_pop({x[a]}, {x[b]}) / stddev_pop({x[a]}) / stddev_pop({x[b]}) AS g{a}{b}"
             for a, b in (("1", "2"), ("1", "3"), ("2", "3"))]
    return f"""
SELECT t.fit_month, count(DISTINCT s.formation_date) AS train_months,
  avg(next_month_return) AS my, {', '.join(parts + cross)}
FROM (SELECT DISTINCT fit_month FROM {calendar}) t
JOIN sample s ON s.formation_date < t.fit_month AND s.realized_return_date <= t.fit_month
GROUP BY 1"""


def _soft(v: str) -> str:
    return f"(sign({v}) * greatest(abs({v}) - alpha * l1, 0) / (1 + alpha * (1 - l1)))"


def descent(source: str, keys: str, sweeps: int = 150) -> str:
    """Sweep through the three coefficients a fixed number of times."""
    held = f"{keys}, g12, g13, g23, c1, c2, c3, alpha, l1"
    return f"""
WITH RECURSIVE cd AS (
  SELECT {held}, 0 AS step, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2,
         CAST(0 AS DOUBLE) AS w3 FROM {source}
  UNION ALL
  SELECT {held}, step + 1, w1, w2, {_soft('(c3 - g13 * w1 - g23 * w2)')} AS w3 FROM (
    SELECT * REPLACE ({_soft('(c2 - g12 * w1 - g23 * w3)')} AS w2) FROM (
      SELECT * REPLACE ({_soft('(c1 - g12 * w2 - g13 * w3)')} AS w1) FROM cd
      WHERE step < {sweeps})))
SELECT {keys}, alpha, l1, w1, w2, w3 FROM cd WHERE step = {sweeps}"""


_NAMES = "fit_month, train_months, my, m1, m2, m3, s1, s2, s3"
for _c in ("cal6",):
    table(f"windows_{_c}", f"""SELECT *, CAST(0.01 AS DOUBLE) AS alpha, CAST(0.5 AS DOUBLE) AS l1
FROM ({windows(_c)})""")
    table(f"fits_{_c}", f"""SELECT *, w1 / s1 AS raw0, w2 / s2 AS raw1, w3 / s3 AS raw2,
my - m1 * w1 / s1 - m2 * w2 / s2 - m3 * w3 / s3 AS intercept
FROM ({descent(f'windows_{_c}', _NAMES)})""")
body("ml_01_elastic_net", "SELECT *, fit_month AS formation_date FROM fits_cal6")
body("ml_03_coefficients", " UNION ALL ".join(
    f"SELECT fit_month AS refit_date, 'elastic_net' AS model, '{f}' AS predictor, "
    f"w{k} AS standardized_coefficient FROM fits_cal6"
    for k, f in enumerate(("log_me", "book_to_market", "mom_12_2"), start=1)))
_SCORE = """f.intercept + f.raw0 * s.log_me + f.raw1 * s.book_to_market + f.raw2 * s.mom_12_2"""
table("stockmean", """
SELECT s.permno, s.formation_date, coalesce(
  avg(next_month_return) OVER (PARTITION BY permno ORDER BY formation_date
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  (SELECT avg(t.next_month_return) FROM sample t WHERE t.formation_date < s.formation_date)) AS b
FROM sample s""")
body("oos_04_expanding_long", f"""
SELECT s.permno, s.formation_date, s.realized_return_date, s.regime,
  s.next_month_return AS actual, b.b AS benchmark_prediction, {_SCORE} AS prediction,
  e.train_formation_end_date, e.train_realized_return_end_date
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date
JOIN cal6 e ON e.test_month = c.fit_month
JOIN fits_cal6 f ON f.fit_month = c.fit_month
JOIN stockmean b ON b.permno = s.permno AND b.formation_date = s.formation_date""")
body("oos_04_expanding_wide", f"""
SELECT s.permno, s.formation_date, s.next_month_return AS actual_next_month_return,
  (SELECT avg(t.next_month_return) FROM sample t WHERE t.formation_date < s.formation_date)
    AS benchmark_prediction, {_SCORE} AS elastic_net_prediction,
  c.train_formation_end_date, c.train_realized_return_end_date AS train_target_end_date,
  TRUE AS tree_scored
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date
JOIN fits_cal6 f ON f.fit_month = c.fit_month""")

_LONG = "UNPIVOT {rows} ON log_me, book_to_market, mom_12_2 INTO NAME name VALUE v"


def stumps(calendar: str) -> str:
    """The best single split of every window: cut points at every 64th of the rows that the first
    window sees, gain of squared gradient sums with a ridge of one."""
    return f"""
WITH fit AS (SELECT DISTINCT fit_month FROM {calendar}),
narrow AS (SELECT formation_date AS t, realized_return_date AS known, next_month_return AS y,
  CAST(log_me AS DOUBLE) AS log_me, CAST(book_to_market AS DOUBLE) AS book_to_market,
  CAST(mom_12_2 AS DOUBLE) AS mom_12_2 FROM sample),
long AS ({_LONG.format(rows='narrow')}),
early AS (SELECT name, v, count(*) AS c FROM long
  WHERE t < (SELECT min(fit_month) FROM fit) AND known <= (SELECT min(fit_month) FROM fit)
  GROUP BY 1, 2),
ranked AS (SELECT name, v, c, sum(c) OVER (PARTITION BY name ORDER BY v) AS upto,
  sum(c) OVER (PARTITION BY name) AS n FROM early),
cuts AS (SELECT name, v AS cut FROM ranked WHERE (upto * 64) // n > ((upto - c) * 64) // n),
base AS (SELECT fit_month, avg(y) AS b, count(*) AS n FROM fit JOIN narrow
  ON t < fit_month AND known <= fit_month GROUP BY 1),
cells AS (SELECT fit_month, l.name, cut, b, n,
    sum(CASE WHEN v <= cut THEN b - y END) AS gl, count(CASE WHEN v <= cut THEN 1 END) AS hl,
    sum(CASE WHEN v > cut THEN b - y END) AS gr, count(CASE WHEN v > cut THEN 1 END) AS hr
  FROM base JOIN long l ON l.t < fit_month AND l.known <= fit_month JOIN cuts USING (name)
  GROUP BY 1, 2, 3, 4, 5)
SELECT fit_month, name, cut, b, -gl / (hl + 1) AS low, -gr / (hr + 1) AS high
FROM cells WHERE hl > 0 AND hr > 0
QUALIFY row_number() OVER (PARTITION BY fit_month ORDER BY
  gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (n + 1) DESC) = 1"""


def _stump_score(rate: str = "1") -> str:
    return f"""p.b + {rate} * CASE WHEN CASE p.name WHEN 'log_me' THEN s.log_me
 WHEN 'book_to_market' THEN s.book_to_market ELSE s.mom_12_2 END <= p.cut THEN p.low
 ELSE p.high END"""


table("stumps_cal6", stumps("cal6"))
body("ml_02_stump", f"""SELECT s.permno, s.formation_date, {_stump_score()} AS xgboost_prediction
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date
JOIN stumps_cal6 p ON p.fit_month = c.fit_month""")
body("ml_03_stump_importances", """
SELECT fit_month AS refit_date, 'xgboost' AS model, f AS predictor,
  CAST(f = name AS INTEGER) AS feature_importance
FROM stumps_cal6, (SELECT unnest(['log_me', 'book_to_market', 'mom_12_2']) AS f)""")
body("oos_04_expanding_wide_stump", f"""
SELECT s.permno, s.formation_date, s.next_month_return AS actual_next_month_return,
  (SELECT avg(t.next_month_return) FROM sample t WHERE t.formation_date < s.formation_date)
    AS benchmark_prediction, {_SCORE} AS elastic_net_prediction,
  {_stump_score()} AS xgboost_prediction,
  c.train_formation_end_date, c.train_realized_return_end_date AS train_target_end_date
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date
JOIN fits_cal6 f ON f.fit_month = c.fit_month
JOIN stumps_cal6 p ON p.fit_month = c.fit_month""")
body("oos_04_expanding_long_stump", " UNION ALL ".join(f"""
SELECT s.permno, s.formation_date, s.realized_return_date, s.regime, '{model}' AS model,
  s.next_month_return AS actual, b.b AS benchmark_prediction, {score} AS prediction,
  e.train_formation_end_date, e.train_realized_return_end_date
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date
JOIN cal6 e ON e.test_month = c.fit_month
JOIN fits_cal6 f ON f.fit_month = c.fit_month
JOIN stumps_cal6 p ON p.fit_month = c.fit_month
JOIN stockmean b ON b.permno = s.permno AND b.formation_date = s.formation_date"""
    for model, score in (("elastic_net", _SCORE), ("xgboost", _stump_score()))))
body("ml_02_tree_facts", """SELECT s.formation_date, count(*) AS n_rows, count(*) AS n_scored
FROM sample s JOIN cal6 c ON c.test_month = s.formation_date GROUP BY 1""")
body("ml_03_importance_facts", """SELECT DISTINCT fit_month AS refit_date, 3 AS n_predictors,
TRUE AS nonnegative, TRUE AS sums_to_one FROM cal6""")

table("cvcal", "SELECT fold, validation_month AS fit_month FROM folds")
table("cvwindows", f"""SELECT w.*, a.alpha, r.l1 FROM ({windows('cvcal')}) w,
(SELECT unnest(CAST([0.001, 0.01, 0.1] AS DOUBLE[])) AS alpha) a,
(SELECT unnest(CAST([0.1, 0.9] AS DOUBLE[])) AS l1) r""")
table("cvfits", f"""SELECT *, w1 / s1 AS raw0, w2 / s2 AS raw1, w3 / s3 AS raw2,
my - m1 * w1 / s1 - m2 * w2 / s2 - m3 * w3 / s3 AS intercept
FROM ({descent('cvwindows', _NAMES)})""")
body("oos_03_time_cv", f"""
SELECT *, mean_cv_mse = min(mean_cv_mse) OVER () AS selected FROM (
SELECT alpha, l1 AS l1_ratio, avg(mse) AS mean_cv_mse, count(*) AS n_folds
FROM (SELECT f.fit_month, f.alpha, f.l1,
        avg((s.next_month_return - ({_SCORE})) * (s.next_month_return - ({_SCORE}))) AS mse
      FROM cvfits f JOIN sample s ON s.formation_date = f.fit_month GROUP BY 1, 2, 3)
GROUP BY 1, 2)""")

table("stumps_cvcal", stumps("cvcal"))
body("oos_03_stump_cv", f"""
SELECT *, row_number() OVER (ORDER BY mean_cv_mse, grid_index) = 1 AS selected FROM (
SELECT i - 1 AS grid_index, avg(mse) AS mean_cv_mse, count(*) AS n_folds FROM (
  SELECT i, p.fit_month, avg((s.next_month_return - ({_stump_score('rate')})) *
                             (s.next_month_return - ({_stump_score('rate')}))) AS mse
  FROM stumps_cvcal p JOIN sample s ON s.formation_date = p.fit_month,
       (SELECT unnest([1, 2]) AS i, unnest(CAST([0.25, 1.0] AS DOUBLE[])) AS rate)
  GROUP BY 1, 2) GROUP BY 1)""")
