import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from monthloom.operators import boosted_trees, elastic_net, oos, splits
from monthloom.operators.contracts import ContractViolation
from monthloom.plans import queries_models
from tests.conftest import month_ends

SCHEMA = ("date DATE, formation_date DATE, realized_return_date DATE, permno BIGINT, "
          "ticker STRING, regime STRING, vix DOUBLE, log_me DOUBLE, book_to_market DOUBLE, "
          "mom_12_2 DOUBLE, next_month_return DOUBLE, me_lag DOUBLE, me_lag_date DATE")


def _sample(make, months=18, stocks=12, seed=1, late=None):
    rng = np.random.default_rng(seed)
    ends = month_ends("2010-01-31", months + 1)
    rows = []
    for t in range(months):
        for i in range(stocks):
            x = [float(rng.normal(5, 1)), float(rng.lognormal()), float(rng.normal(0, 0.2))]
            y = 0.02 * x[2] - 0.003 * x[0] + 0.004 * x[1] + float(rng.normal(0, 0.02))
            if late is not None and t >= late:
                y = 999.0
            rows.append((ends[t], ends[t], ends[t + 1], i, f"T{i}", "LOW", 10.0, *x, y, 50.0,
                         ends[t]))
    return make(rows, SCHEMA)


def test_expanding_splits(make):
    df = make([(d, 1) for d in month_ends("2020-01-31", 4)], "formation_date DATE, permno BIGINT")
    got = splits.expanding_splits(df, "2020-01-31", "2020-02-29", "2020-04-30").collect()
    assert len(got) == 3 and all(r.train_end < r.test_month for r in got)
    assert sorted(r.train_months for r in got) == [1, 2, 3]


@pytest.mark.parametrize(("months", "n", "floor"), [(24, 3, 12), (30, 5, 12), (14, 5, 12),
                                                    (40, 1, 12), (13, 5, 12), (12, 3, 12)])
def test_forward_folds(make, months, n, floor):
    ends = month_ends("2020-01-31", months)
    df = make([(d, p) for d in ends for p in range(4)], "formation_date DATE, permno BIGINT")
    got = splits.forward_folds(df, n, floor).orderBy("fold").collect()
    if months <= floor:
        assert got == []
        return
    last = months - 1
    spots = sorted(set(np.linspace(min(floor, last), last, min(n, last), dtype=int).tolist()))
    assert [r.validation_month.isoformat() for r in got] == [ends[s] for s in spots]
    assert [r.train_months for r in got] == spots


def test_benchmarks_ignore_the_future(make, rows_of):
    a, b = _sample(make), _sample(make, late=9)
    months = month_ends("2010-01-31", 10)
    for build in (splits.pooled_benchmark,):
        x = rows_of(build(a), "formation_date", "benchmark_prediction")
        y = rows_of(build(b), "formation_date", "benchmark_prediction")
        assert {m: x[m] for m in months} == {m: y[m] for m in months}
    key = ("permno", "formation_date")
    x = rows_of(splits.stock_benchmark(a), key, "benchmark_prediction")
    y = rows_of(splits.stock_benchmark(b), key, "benchmark_prediction")
    assert all(x[k] == y[k] for k in x if k[1] <= months[-1])


@pytest.mark.parametrize(("alpha", "l1"), [(0.001, 0.5), (0.01, 0.1), (0.0005, 0.9)])
def test_elastic_net_matches_spark_ml(make, alpha, l1):
    df = _sample(make)
    calendar = oos.refit_calendar(df, "2011-06-30", None, 6, 1)
    fit = oos.elastic_net_fits(df, calendar, alpha, l1).orderBy("formation_date").first()
    train = df.where(F.col("formation_date") < F.lit(fit.formation_date))
    sd = train.agg(F.stddev_samp("next_month_return")).first()[0]
    reg = alpha * l1 + alpha * (1 - l1) * sd
    vectors = VectorAssembler(inputCols=["log_me", "book_to_market", "mom_12_2"],
                              outputCol="x").transform(train)
    model = LinearRegression(featuresCol="x", labelCol="next_month_return", regParam=reg,
                             elasticNetParam=alpha * l1 / reg, tol=1e-12, maxIter=2000,
                             standardization=True).fit(vectors)
    ours = [fit.raw0, fit.raw1, fit.raw2]
    # Spark scales by the sample deviation, the penalty here by the population one.
    assert np.allclose(model.coefficients.toArray(), ours, atol=3e-4)


def test_unpenalised_fit_is_least_squares(make):
    df = _sample(make)
    fit = oos.elastic_net_fits(df, oos.refit_calendar(df, "2011-06-30", None, 6, 1), 0.0, 0.5)
    first = fit.orderBy("formation_date").first()
    pdf = df.where(F.col("formation_date") < F.lit(first.formation_date)).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[["log_me", "book_to_market", "mom_12_2"]]])
    beta = np.linalg.lstsq(x, pdf.next_month_return, rcond=None)[0]
    assert np.allclose([first.intercept, first.raw0, first.raw1, first.raw2], beta, atol=1e-9)


def test_tuning_scores_equal_row_level_errors(make):
    df = _sample(make, months=20)
    table = elastic_net.tune(df, [0.001, 0.05], [0.3], 3, 12)
    assert table.where("selected").count() == 1
    pdf = df.toPandas()
    folds = [r.validation_month for r in splits.forward_folds(df, 3, 12).collect()]
    for row in table.collect():
        errors = []
        for month in folds:
            tr, va = pdf[pdf.formation_date < month], pdf[pdf.formation_date == month]
            x = tr[["log_me", "book_to_market", "mom_12_2"]].to_numpy()
            y = tr.next_month_return.to_numpy()
            b0, b, _ = elastic_net.solve_moments(
                float(len(y)), x.sum(0), x.T @ x, y.sum(), x.T @ y, row.alpha, row.l1_ratio)
            p = b0 + va[["log_me", "book_to_market", "mom_12_2"]].to_numpy() @ b
            errors.append(((va.next_month_return - p) ** 2).mean())
        assert row.mean_cv_mse == pytest.approx(np.mean(errors), rel=1e-9)


def test_refit_calendar(make):
    df = _sample(make, months=12, stocks=2)
    got = oos.refit_calendar(df, "2010-03-31", None, 4, 3).orderBy("test_month").collect()
    assert [r.test_month.month for r in got] == [5, 6, 7, 8, 9, 10, 11, 12]
    assert [r.is_refit for r in got] == [True, True, False, False, True, False, False, True]
    assert [r.fit_month.month for r in got] == [5, 6, 6, 6, 9, 9, 9, 12]
    assert all(r.train_realized_return_end_date <= r.test_month for r in got)
    with pytest.raises(ValueError):
        oos.refit_calendar(df, "2010-03-31", None, 4, 0)


def test_expanding_baseline_end_to_end(make):
    df = _sample(make, months=16)
    trees = {"n_estimators": 3, "max_depth": 2}
    out, coefficients, importances = oos.expanding_baseline(
        df, "2011-01-31", None, 12, 2, {"alpha": 0.001, "l1_ratio": 0.5}, trees)
    oos.check_predictions(out)
    assert out.count() == 4 * 12
    assert coefficients.count() == 6 and importances.count() == 6
    leaked = out.withColumn("train_formation_end_date", F.col("formation_date")).withColumn(
        "train_feature_end_date", F.col("formation_date"))
    with pytest.raises(ContractViolation):
        oos.check_predictions(leaked)


def test_future_targets_do_not_move_predictions(make, rows_of):
    run = {"start": "2010-10-31", "min_train_months": 6, "every": 1}
    key = ("permno", "formation_date")
    a = rows_of(oos.expanding_long(_sample(make), **run), key, "prediction")
    b = rows_of(oos.expanding_long(_sample(make, late=12), **run), key, "prediction")
    cut = month_ends("2010-01-31", 13)[-1]
    assert a and all(a[k] == b[k] for k in a if k[1] <= cut)


def test_models_refuse_gaps(make):
    df = _sample(make).withColumn("mom_12_2", F.when(F.col("permno") > 0, F.col("mom_12_2")))
    with pytest.raises(ContractViolation):
        oos.expanding_baseline(df, "2011-01-31", None, 12)
    with pytest.raises(ContractViolation):
        elastic_net.tune(df, [0.1], [0.5], 3, 12)


def test_tree_tuning(make):
    grid = [{"n_estimators": 2, "max_depth": 1}, {"n_estimators": 3, "max_depth": 2}]
    rows = boosted_trees.tune(_sample(make, months=15), grid, 2, 12).collect()
    assert {(r.grid_index, r.n_folds) for r in rows} == {(0, 2), (1, 2)}


def test_tail_probabilities_keep_their_digits(spark):
    import math

    from monthloom.functions.scalars import two_sided_normal_p

    ts = [i / 7 for i in range(0, 260)]
    rows = spark.createDataFrame([(t, -t) for t in ts], "t DOUBLE, m DOUBLE").select(
        "t", two_sided_normal_p("t").alias("p"), two_sided_normal_p("m").alias("q")).collect()
    for r in rows:
        want = math.erfc(r.t / math.sqrt(2))
        assert abs(r.p - want) <= 1e-12 * want and r.p == r.q
    nulls = spark.createDataFrame([(None,)], "t DOUBLE").select(two_sided_normal_p("t").alias("p"))
    assert nulls.first().p is None


def test_registered_tree_queries_use_the_default_settings():
    assert queries_models._TREES == boosted_trees.DEFAULTS


def test_moments_survive_large_means(make):
    rng = np.random.default_rng(8)
    ends = month_ends("2010-01-31", 7)
    rows = [(ends[t], ends[t + 1], i, *(1e4 * s + s * rng.normal() for s in (1.0, 0.01, 50.0)),
             2e3 + 0.2 * rng.normal()) for t in range(6) for i in range(40)]
    df = make(rows, "formation_date DATE, realized_return_date DATE, permno BIGINT, log_me DOUBLE, "
                    "book_to_market DOUBLE, mom_12_2 DOUBLE, next_month_return DOUBLE")
    windows = elastic_net.expanding_moments(elastic_net.monthly_moments(df.repartition(5)))
    last = windows.orderBy(F.desc("formation_date")).first()
    n, sx, sxx, sy, sxy, syy = elastic_net._arrays(last, 3)
    pdf = df.toPandas()
    pdf = pdf[pdf.formation_date < last.formation_date]
    x = pdf[["log_me", "book_to_market", "mom_12_2"]].to_numpy()
    d = x - x.mean(axis=0)
    assert n == len(pdf)
    got = sxx / n - np.outer(sx / n, sx / n)
    assert np.allclose(np.diag(got), (d * d).mean(axis=0), rtol=1e-10)
    e = (pdf.next_month_return - pdf.next_month_return.mean()).to_numpy()
    assert np.allclose(sxy / n - sx * sy / n**2, d.T @ e / n, atol=1e-10 * d.std() * e.std())
    fit = elastic_net.fit_windows(windows, 1e-4, 0.5).orderBy(F.desc("formation_date")).first()
    p = fit.intercept + x @ np.array([fit.raw0, fit.raw1, fit.raw2])
    assert abs(p.mean() - pdf.next_month_return.mean()) < 1e-9


@pytest.mark.parametrize(("alpha", "l1"), [(0.05, 0.5), (0.05, 1.0), (0.05, 0.0), (0.0, 0.5)])
def test_duality_gap_bounds_the_objective(alpha, l1):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    x = (x - x.mean(0)) / x.std(0)
    y = y + x[:, 0] - y.mean()
    gram, target, yy = x.T @ x / 200, x.T @ y / 200, y @ y / 200
    sums = (200.0, x.sum(0), x.T @ x, y.sum(), x.T @ y, alpha, l1)

    def objective(w):
        return (((y - x @ w) ** 2).mean() / 2
                + alpha * (l1 * np.abs(w).sum() + (1 - l1) / 2 * w @ w))

    *_, best = elastic_net.solve_moments(*sums, syy=y @ y)
    assert elastic_net.duality_gap(gram, target, yy, best, alpha, l1) < 1e-10
    if alpha:
        for w in (np.zeros(4), best + 0.1):
            gap = elastic_net.duality_gap(gram, target, yy, w, alpha, l1)
            assert gap >= objective(w) - objective(best) - 1e-12


def test_an_unconverged_fit_raises():
    x = np.array([[1.0, 1.0001], [2, 2.0], [3, 2.9999], [4, 4.0]])
    y = np.array([1.0, -1, 2, 5])
    with pytest.raises(elastic_net.Unconverged):
        elastic_net.solve_moments(4.0, x.sum(0), x.T @ x, y.sum(), x.T @ y, 1e-6, 0.5, y @ y, 2)
