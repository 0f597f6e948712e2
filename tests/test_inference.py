import numpy as np
import pytest

from monthloom.operators import inference
from monthloom.operators.contracts import ContractViolation
from tests.conftest import month_ends


def matrix_hac(y, x, lags=6):
    """OLS with a Bartlett HAC covariance, in matrix form."""
    xtx = np.linalg.inv(x.T @ x)
    beta = xtx @ x.T @ y
    s = x * (y - x @ beta)[:, None]
    meat = s.T @ s
    for lag in range(1, min(lags + 1, len(y))):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, xtx @ meat @ xtx


@pytest.fixture(scope="module")
def series(make):
    rng = np.random.default_rng(5)
    n = 60
    y = rng.normal(size=n).cumsum() / 10
    states = rng.choice(["LOW", "MIDDLE", "HIGH"], n).tolist()
    months = month_ends("2010-01-31", n)
    df = make([(d, "m", float(v), s, "HIGH" if s == "HIGH" else "LOW")
               for d, v, s in zip(months, y, states)],
              "formation_date DATE, model STRING, y DOUBLE, regime_3state STRING, "
              "regime_binary STRING")
    return df, y, np.array(states)


def test_mean_matches_matrix_form(series):
    df, y, _ = series
    beta, cov = matrix_hac(y, np.ones((len(y), 1)))
    row = inference.hac_means(df, ["model"], "y").first()
    assert row.estimate == pytest.approx(beta[0], abs=1e-12)
    assert row.hac_se == pytest.approx(np.sqrt(cov[0, 0]), abs=1e-12)
    assert row.ci_lower < row.estimate < row.ci_upper and row.n_months == 60


def test_differences_match_matrix_form(series):
    df, y, states = series
    x = np.column_stack([(states == s).astype(float) for s in ("LOW", "MIDDLE", "HIGH")])
    beta, cov = matrix_hac(y, x)
    at = {"LOW": 0, "MIDDLE": 1, "HIGH": 2}
    for row in inference.hac_differences(df, ["model"], "y", "regime_3state").collect():
        left, right = row.comparison.split(" - ")
        c = np.zeros(3)
        c[at[left]], c[at[right]] = 1.0, -1.0
        assert row.estimated_difference == pytest.approx(c @ beta, abs=1e-12)
        assert row.hac_se == pytest.approx(np.sqrt(c @ cov @ c), abs=1e-12)


def test_regime_mean_skips_other_months(series):
    df, y, states = series
    rows = {r.regime: r for r in inference.mean_table(df, ["model"], "y", "mean").collect()}
    part = y[states == "HIGH"]
    _, cov = matrix_hac(part, np.ones((len(part), 1)))
    assert rows["HIGH"].mean == pytest.approx(part.mean(), abs=1e-12)
    assert rows["HIGH"].hac_se == pytest.approx(np.sqrt(cov[0, 0]), abs=1e-12)
    assert set(rows) == {"OVERALL", "LOW", "MIDDLE", "HIGH"}


def test_constant_series_has_no_t(make):
    df = make([(d, "m", 0.5) for d in month_ends("2010-01-31", 8)],
              "formation_date DATE, model STRING, y DOUBLE")
    row = inference.hac_means(df, ["model"], "y").first()
    assert row.hac_se == 0.0 and row.t_stat is None and row.p_value is None
    assert row.significance == ""


def test_binary_difference_sign(make):
    df = make([(d, "m", 0.02 * (i % 2), "LOW" if i % 2 else "HIGH")
               for i, d in enumerate(month_ends("2010-01-31", 12))],
              "date DATE, model STRING, v DOUBLE, regime STRING")
    row = inference.low_minus_high_tests(df, ["model"], "v").first()
    assert (row.high_mean, row.low_mean) == (0.0, pytest.approx(0.02))
    assert row.low_minus_high > 0


def test_holm_and_benjamini_hochberg(make, rows_of):
    df = make([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.20), ("g", "a", 0.9)],
              "family STRING, test STRING, raw_p_value DOUBLE")
    got = rows_of(inference.adjust_p_values(df, ["family"]), ("family", "test"),
                  ("holm_p_value", "bh_fdr_p_value"))
    for test, holm, bh in (("a", 0.03, 0.03), ("b", 0.08, 0.06), ("c", 0.20, 0.20)):
        assert got[("f", test)] == pytest.approx((holm, bh))
    assert got[("g", "a")] == pytest.approx((0.9, 0.9))


def test_performance_table_sizes(make):
    rows = [(d, m, w, ("HIGH", "LOW")[(i // 2) % 2], 0.01 * (i % 5), 0.4, 0.002,
             0.01 * (i % 5) - 0.002)
            for i, d in enumerate(month_ends("2010-01-31", 12))
            for m in ("Elastic Net", "XGBoost") for w in ("EW", "VW")]
    df = make(rows, "date DATE, model STRING, weighting STRING, regime STRING, "
              "gross_long_short_return DOUBLE, total_turnover DOUBLE, transaction_cost DOUBLE, "
              "net_long_short_return DOUBLE")
    assert inference.performance_summary(df).count() == 12
    assert inference.regime_difference_tests(df).count() == 8
    ic = df.where("weighting = 'EW'").withColumnRenamed("gross_long_short_return", "spearman_ic")
    within, difference = inference.rank_ic_inference(ic)
    assert (within.count(), difference.count()) == (6, 2)


@pytest.mark.parametrize("bad", [None, float("nan"), 1.5, -0.1])
def test_adjustment_needs_usable_p_values(make, bad):
    df = make([("a", 1, bad), ("a", 2, 0.01)], "family STRING, test INT, raw_p_value DOUBLE")
    with pytest.raises(ContractViolation):
        inference.adjust_p_values(df, ["family"]).count()
