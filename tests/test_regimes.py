import pytest
from pyspark.sql import functions as F

from monthloom.operators import regimes
from monthloom.operators.contracts import ContractViolation
from tests.conftest import month_ends

VIX = [10, 12, 11, 15, 18, 14, 13, 20, 16, 17, 19, 21, 22, 18, 24, 16, 25, 20]


def _series(make, values):
    return make(list(zip(month_ends("2019-01-31", len(values)), map(float, values))),
                "date DATE, vix DOUBLE")


def test_future_change_leaves_thresholds_alone(make, rows_of):
    cols = ("vix_expanding_q33", "vix_expanding_q67", "regime_3state")
    a = rows_of(regimes.expanding_regimes(_series(make, VIX)), "date", cols)
    b = rows_of(regimes.expanding_regimes(_series(make, VIX[:17] + [999])), "date", cols)
    months = month_ends("2019-01-31", 18)
    assert {m: a[m] for m in months[:17]} == {m: b[m] for m in months[:17]}
    assert all(v[0] <= v[1] for v in a.values())


def test_min_periods_and_conflicts(make, rows_of):
    got = rows_of(regimes.expanding_regimes(_series(make, VIX), 5), "date", "regime_3state")
    months = month_ends("2019-01-31", 18)
    assert [got[m] is None for m in months] == [True] * 4 + [False] * 14
    bad = make([("2020-01-31", 1.0), ("2020-01-15", 2.0)], "date DATE, vix DOUBLE")
    with pytest.raises(ContractViolation):
        regimes.expanding_regimes(bad).count()
    with pytest.raises(ValueError):
        regimes.expanding_regimes(bad, 0)


def test_daily_to_monthly_takes_the_last_day(make, rows_of):
    df = make([("2020-01-02", 12.0), ("2020-01-31", 18.0), ("2020-02-03", 17.0),
               ("2020-02-28", 14.0)], "date DATE, vix DOUBLE")
    assert rows_of(regimes.daily_to_monthly(df), "date", "vix") == {
        "2020-01-31": 18.0, "2020-02-29": 14.0}


def test_transitions_fill_zeros(make, rows_of):
    got = rows_of(regimes.transition_counts(regimes.expanding_regimes(_series(make, VIX))),
                  ("from_regime", "to_regime"), "count")
    assert len(got) == 9 and sum(got.values()) == 17


def test_attach_refuses_changed_labels(make):
    table = regimes.expanding_regimes(_series(make, VIX))
    schema = "permno BIGINT, formation_date DATE, vix DOUBLE, regime STRING"
    row = table.orderBy("date").collect()[5]
    other = {"HIGH": "LOW", "LOW": "HIGH"}[row.regime_binary]
    good = make([(1, row.date.isoformat(), row.vix, row.regime_binary)], schema)
    assert regimes.attach_three_state(good, table).first().regime_3state == row.regime_3state
    for bad in ((row.vix, other), (row.vix + 0.1, row.regime_binary)):
        with pytest.raises(ContractViolation):
            regimes.attach_three_state(make([(1, row.date.isoformat(), *bad)], schema), table)


def test_the_last_row_of_a_date_counts(make, rows_of):
    df = make([("2020-01-31", 10.0, 1), ("2020-01-31", 9.0, 2)], "date DATE, vix DOUBLE, n INT")
    assert rows_of(regimes.label_binary_regime(df, "n"), "date", "vix") == {"2020-01-31": 9.0}
    with pytest.raises(ContractViolation):
        regimes.label_binary_regime(df).count()
    with pytest.raises(ContractViolation):
        regimes.daily_to_monthly(df).count()
    with pytest.raises(ContractViolation):
        regimes.label_binary_regime(df.withColumn("n", F.lit(1)), "n").count()
