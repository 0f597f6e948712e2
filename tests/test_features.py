import pytest

from monthloom.functions.scalars import two_sided_normal_p
from monthloom.operators import panel, transforms
from monthloom.operators.contracts import ContractViolation
from monthloom.operators.features import build_features
from monthloom.operators.regimes import label_binary_regime
from monthloom.sources import scans
from tests.conftest import month_ends

PRICES = "permno BIGINT, date DATE, ret DOUBLE, prc DOUBLE, shrout DOUBLE"


def _prices(make, rets, months=None):
    months = months or month_ends("2020-01-31", len(rets))
    return make([(1, d, r, 10.0, 100.0) for d, r in zip(months, rets, strict=True)], PRICES)


def test_next_month_return(make, rows_of):
    got = rows_of(build_features(_prices(make, [0.01, 0.02, -0.03, 0.04])), "date",
                  "next_month_return")
    assert list(dict(sorted(got.items())).values()) == [0.02, -0.03, 0.04, None]


def test_momentum_skips_the_last_month(make, rows_of):
    rets = [0.01] * 11 + [0.50, 0.90]
    months = month_ends("2020-01-31", 13)
    got = rows_of(build_features(_prices(make, rets, months)), "date", "mom_12_2")
    assert got[months[12]] == pytest.approx(1.01**11 - 1.0, abs=1e-12)
    assert all(got[m] is None for m in months[:12])


def test_total_loss_is_allowed_in_momentum(make, rows_of):
    months = month_ends("2020-01-31", 13)
    got = rows_of(build_features(_prices(make, [-1.0] + [0.01] * 12, months)), "date", "mom_12_2")
    assert got[months[12]] == -1.0


def test_calendar_gap_breaks_lead_and_lag(make, rows_of):
    df = _prices(make, [0.01, 0.03, 0.04], ["2020-01-31", "2020-03-31", "2020-04-30"])
    got = rows_of(build_features(df), "date", ("next_month_return", "me_lag"))
    assert got == {"2020-01-31": (None, None), "2020-03-31": (0.04, None),
                   "2020-04-30": (None, 1000.0)}


def test_price_screen_keeps_the_target(make):
    df = make([(1, "2020-01-31", 0.0, 10.0, 1.0), (1, "2020-02-29", -0.40, 4.0, 1.0)], PRICES)
    kept = build_features(df).where(panel.price_eligible(5.0)).collect()
    assert [r.next_month_return for r in kept] == [-0.40]


def test_future_change_leaves_the_past_alone(make, rows_of):
    months = month_ends("2019-01-31", 20)
    base = rows_of(build_features(_prices(make, [0.01 * i for i in range(20)], months)), "date",
                   "mom_12_2")
    changed = rows_of(
        build_features(_prices(make, [0.01 * i for i in range(18)] + [9.0, 9.0], months)),
        "date", "mom_12_2")
    assert {m: base[m] for m in months[:19]} == {m: changed[m] for m in months[:19]}


def test_normalise_fills_a_row_lag(make):
    df = make([(1, "2020-01-15", 0.0, -10.0, 100.0), (1, "2020-03-15", 0.0, 11.0, 100.0)],
              "PERMNO BIGINT, DATE DATE, RET DOUBLE, PRC DOUBLE, SHROUT DOUBLE")
    rows = scans.normalize_security_monthly(df, "ciz", "t").orderBy("date").collect()
    assert [(r.date.isoformat(), r.prc, r.me_lag) for r in rows] == [
        ("2020-01-31", 10.0, None), ("2020-03-31", 11.0, 1000.0)]


def test_index_csv(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text("DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2020,1,1,1,12.5\n01/03/2020,1,1,1,13.5\n"
                    "01/06/2020,1,1,1,14.5\nbad,1,1,1,15\n01/05/2020,1,1,1,x\n")
    out = scans.index_from_csv(scans.scan(spark, str(path)), "2020-01-03", "2020-01-06")
    assert sorted(r.vix for r in out.collect()) == [13.5, 14.5]
    with pytest.raises(ContractViolation):
        scans.index_from_csv(spark.createDataFrame([(1,)], "other INT"))


def test_expanding_median_uses_the_past_only(make, rows_of):
    months = month_ends("2020-01-31", 4)
    df = make(list(zip(months, [10.0, 30.0, 20.0, 100.0])), "date DATE, vix DOUBLE")
    got = rows_of(label_binary_regime(df), "date", ("vix_expanding_median", "regime"))
    assert [got[m] for m in months] == [(10.0, "LOW"), (20.0, "HIGH"), (20.0, "LOW"),
                                        (25.0, "HIGH")]


def test_standardize_and_winsorize(make):
    df = make([(i, "2020-01-31", float(i)) for i in range(1, 12)] + [(50, "2020-01-31", None),
              (1, "2020-02-29", 3.0)], "permno BIGINT, date DATE, x DOUBLE")
    z = {(r.permno, str(r.date)): r.x_z for r in
         transforms.standardize_by_month(df, ["x"]).collect()}
    assert z[(6, "2020-01-31")] == 0.0
    assert z[(1, "2020-02-29")] is None and z[(50, "2020-01-31")] is None
    w = {(r.permno, str(r.date)): r.x for r in
         transforms.winsorize_by_month(df, ["x"], 0.1, 0.9).collect()}
    assert w[(1, "2020-01-31")] == 2.0 and w[(11, "2020-01-31")] == 10.0
    assert w[(50, "2020-01-31")] is None and w[(1, "2020-02-29")] == 3.0
    with pytest.raises(ValueError):
        transforms.winsorize_by_month(df, ["x"], 0.9, 0.1)


def test_normal_p_matches_erfc(make):
    import math

    ts = [0.0, 0.1, 1.0, 1.96, 2.5, 4.0, 6.0, 12.0, -3.0]
    rows = make([(t,) for t in ts], "t DOUBLE").select("t", two_sided_normal_p("t").alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), abs=1e-14)
