import math

import pytest
from pyspark.sql import functions as F

from monthloom.operators import contracts, costs, portfolios, rank_ic, summaries, universe
from monthloom.operators.contracts import ContractViolation
from tests.conftest import month_ends

LONG = ("formation_date DATE, realized_return_date DATE, permno BIGINT, ticker STRING, "
        "model STRING, prediction DOUBLE, actual_next_month_return DOUBLE, regime STRING, "
        "me_lag DOUBLE")


def _long(make, scores, returns=None, me=None, day="2020-01-31", nxt="2020-02-29"):
    n = len(scores)
    returns = returns or [i / 100 for i in range(n)]
    me = me or [100.0] * n
    return make([(day, nxt, i, f"T{i}", "m", scores[i], returns[i], "HIGH", me[i])
                 for i in range(n)], LONG)


@pytest.mark.parametrize(("scores", "status"), [
    ([0.5] * 20, "fewer_than_10_distinct_predictions"),
    ([0.5 + i * 1e-14 for i in range(20)], "near_constant_predictions"),
    ([float(i) for i in range(20)], "sortable"),
    ([float(i) for i in range(9)], "fewer_than_10_valid_predictions"),
])
def test_degeneracy_gate(make, scores, status):
    df = _long(make, scores)
    assert portfolios.prediction_diagnostics_by_group(df).first().prediction_status == status
    assigned, skipped = portfolios.strict_assignments(df)
    deciles = {r.decile for r in assigned.collect()}
    assert deciles == (set(range(1, 11)) if status == "sortable" else {None})
    assert skipped.count() == (0 if status == "sortable" else 1)


def test_value_weights_never_fall_back_to_equal(make):
    me = [None, -1.0, float("inf")] + [100.0] * 27
    df = portfolios.portfolio_assignments(_long(make, [float(i) for i in range(30)], me=me))
    rows = {r.weighting: r for r in portfolios.decile_returns_lenient(df).collect()}
    assert rows["VW"].D1 is None and rows["VW"].D1_n_weight == 0
    assert rows["VW"].D10_minus_D1 is None
    assert rows["EW"].D1 == pytest.approx(0.01) and rows["EW"].D1_n == 3


def test_rank_ic_signs_and_constants(make):
    up = _long(make, [float(i) for i in range(12)])
    down = _long(make, [float(-i) for i in range(12)], day="2020-02-29", nxt="2020-03-31")
    flat = _long(make, [1.0] * 12, day="2020-03-31", nxt="2020-04-30")
    got = {str(r.formation_date): r.spearman for r in rank_ic.monthly_rank_metrics_strict(
        up.unionByName(down).unionByName(flat)).collect()}
    assert got["2020-01-31"] == pytest.approx(1.0) and got["2020-02-29"] == pytest.approx(-1.0)
    assert got["2020-03-31"] is None


def test_fixed_universe(make):
    df = make([(i, "2020-01-31", me) for i, me in enumerate([600.0, 500.0, 400.0, 300.0, 200.0])]
              + [(99, "2020-01-31", 50.0), (99, "2020-02-29", 900.0)],
              "permno BIGINT, date DATE, market_equity DOUBLE")
    top = universe.top_by_market_equity(df, "2020-01-15", 5)
    assert sorted(r.permno for r in top.collect()) == [0, 1, 2, 3, 4]
    assert 99 not in {r.permno for r in universe.restrict_to_universe(df, top).collect()}
    with pytest.raises(ContractViolation):
        universe.top_by_market_equity(df, "2020-01-31", 7)


def test_sample_is_capped_and_repeatable(make):
    df = make([("2020-01-31", i) for i in range(50)] + [("2020-02-29", i) for i in range(5)],
              "formation_date DATE, permno BIGINT")
    a = {tuple(r) for r in universe.monthly_hash_sample(df, 10, 1).collect()}
    b = {tuple(r) for r in universe.monthly_hash_sample(df.repartition(7), 10, 1).collect()}
    c = {tuple(r) for r in universe.monthly_hash_sample(df, 10, 2).collect()}
    assert a == b and a != c and len(a) == 15


ASSIGN = ("formation_date DATE, realized_return_date DATE, permno BIGINT, ticker STRING, "
          "model STRING, decile INT, realized_next_month_return DOUBLE, weighting_variable DOUBLE, "
          "regime_binary STRING, regime_3state STRING")
MODELS = ("Elastic Net", "XGBoost")


def _assignments(make, months=4, per=2, swap=0, ret=lambda t, i: 0.01 * (i % 5) - 0.01 * t,
                 me=lambda t, i: 100.0 + i):
    """Ids rotate between deciles by ``swap`` places each month."""
    ends = month_ends("2020-01-31", months + 1)
    rows = []
    for t in range(months):
        for model in MODELS:
            for i in range(10 * per):
                decile = ((i + swap * t) % (10 * per)) // per + 1
                rows.append((ends[t], ends[t + 1], i + 1, f"T{i}", model, decile, ret(t, i),
                             me(t, i), ("LOW", "HIGH")[t % 2], ("LOW", "MIDDLE", "HIGH")[t % 3]))
    return make(rows, ASSIGN)


def test_target_weights(make):
    me = {1: 2.0, 2: 3.0, 3: 5.0, 4: -1.0, 5: None, 6: 9.0}
    day = ("2020-01-31", "2020-02-29")
    df = make([(*day, i, "T", "m", 1 if i <= 3 else 2, 0.1, me[i], "LOW", "LOW") for i in me],
              ASSIGN)
    got = {(r.weighting, r.permno): r.target_weight for r in costs.target_weights(df).collect()}
    assert [got[("VW", i)] for i in (1, 2, 3)] == pytest.approx([0.2, 0.3, 0.5])
    assert got[("VW", 6)] == 1.0 and ("VW", 4) not in got and ("VW", 5) not in got
    assert got[("EW", 4)] == pytest.approx(1 / 3)


def test_drift_and_turnover(make):
    day, nxt = month_ends("2020-01-31", 3), ["m"]
    rows = [(day[0], day[1], 1, "T", "m", 1, 0.10, 1.0, "LOW", "LOW"),
            (day[0], day[1], 2, "T", "m", 1, -0.10, 1.0, "LOW", "LOW"),
            (day[1], day[2], 1, "T", "m", 1, 0.0, 1.0, "LOW", "LOW"),
            (day[1], day[2], 3, "T", "m", 1, 0.0, 1.0, "LOW", "LOW")]
    df = make(rows, ASSIGN)
    weights = costs.target_weights(df)
    drift = {(str(r.formation_date), r.weighting, r.permno): r.drifted_weight
             for r in weights.collect()}
    assert drift[(day[0], "EW", 1)] == pytest.approx(0.55)
    calendar = costs.month_calendar(df)
    turn = {(str(r.formation_date), r.weighting): r.turnover for r in costs.one_way_turnover(
        costs.aligned_weights(weights, calendar), calendar).collect()}
    assert turn[(day[0], "EW")] == 1.0
    assert turn[(day[1], "EW")] == pytest.approx(0.5 * (0.05 + 0.45 + 0.5))
    assert nxt


@pytest.mark.parametrize(("swap", "expected"), [(0, 0.0), (1, 0.5), (2, 1.0)])
def test_turnover_of_rotating_portfolios(make, swap, expected):
    df = _assignments(make, swap=swap, ret=lambda t, i: 0.0)
    monthly, by_decile, audit = costs.reconstruct(df)
    later = by_decile.where("NOT initial_formation AND weighting = 'EW'").collect()
    assert {round(r.turnover, 12) for r in later} == {expected}
    assert {r.turnover for r in by_decile.where("initial_formation").collect()} == {1.0}
    assert contracts.turnover_range_violations(by_decile).count() == 0
    sums = audit.where("weighting = 'EW'").groupBy("formation_date", "model", "decile").sum(
        "target_weight").collect()
    assert {round(r[3], 12) for r in sums} == {1.0}
    assert monthly.count() == 16


def test_replication_costs_and_counts(make):
    df = _assignments(make, months=6, swap=1)
    monthly, by_decile, _ = costs.reconstruct(df)
    stored = portfolios.decile_returns_wide(portfolios.decile_returns_long(df), strict=True)
    numeric = [f"D{d}" for d in range(1, 11)] + ["D10_minus_D1"]
    assert contracts.reconcile(monthly, stored, ["formation_date", "model", "weighting"], numeric,
                               [f"n_D{d}" for d in range(1, 11)]).count() == 0
    net = costs.apply_cost_scenarios(monthly)
    first = net.orderBy("formation_date").where("transaction_cost_bps = 50").first()
    assert first.long_short_cost == pytest.approx(0.01)
    zero = net.where("transaction_cost_bps = 0")
    assert zero.where("D10_minus_D1_net <> D10_minus_D1_gross").count() == 0
    assert summaries.cost_summary(net).count() == 48
    assert summaries.breakeven_costs(net).count() == 24
    assert summaries.turnover_summary(monthly, by_decile).count() == 4 * 11 * 6
    with pytest.raises(ValueError):
        costs.apply_cost_scenarios(monthly, (-1,))


def test_future_returns_do_not_move_earlier_turnover(make):
    a = costs.reconstruct(_assignments(make, months=5, swap=1))[1]
    b = costs.reconstruct(_assignments(
        make, months=5, swap=1, ret=lambda t, i: 0.9 if t >= 3 else 0.01 * (i % 5) - 0.01 * t))[1]
    early = [f"DATE '{d}'" for d in month_ends("2020-01-31", 4)]
    keep = f"formation_date IN ({', '.join(early)})"
    key = ["formation_date", "model", "weighting", "decile"]
    assert contracts.reconcile(a.where(keep), b.where(keep), key, ["turnover"]).count() == 0


@pytest.mark.parametrize("fault", [
    "decile <> 4", "formation_date <> DATE '2020-02-29'",
    "NOT (model = 'XGBoost' AND formation_date = DATE '2020-04-30')",
])
def test_incomplete_assignments_raise(make, fault):
    with pytest.raises(ContractViolation):
        costs.reconstruct(_assignments(make).where(fault))


def test_duplicate_and_lost_capital_raise(make):
    df = _assignments(make)
    with pytest.raises(ContractViolation):
        costs.reconstruct(df.unionByName(df.limit(1)))
    with pytest.raises(ContractViolation):
        costs.reconstruct(_assignments(make, ret=lambda t, i: -1.5))
    with pytest.raises(ContractViolation):
        costs.reconstruct(_assignments(make, ret=lambda t, i: -1.0))
    with pytest.raises(ContractViolation):
        costs.reconstruct(_assignments(make, ret=lambda t, i: math.nan))


def test_infinite_returns_are_removed_before_sorting(make):
    rows = [(i, "2020-01-31", float(i), float("inf") if i == 19 else 0.01, "HIGH", 1.0)
            for i in range(20)]
    df = make(rows, "permno BIGINT, date DATE, prediction DOUBLE, actual_next_month_return DOUBLE, "
                    "regime STRING, me_lag DOUBLE")
    usable = df.filter("permno <> 19")
    frame = [x.withColumnsRenamed({"prediction": "elastic_net_prediction"})
             .withColumns({"benchmark_prediction": F.col("elastic_net_prediction"),
                           "xgboost_prediction": F.col("elastic_net_prediction")})
             for x in (df, usable)]
    got = [sorted(map(tuple, costs.extreme_portfolio_returns(x).collect())) for x in frame]
    assert got[0] == got[1] and got[0]


def test_text_predictions_sort_as_numbers(make, rows_of):
    df = make([(i, "2020-01-31", "m", str(i)) for i in range(1, 21)],
              "permno BIGINT, formation_date DATE, model STRING, prediction STRING")
    got = rows_of(portfolios.assign_deciles(df), "permno", "decile")
    assert [got[i] for i in range(1, 21)] == [(i + 1) // 2 for i in range(1, 21)]
