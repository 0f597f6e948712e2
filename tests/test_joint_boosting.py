"""Joint boosting against a plain grower, and its independence of partitions and passes."""
import datetime as dt

import numpy as np
import pytest

from monthloom.operators import boosted_trees, joint_boosting, oos, splits
from monthloom.operators.joint_boosting import DEFAULTS, FitSpec, Forests
from monthloom.schema import FEATURES
from tests.test_models import _sample

MONTHS = ["2010-10-31", "2011-01-31", "2011-04-30"]


def _specs(rows, params):
    months = [dt.date.fromisoformat(m) for m in MONTHS]
    return [FitSpec(m, (m,), p) for m in months for p in params]


def plain_cuts(x, bins):
    x = np.sort(x)
    upto = np.searchsorted(x, np.unique(x), side="right")
    before = np.concatenate([[0], upto[:-1]])
    return np.unique(x)[upto * bins // len(x) > before * bins // len(x)]


def plain_forest(pdf, spec, cuts, seed):
    """Grow one fit by itself, one node at a time; prediction, held errors and mean gains."""
    p = {**DEFAULTS, **spec.params}
    x = pdf[list(FEATURES)].to_numpy()
    y = pdf["next_month_return"].to_numpy()
    day = np.array([(d - dt.date(1970, 1, 1)).days for d in pdf["formation_date"]])
    train = ((pdf["formation_date"] < spec.month) & (pdf["realized_return_date"] <= spec.month))
    train, held = train.to_numpy(), (pdf["formation_date"] == spec.month).to_numpy()
    score = np.full(len(y), y[train].mean())
    errors, gains = [((y - score)[held] ** 2).mean()], {f: [] for f in range(x.shape[1])}
    ridge = p["reg_lambda"]
    for turn in range(p["n_estimators"]):
        rows = train.copy()
        if p["subsample"] < 1:
            rows &= joint_boosting.drawn_rows(pdf["permno"].to_numpy(), day, p["subsample"], seed,
                                              turn)
        allowed = joint_boosting.chosen_features(x.shape[1], p["colsample_bytree"], seed, turn)
        step = np.zeros(len(y))

        def grow(here, depth):
            g = (score - y)[here & rows]
            best = (1e-12, None, None)
            if depth < p["max_depth"]:
                for f in allowed:
                    for c in cuts[f]:
                        left = x[here & rows, f] <= c
                        if not 0 < left.sum() < len(left):
                            continue
                        gain = (g[left].sum() ** 2 / (left.sum() + ridge)
                                + g[~left].sum() ** 2 / ((~left).sum() + ridge)
                                - g.sum() ** 2 / (len(g) + ridge))
                        if gain > best[0] + 1e-9 * abs(best[0]):
                            best = (gain, f, c)
            if best[1] is None:
                step[here] = -p["learning_rate"] * g.sum() / (len(g) + ridge)
                return
            gains[best[1]].append(best[0])
            grow(here & (x[:, best[1]] <= best[2]), depth + 1)
            grow(here & (x[:, best[1]] > best[2]), depth + 1)

        grow(np.ones(len(y), bool), 0)
        score += step
        errors.append(((y - score)[held] ** 2).mean())
    mean = np.array([np.mean(v) if v else 0 for v in gains.values()])
    return score[held], errors, mean / mean.sum()


@pytest.fixture(scope="module")
def rows(make):
    return _sample(make, months=18, stocks=25).cache()


def _pull(forests):
    got = forests.predictions("p").toPandas().sort_values(["fit", "formation_date", "permno"])
    return got["p"].to_numpy()


def test_equals_a_plain_grower(rows):
    params = [{"n_estimators": 7}, {"n_estimators": 4, "max_depth": 3, "subsample": 1.0,
                                    "colsample_bytree": 1.0, "learning_rate": 0.3}]
    specs = _specs(rows, params)
    forests = Forests(rows, specs, FEATURES, seed=5, bins=16)
    pdf = rows.toPandas().sort_values(["formation_date", "permno"]).reset_index(drop=True)
    first = pdf[(pdf["formation_date"] < specs[0].month)
                & (pdf["realized_return_date"] <= specs[0].month)]
    cuts = [plain_cuts(first[f].to_numpy(), 16) for f in FEATURES]
    for ours, plain in zip(forests.cuts, cuts):
        assert (ours == plain).all()
    got = forests.predictions("p").toPandas()
    for i, spec in enumerate(specs):
        want, errors, shares = plain_forest(pdf, spec, cuts, 5)
        mine = got[got["fit"] == i].sort_values("permno")
        assert np.allclose(mine["p"], want, atol=1e-8)
        assert np.allclose(forests.errors[i], errors, rtol=1e-6)
        assert np.allclose(forests.importances()[i], shares, rtol=1e-5)


def test_passes_partitions_and_company_change_nothing(rows, monkeypatch):
    params = [{"n_estimators": 9}, {"n_estimators": 5, "learning_rate": 0.1}]
    want = Forests(rows, _specs(rows, params), FEATURES)
    spread = Forests(rows.repartition(7), _specs(rows, params), FEATURES)
    assert (_pull(want) == _pull(spread)).all() and want.errors == spread.errors
    monkeypatch.setattr(joint_boosting, "_FAN_IN", 2)
    monkeypatch.setattr(joint_boosting, "REFRESH", 2)
    again = Forests(rows.repartition(7), _specs(rows, params), FEATURES)
    assert np.allclose(_pull(want), _pull(again), atol=1e-15)
    alone = Forests(rows, _specs(rows, params[:1]), FEATURES)
    assert alone.errors == want.errors[::2]


def test_a_prefix_is_the_smaller_fit(rows):
    specs = _specs(rows, [{"n_estimators": 8}])
    long = Forests(rows, specs, FEATURES)
    for n in (0, 1, 5):
        short = Forests(rows, _specs(rows, [{"n_estimators": n}]), FEATURES)
        for i in range(len(specs)):
            assert short.errors[i] == long.errors[i][: n + 1]


def test_tuning_equals_single_fits(rows):
    grid = [{"n_estimators": 2, "max_depth": 1}, {"n_estimators": 6, "max_depth": 1},
            {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.2}]
    table = boosted_trees.tune(rows, grid, 3, 8).orderBy("grid_index").collect()
    folds = [r.validation_month for r in splits.forward_folds(rows, 3, 8).collect()]
    assert [r.n_folds for r in table] == [3, 3, 3] and sum(r.selected for r in table) == 1
    assert min(table, key=lambda r: (r.mean_cv_mse, r.grid_index)).selected
    for r, p in zip(table, grid):
        single = [Forests(rows, [FitSpec(m, (m,), p) for m in folds], FEATURES).errors[i][-1]
                  for i in range(len(folds))]
        assert r.mean_cv_mse == pytest.approx(np.mean(single), rel=1e-12)


def test_future_rows_change_nothing(make):
    month = dt.date(2010, 10, 31)
    a, b = _sample(make, stocks=25), _sample(make, stocks=25, late=9)
    specs = [FitSpec(month, (dt.date(2010, 9, 30),), {"n_estimators": 4})]
    one, two = Forests(a, specs, FEATURES), Forests(b, specs, FEATURES)
    assert all((x == y).all() for x, y in zip(one.cuts, two.cuts))
    assert np.allclose(_pull(one), _pull(two), atol=1e-6)  # units follow the largest target


def test_odd_windows(rows, make):
    none = Forests(rows, [FitSpec(dt.date(2009, 1, 31), (dt.date(2010, 5, 31),))], FEATURES)
    assert none.predictions("p").count() == 0 and none.importances() == [[0.0, 0.0, 0.0]]
    with pytest.raises(ValueError):
        Forests(rows, [], FEATURES)
    with pytest.raises(ValueError):
        Forests(rows, _specs(rows, [{"learning_rate": 1.5}]), FEATURES)


def test_long_form_has_a_block_per_model(rows):
    out = oos.expanding_long(rows, "2011-02-28", None, 12, 2, trees={"n_estimators": 2})
    counts = {r.model: r["count"] for r in out.groupBy("model").count().collect()}
    assert counts == {"elastic_net": 125, "xgboost": 125}
    keys = ["permno", "formation_date", "train_end", "benchmark_prediction", "actual"]
    one, two = (out.where(f"model = '{m}'").select(*keys) for m in counts)
    assert one.exceptAll(two).count() == 0
    plain = oos.expanding_long(rows, "2011-02-28", None, 12, 2)
    assert plain.exceptAll(out.where("model = 'elastic_net'")).count() == 0


def test_scores_are_held_per_cell_whatever_the_number_of_rows(rows, monkeypatch):
    specs = _specs(rows, [{"n_estimators": 2}])[-1:]
    copies = rows.crossJoin(rows.sparkSession.range(20).withColumnRenamed("id", "copy"))
    copies = copies.withColumn("permno", copies["permno"] + 100_000 * copies["copy"]).drop("copy")

    def scores(table):
        forests = Forests(table, specs, FEATURES, bins=16)
        return forests, sum(len(b["score"]) for b in forests.blocks.select("score").collect())

    one, cells = scores(rows)
    many, grown = scores(copies)
    assert grown == cells <= 8 * rows.count() and many.fits[0].rows == 20 * one.fits[0].rows
    monkeypatch.setattr(joint_boosting, "_BLOCK", 64)  # cells are cut by the ends of blocks
    cut, _ = scores(copies)
    assert cut.errors == many.errors and (_pull(cut) == _pull(many)).all()
