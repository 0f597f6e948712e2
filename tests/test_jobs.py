"""Stage drivers on the derived tables."""
import pytest

from monthloom.plans.cost_study import run_cost_study
from monthloom.plans.economic_value import run_binary_value, run_three_regime_value
from monthloom.plans.estimation import run_estimation, tune_models
from monthloom.plans.formal_inference import run_formal_inference
from monthloom.sources.market_tables import MarketTables
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def tables(spark):
    return MarketTables(spark, MEDIUM)


@pytest.fixture(scope="module")
def value(tables, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("value"))
    return run_three_regime_value(tables.predictions(), tables.index_monthly(), out)


def test_value_to_costs_to_inference(spark, value, tmp_path):
    read = spark.read.parquet
    wide = read(value["decile_returns"])
    written = run_cost_study(read(value["assignments"]), wide, str(tmp_path / "costs"))
    table = spark.read.option("header", True).csv(written["publication_table"])
    assert table.count() == 16
    written = run_formal_inference(wide, read(value["rank_ic"]), str(tmp_path / "inference"))
    table = spark.read.option("header", True).csv(written["publication_inference_table"])
    assert table.count() == 16 + 12 + 8 + 6


def test_binary_value(spark, tables, tmp_path):
    out = run_binary_value(tables.predictions(), str(tmp_path))
    assert spark.read.option("header", True).csv(out["portfolio_performance"]).count() == 12


def test_estimation_resumes(spark, tables, tmp_path):
    panel = tables.panel()
    best, _, _ = tune_models(tables.sample(), "1999-01-31", 2, 18, 40, alphas=[0.0001],
                             l1_ratios=[0.1, 0.5])
    settings = {"start": "2001-01-31", "min_train_months": 24, "every": 12, "elastic": best,
                "trees": {"n_estimators": 2}, "run_key": "design"}
    out = run_estimation(panel, str(tmp_path), end="2001-03-31", **settings)
    first = spark.read.parquet(out["predictions"]).toPandas()
    assert first.formation_date.nunique() == 3
    out = run_estimation(panel, str(tmp_path), end="2001-05-31", **settings)
    key = ["permno", "formation_date"]
    both = spark.read.parquet(out["predictions"]).toPandas().merge(first, on=key, how="outer",
                                                                   suffixes=("", "_first"))
    assert both.formation_date.nunique() == 5
    kept = both.elastic_net_prediction_first.notna()
    assert (both.elastic_net_prediction == both.elastic_net_prediction_first)[kept].all()
    with pytest.raises(Exception, match="another run"):
        run_estimation(panel, str(tmp_path), end="2001-03-31", **{**settings, "run_key": "other"})


def test_jobs_leave_nothing_staged(spark, tables, shared_dir, tmp_path):
    tables.predictions()

    def staged():
        return {p.name for p in shared_dir.glob("monthloom-staging/*/*")}

    before = staged()
    run_binary_value(tables.predictions(), str(tmp_path / "a"))
    assert staged() == before
    broken = tables.predictions().unionByName(tables.predictions())
    with pytest.raises(Exception, match="Duplicate"):
        run_binary_value(broken, str(tmp_path / "b"))
    assert staged() == before
