import pytest
from pyspark.sql import functions as F

from monthloom.operators import panel as pn
from monthloom.operators import reports
from monthloom.operators.contracts import ContractViolation, reject_standardized_shadows
from monthloom.operators.regimes import label_binary_regime
from monthloom.plans.panel_build import run_panel_build, validate_panel
from tests.conftest import month_ends


@pytest.fixture(scope="module")
def sources(make):
    months = month_ends("2018-12-31", 31)
    prices = make(
        [(p, f"T{p}", d, 0.01 * ((i + p) % 5 - 2), 10.0, 10_000.0)
         for p in (1, 2, 3) for i, d in enumerate(months)],
        "permno BIGINT, ticker STRING, date DATE, ret DOUBLE, prc DOUBLE, shrout DOUBLE")
    funda = make([(f"00000{p}", f"{y}-12-31", y, 12, be)
                  for p in (1, 2, 3) for y, be in ((2019, 50.0), (2020, 60.0))],
                 "gvkey STRING, datadate DATE, fyear INT, fyr INT, seq DOUBLE")
    links = make([(f"00000{p}", p, "LC", "P", None, None) for p in (1, 2, 3)],
                 "gvkey STRING, lpermno BIGINT, linktype STRING, linkprim STRING, linkdt DATE, "
                 "linkenddt DATE")
    daily = make([(d, 10.0 + (i * 7) % 13) for i, d in enumerate(months)],
                 "date DATE, vix DOUBLE")
    return prices, funda, links, daily


@pytest.fixture(scope="module")
def built(sources):
    prices, funda, links, daily = sources
    return pn.finalize_panel(
        pn.build_panel(prices, funda, links, label_binary_regime(daily))).cache()


def test_annual_ratio_changes_in_june(built, rows_of):
    got = rows_of(built.where("permno = 1"), "date", "book_to_market")
    assert got["2020-05-31"] is None
    assert got["2020-06-30"] == 0.5 and got["2021-05-31"] == 0.5 and got["2021-06-30"] == 0.6


def test_valid_panel_passes(built, sources):
    row = validate_panel(built, label_binary_regime(sources[3])).first()
    assert row.rows == 93 and row.unique_permnos == 3 and row.complete_case_rows > 0
    assert pn.complete_case_sample(built).count() == row.complete_case_rows


def _at(name, value, where="permno = 2 AND date = DATE '2020-08-31'"):
    return lambda df: df.withColumn(
        name, F.when(F.expr(where), F.expr(value)).otherwise(F.col(name)))


@pytest.mark.parametrize("fault", [
    _at("realized_return_date", "DATE '2020-10-31'"),
    _at("realized_return_date", "CAST(NULL AS DATE)"),
    _at("accounting_eligibility_date", "DATE '2021-06-30'"),
    _at("book_to_market", "9.0D"),
    _at("price_eligible", "FALSE"),
    _at("me", "1.0D"),
    _at("log_me", "1.0D"),
    _at("regime", "'OTHER'"),
    _at("vix", "999.0D"),
    lambda df: df.unionByName(df.limit(1)),
    lambda df: df.withColumn("log_me_z", F.lit(0.0)),
    lambda df: df.drop("shrout"),
    lambda df: df.withColumn("baseline_complete_case", F.lit(False)),
])
def test_corrupted_panel_raises(built, sources, fault):
    with pytest.raises(ContractViolation):
        validate_panel(fault(built), label_binary_regime(sources[3]))


@pytest.mark.parametrize("fault", [
    _at("baseline_complete_case", "FALSE"),
    _at("regime", "'MIDDLE'"),
    _at("book_to_market", "DOUBLE('Infinity')"),
    lambda df: df.unionByName(df.where("baseline_complete_case").limit(1)),
    lambda df: df.withColumn("bm_available_date", F.last_day(F.add_months("date", 3))),
])
def test_corrupted_sample_raises(built, fault):
    with pytest.raises(ContractViolation):
        pn.complete_case_sample(fault(built))


def test_reference_series_must_agree(built, sources):
    other = label_binary_regime(sources[3].withColumn("vix", F.col("vix") + 0.5))
    with pytest.raises(ContractViolation):
        validate_panel(built, other)


def test_duplicate_months_raise(sources):
    prices, funda, links, daily = sources
    with pytest.raises(ContractViolation):
        pn.build_panel(prices.unionByName(prices.limit(1)), funda, links,
                       label_binary_regime(daily))


def test_finalize_requires_agreeing_dates(built):
    with pytest.raises(ContractViolation):
        pn.finalize_panel(_at("date", "DATE '2020-09-30'")(built))
    with pytest.raises(ContractViolation):
        pn.finalize_panel(built.drop("realized_return_date"))
    reject_standardized_shadows(built)


def test_observable_rows(built):
    late = pn.observable_as_of(built, "2020-06-10").agg(F.max("formation_date")).first()[0]
    assert late.isoformat() == "2020-05-31"


def test_flow_is_cumulative(built):
    rows = reports.sample_flow_securities(built).orderBy("stage_order").collect()
    counts = [r.observations for r in rows]
    assert counts[0] == 93 and counts == sorted(counts, reverse=True)
    assert counts[-1] == built.where("baseline_complete_case").count()
    assert rows[0].securities == 3


def test_unit_error_is_noticed(built):
    tiny = built.withColumn("book_to_market", F.col("book_to_market") / 1e6)
    with pytest.raises(ContractViolation):
        reports.economic_sanity(tiny)


def test_count_snapshot(built):
    audit = reports.count_audit(built, pn.model_eligible(built))
    reports.check_counts(audit, {"total_stock_months": 93, "duplicate_permno_date_rows": 0})
    with pytest.raises(ContractViolation):
        reports.check_counts(audit, {"total_stock_months": 92})


def test_panel_job_writes_reports(sources, tmp_path, spark):
    out = run_panel_build(*sources, str(tmp_path), "2019-06-30", "2021-05-31")
    assert spark.read.parquet(out["panel"]).count() == 3 * 24
    names = ("metadata", "sample_flow", "coverage_by_month", "correlations", "extreme_rows")
    assert all(spark.read.option("header", True).csv(out[n]).count() > 0 for n in names)
