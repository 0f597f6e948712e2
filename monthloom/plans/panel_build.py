"""Panel construction from source tables to the validated canonical panel."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import truthy
from monthloom.operators import contracts, reports
from monthloom.operators.accounting import annual_accounting, filter_links, link_audit
from monthloom.operators.panel import build_panel, cut_to_dates, finalize_panel
from monthloom.operators.regimes import daily_to_monthly, label_binary_regime
from monthloom.schema import FEATURES, FORMATION, REALIZED, TARGET
from monthloom.sources.sinks import write_csv, write_parquet
from monthloom.staging import frees_staged, stage

REQUIRED = (
    "permno", "ticker", "gvkey", FORMATION, REALIZED, TARGET, "prc", "shrout", "me", "log_me",
    "me_lag", "accounting_datadate", "fyear", "accounting_eligibility_date", "book_equity",
    "me_dec", "book_to_market", "mom_12_2", "vix", "vix_expanding_median", "regime",
    "price_eligible", "baseline_complete_case",
)


def validate_panel(
    panel: DataFrame, reference: DataFrame | None = None, min_price: float = 5.0,
    require_regime: bool = True,
) -> DataFrame:
    """Run every hard check; returns the one-row description of the panel.

    ``require_regime=False`` leaves months after the end of the index out of the
    comparison with the reference series.
    """
    contracts.require_columns(panel, REQUIRED)
    contracts.reject_standardized_shadows(panel)
    contracts.enforce_rows(panel, {
        "Target is not month t+1": contracts.target_date_ok(),
        "Price flag breaks its rule": contracts.price_flag_ok(min_price),
        "Size identities fail": contracts.size_ok(),
        "Accounting data enters too early": contracts.accounting_timing_ok(),
        "Book-to-market identity fails": contracts.book_to_market_ok(),
    })
    reports.economic_sanity(panel)
    months = panel if require_regime else panel.where(F.col("vix").isNotNull())
    contracts.enforce_all({
        "Duplicate rows": contracts.duplicate_keys(panel, ["permno", FORMATION]),
        "Regimes break their rule": contracts.regime_month_violations(months, reference),
        "The complete-case sample is empty": panel.agg(
            F.count_if(truthy("baseline_complete_case")).alias("n")
        ).where("n = 0"),
    })
    return reports.panel_metadata(panel)


@frees_staged
def run_panel_build(
    prices: DataFrame, funda: DataFrame, links: DataFrame, index_daily: DataFrame, out: str,
    start: str, end: str, min_price: float = 5.0,
) -> Mapping[str, str]:
    """Build, validate and write the panel with its reports; returns the written paths."""
    regimes = stage(label_binary_regime(daily_to_monthly(index_daily)), "regimes")
    built = finalize_panel(build_panel(prices, funda, links, regimes, min_price), min_price)
    path = write_parquet(cut_to_dates(built, start, end), f"{out}/panel")
    panel = prices.sparkSession.read.parquet(path)
    written = {
        "panel": path,
        "metadata": write_csv(validate_panel(panel, regimes, min_price, False), f"{out}/metadata"),
    }
    tables = {
        "sample_flow": reports.sample_flow_securities(panel, min_price),
        "construction_flow": reports.sample_flow(panel, min_price),
        "missingness": reports.missingness(panel),
        "distribution": reports.distribution_report(
            panel, ["book_equity", "me_dec", *FEATURES, TARGET]
        ),
        "coverage_by_year": reports.coverage_by_year(panel),
        "coverage_by_month": reports.coverage_by_month(panel),
        "correlations": reports.predictor_correlations(panel),
        "extreme_summary": reports.extreme_summary(panel),
        "extreme_rows": reports.extreme_rows(panel),
        "construction_summary": reports.construction_summary(funda, links, panel),
        "link_codes": reports.code_distribution(links),
        "link_audit": link_audit(annual_accounting(funda), links),
    }
    for name, df in tables.items():
        written[name] = write_csv(df, f"{out}/{name}")
    return written


def candidate_firms(links: DataFrame, universe: DataFrame) -> DataFrame:
    """Firm keys of a security universe, used to reduce the fundamentals scan."""
    return filter_links(links).join(
        universe.select(F.col("permno").alias("lpermno")), "lpermno", "left_semi"
    ).select("gvkey").distinct()
