"""Economic value of stored predictions: sorts, returns, rank IC and summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame

from monthloom.operators import contracts, costs, inference, portfolios, rank_ic, reports, summaries
from monthloom.operators.regimes import (
    attach_three_state, expanding_regimes, regime_validation, transition_counts,
)
from monthloom.operators.reshape import prediction_export
from monthloom.schema import FORMATION
from monthloom.sources.sinks import write_csv, write_parquet
from monthloom.staging import frees_staged, stage


@frees_staged
def run_three_regime_value(
    predictions: DataFrame, index_monthly: DataFrame, out: str
) -> dict[str, str]:
    """Three-state regimes, strict deciles, decile returns, rank IC and their summaries."""
    contracts.enforce(
        contracts.duplicate_keys(predictions, ["permno", FORMATION]), "Duplicate predictions"
    )
    contracts.enforce_rows(predictions, {
        "Value-weight date is not the previous month end":
            contracts.value_weight_date_ok(FORMATION),
        "Realized date is not the next month end": contracts.target_date_ok(),
    })
    regimes = stage(expanding_regimes(index_monthly), "regimes")
    rows = stage(attach_three_state(predictions, regimes), "predictions")
    assignments = stage(portfolios.assign_from_wide(rows, strict=True), "assignments")
    deciles = stage(portfolios.decile_returns_long(assignments), "deciles")
    wide = stage(portfolios.decile_returns_wide(deciles, strict=True), "decile_returns")
    monthly_ic = stage(rank_ic.monthly_rank_ic(rows), "rank_ic")
    spread, ic = summaries.spread_summary(wide), summaries.rank_ic_summary(monthly_ic)
    profiles = summaries.decile_profiles(deciles)
    written = {
        "assignments": write_parquet(assignments, f"{out}/portfolio_assignments"),
        "decile_returns": write_parquet(wide, f"{out}/decile_returns_monthly"),
        "long_short": write_parquet(portfolios.long_short(wide), f"{out}/long_short_returns"),
        "rank_ic": write_parquet(monthly_ic, f"{out}/rank_ic_monthly"),
    }
    tables = {
        "volatility_regimes": regimes,
        "portfolio_summary": spread,
        "rank_ic_summary": ic,
        "decile_profiles": profiles,
        "monotonicity": summaries.monotonicity(profiles),
        "regime_validation": regime_validation(regimes, rows),
        "regime_transitions": transition_counts(regimes),
        "central_summary": summaries.central_summary(spread, ic),
        "cumulative_spread": summaries.cumulative_returns(
            wide, ["model", "weighting"], "D10_minus_D1"
        ),
    }
    written.update({name: write_csv(df, f"{out}/{name}") for name, df in tables.items()})
    return written


@frees_staged
def run_binary_value(predictions: DataFrame, out: str, bps: float = 50.0) -> dict[str, str]:
    """Tie-preserving sorts with turnover and costs, and their HAC tables."""
    contracts.enforce_rows(predictions, {
        "Value-weight date is not the previous month end": contracts.value_weight_date_ok("date"),
    })
    monthly = stage(costs.extreme_portfolio_returns(predictions, bps), "extreme")
    ic = stage(rank_ic.monthly_rank_correlations(predictions), "rank_ic")
    within, difference = inference.rank_ic_inference(ic)
    tables = {
        "portfolio_monthly": monthly,
        "portfolio_performance": inference.performance_summary(monthly),
        "regime_difference_tests": inference.regime_difference_tests(monthly),
        "rank_ic_by_regime": within,
        "rank_ic_difference": difference,
    }
    return {name: write_csv(df, f"{out}/{name}") for name, df in tables.items()}


@frees_staged
def run_cross_section(
    predictions: DataFrame, out: str, strict: bool = True
) -> dict[str, str]:
    """Long-form predictions to portfolios; ``strict`` skips degenerate cross-sections."""
    if strict:
        assigned, skipped = portfolios.strict_assignments(predictions)
        ic = rank_ic.monthly_rank_metrics_strict(predictions)
    else:
        assigned = portfolios.portfolio_assignments(predictions)
        skipped = portfolios.skipped_months(assigned)
        ic = rank_ic.monthly_rank_metrics(predictions)
    assigned = stage(assigned, "assignments")
    returns = stage(portfolios.decile_returns_lenient(assigned), "decile_returns")
    contracts.enforce(contracts.malformed_decile_months(assigned), "A month lacks a decile")
    contracts.enforce(contracts.spread_arithmetic_violations(
        returns.where("D10_minus_D1 IS NOT NULL")), "Spread arithmetic fails")
    spread = summaries.spread_summary_by_regime(portfolios.long_short(returns))
    tables = {
        "decile_returns": returns,
        "long_short": portfolios.long_short(returns),
        "portfolio_summary": spread,
        "regime_comparison": summaries.regime_comparison(spread),
        "rank_ic": ic,
        "skipped_months": skipped,
        "run_report": reports.portfolio_run_report(predictions, returns),
    }
    written = {
        "predictions": write_parquet(prediction_export(predictions), f"{out}/predictions"),
        "assignments": write_parquet(assigned, f"{out}/assignments"),
    }
    written.update({name: write_csv(df, f"{out}/{name}") for name, df in tables.items()})
    return written
