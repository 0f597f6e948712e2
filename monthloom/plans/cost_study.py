"""Transaction-cost study on stored assignments and gross returns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import contracts, costs, inference, summaries
from monthloom.schema import FORMATION, REALIZED
from monthloom.sources.sinks import write_csv, write_parquet
from monthloom.staging import frees_staged, stage


def net_spread_series(net: DataFrame, bps: float = 50) -> DataFrame:
    """Net spreads of one scenario under the name that the inference functions expect."""
    return net.where(F.col("transaction_cost_bps") == bps).withColumnRenamed(
        "D10_minus_D1_net", "D10_minus_D1"
    )


def publication_table(net: DataFrame, bps: float = 50) -> DataFrame:
    """Cost summary of one scenario next to the HAC statistics of its net spread."""
    keys = ["model", "weighting", "regime_definition", "regime"]
    tests = inference.long_short_inference(net_spread_series(net, bps)).select(
        *keys, "hac_se", "t_stat", "p_value"
    )
    return summaries.cost_summary(
        net.where(F.col("transaction_cost_bps") == bps)
    ).where("regime_definition <> 'binary'").join(tests, keys)


def check_replication(rebuilt: DataFrame, stored: DataFrame) -> None:
    """The rebuilt gross returns, counts and labels must equal the stored ones."""
    numeric = [f"D{d}" for d in range(1, 11)] + ["D10_minus_D1"]
    exact = [f"n_D{d}" for d in range(1, 11)] + ["n_stocks", "regime_binary", "regime_3state",
                                                 REALIZED]
    contracts.enforce(
        contracts.reconcile(rebuilt, stored, [FORMATION, "model", "weighting"], numeric, exact),
        "Gross returns are not replicated",
    )


def check_inference_unchanged(fresh: DataFrame, stored: DataFrame, keys: list[str],
                              numeric: list[str]) -> None:
    contracts.enforce(
        contracts.reconcile(fresh, stored, keys, numeric, rtol=1e-9, atol=1e-11),
        "Stored inference rows differ",
    )


@frees_staged
def run_cost_study(
    assignments: DataFrame, gross: DataFrame, out: str, scenarios: tuple[float, ...] = (0, 50)
) -> dict[str, str]:
    """Rebuild, prove the replication, apply costs, test and write the tables."""
    before = {n: contracts.fingerprint(d).first() for n, d in
              (("assignments", assignments), ("gross", gross))}
    monthly, turnover, weights = costs.reconstruct(assignments)
    monthly = stage(monthly, "rebuilt")
    check_replication(monthly, gross)
    net = stage(costs.apply_cost_scenarios(monthly, scenarios), "net")
    series = net_spread_series(net, scenarios[-1])
    tables = {
        "turnover_monthly": turnover,
        "net_portfolio_returns": net,
        "transaction_cost_summary": summaries.cost_summary(net),
        "turnover_summary": summaries.turnover_summary(monthly, turnover),
        "breakeven_costs": summaries.breakeven_costs(net, scenarios[-1]),
        "net_long_short_hac_inference": inference.long_short_inference(series),
        "net_regime_differences": inference.long_short_differences(series),
        "publication_table": publication_table(net, scenarios[-1]),
        "cumulative_net_returns": summaries.cumulative_returns(
            series, ["model", "weighting"], "D10_minus_D1"
        ),
    }
    written = {"weights": write_parquet(weights, f"{out}/portfolio_weights")}
    for name, df in tables.items():
        written[name] = write_csv(df, f"{out}/{name}")
    after = {n: contracts.fingerprint(d).first() for n, d in
             (("assignments", assignments), ("gross", gross))}
    if before != after:
        raise contracts.ContractViolation("A protected input changed during the study")
    return written
