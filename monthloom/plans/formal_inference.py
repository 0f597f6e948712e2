"""HAC inference on stored monthly spread and rank-IC series."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import contracts, inference
from monthloom.operators.regimes import with_regime_definitions
from monthloom.operators.reshape import union_with_panel
from monthloom.schema import MODEL_COLUMNS
from monthloom.sources.sinks import write_csv
from monthloom.staging import frees_staged, stage


def check_summaries(
    spreads: DataFrame, rank_ic: DataFrame, spread_summary: DataFrame, ic_summary: DataFrame
) -> None:
    """Stored descriptive means and month counts must follow from the series."""
    kept = F.col("regime_definition") != "binary"
    part = ["overall", "three_state"]
    contracts.enforce_all({
        "Stored spread summary disagrees with the series": contracts.summary_mismatches(
            spread_summary.where(kept), with_regime_definitions(spreads, part),
            ["model", "weighting", "regime_definition", "regime"], "mean_D10_minus_D1",
            "D10_minus_D1",
        ),
        "Stored rank-IC summary disagrees with the series": contracts.summary_mismatches(
            ic_summary.where(kept), with_regime_definitions(rank_ic, part),
            ["model", "regime_definition", "regime"], "mean_spearman", "spearman_ic",
        ),
    })


@frees_staged
def run_formal_inference(
    spreads: DataFrame, rank_ic: DataFrame, out: str,
    spread_summary: DataFrame | None = None, ic_summary: DataFrame | None = None,
) -> dict[str, str]:
    """Validate the series, test means and differences, and write every table."""
    models = list(MODEL_COLUMNS)
    ls = stage(contracts.check_monthly_series(
        spreads, ["model", "weighting"], "D10_minus_D1", models), "spreads")
    ic = stage(contracts.check_monthly_series(
        rank_ic, ["model"], "spearman_ic", models), "rank_ic")
    if spread_summary is not None and ic_summary is not None:
        check_summaries(ls, ic, spread_summary, ic_summary)
    means, ic_means = inference.long_short_inference(ls), inference.rank_ic_inference_table(ic)
    diffs, ic_diffs = inference.long_short_differences(ls), inference.rank_ic_differences(ic)
    both = ["model", "weighting"]
    tables = {
        "long_short_hac_inference": means,
        "long_short_regime_differences": diffs,
        "rank_ic_hac_inference": ic_means,
        "rank_ic_regime_differences": ic_diffs,
        "binary_regime_hac_inference": union_with_panel({
            "D10_minus_D1": inference.binary_means(ls, both, "D10_minus_D1"),
            "spearman_ic": inference.binary_means(ic, ["model"], "spearman_ic"),
        }, "outcome"),
        "binary_regime_difference": union_with_panel({
            "D10_minus_D1": inference.binary_differences(ls, both, "D10_minus_D1"),
            "spearman_ic": inference.binary_differences(ic, ["model"], "spearman_ic"),
        }, "outcome"),
        "publication_inference_table": union_with_panel({
            "D10-D1 mean inference": means, "D10-D1 regime differences": diffs,
            "Rank IC mean inference": ic_means, "Rank IC regime differences": ic_diffs,
        }),
    }
    return {name: write_csv(df, f"{out}/{name}") for name, df in tables.items()}
