"""Portfolio weights, drift, turnover and cost scenarios, as set operations.

A month's pre-trade weights depend only on the previous month's targets and returns,
so one shifted copy of the target rows replaces a walk through the months.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import bps_to_rate, finite_double, ratio, truthy
from monthloom.operators.contracts import (
    check_assignments, duplicate_keys, enforce, stage_checked, turnover_range_ok, weight_sum_ok,
)
from monthloom.operators.ordering import spread_group_stats
from monthloom.operators.portfolios import assign_tie_preserving, with_weightings
from monthloom.operators.reshape import models_to_rows
from monthloom.schema import FORMATION, N_PORTFOLIOS, REALIZED
from monthloom.staging import stage

_LEG = [FORMATION, "model", "weighting", "decile"]


def target_weights(
    assignments: DataFrame, ret: str = "realized_next_month_return",
    me: str = "weighting_variable",
) -> DataFrame:
    """Normalised weights per leg, and the same holdings after a month of returns.

    ``target_weight`` sums to one per leg; ``drifted_weight`` is the holding carried
    through the realised return and renormalised.
    """
    rows = with_weightings(assignments, ret, me)
    grown = F.col("amount") * (F.lit(1.0) + F.col(ret))
    totals = spread_group_stats(
        rows, _LEG, F.sum("amount").alias("__total"), F.sum(grown).alias("__grown")
    )
    return (
        totals.withColumn("target_weight", F.col("amount") / F.col("__total"))
        .withColumn("drifted_weight", ratio(grown, "__grown"))
        .drop("amount", "__total", "__grown")
    )


def month_calendar(rows: DataFrame, date: str = FORMATION) -> DataFrame:
    """Each model's months with the next one; one row per model and calendar month."""
    months = rows.groupBy("model", date).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("model").orderBy(date)
    return stage(
        months.select(
            "model", date,
            F.lead(date).over(w).alias("next_month"),
            (F.row_number().over(w) == 1).alias("initial_formation"),
        ),
        "months",
    )


def aligned_weights(weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Target next to pre-trade weight per security; a missing one is zero.

    Both sides are stacked and summed by key, which keeps entrants and exits without
    a full outer join.
    """
    now = weights.select(
        *_LEG, "permno", "ticker", "target_weight", F.lit(0.0).alias("pretrade_weight")
    )
    carried = (
        weights.join(calendar.where("next_month IS NOT NULL"), ["model", FORMATION])
        .select(
            F.col("next_month").alias(FORMATION), "model", "weighting", "decile", "permno",
            F.lit(None).cast("string").alias("ticker"), F.lit(0.0).alias("target_weight"),
            F.col("drifted_weight").alias("pretrade_weight"),
        )
    )
    return (
        now.unionByName(carried)
        .groupBy(*_LEG, "permno")
        .agg(
            F.max("ticker").alias("ticker"),
            F.sum("target_weight").alias("target_weight"),
            F.sum("pretrade_weight").alias("pretrade_weight"),
        )
    )


def one_way_turnover(aligned: DataFrame, calendar: DataFrame) -> DataFrame:
    """Half the L1 distance between target and pre-trade weights; the first month is 1."""
    moved = aligned.groupBy(*_LEG).agg(
        (F.sum(F.abs(F.col("target_weight") - F.col("pretrade_weight"))) * 0.5).alias("__t"),
        F.count_if(F.col("target_weight") > 0).alias("n_stocks"),
    )
    return moved.join(
        calendar.select("model", FORMATION, "initial_formation"), ["model", FORMATION]
    ).withColumn(
        "turnover", F.when(F.col("initial_formation"), F.lit(1.0)).otherwise(F.col("__t"))
    ).drop("__t")


def reconstruct(
    assignments: DataFrame, check: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Monthly gross returns with turnover, turnover by decile, and D1/D10 weight rows."""
    if check:
        check_assignments(assignments)
    weights = stage_checked(
        target_weights(assignments).select(
            *_LEG, "permno", "ticker", "realized_next_month_return", "target_weight",
            "drifted_weight",
        ),
        "weights",
        {"A leg lost all its capital": F.col("drifted_weight").isNotNull()} if check else {},
    )
    calendar = month_calendar(assignments)
    aligned = stage(aligned_weights(weights, calendar), "aligned")
    regimes = stage(
        assignments.groupBy(FORMATION, "model").agg(
            *[F.min(c).alias(c) for c in (REALIZED, "regime_binary", "regime_3state")]
        ),
        "months",
    )
    by_decile = one_way_turnover(aligned, calendar).join(
        regimes.drop(REALIZED), [FORMATION, "model"]
    )
    gross = weights.groupBy(*_LEG).agg(
        F.sum(F.col("target_weight") * F.col("realized_next_month_return")).alias("gross"),
        F.count(F.lit(1)).alias("n"),
        F.sum("target_weight").alias("weight_sum"),
        F.min("target_weight").alias("least_weight"),
    )
    legs = stage_checked(
        gross.join(by_decile.select(*_LEG, "turnover"), _LEG), "legs", {
            "Weights of a leg do not add up to one": weight_sum_ok("weight_sum", "least_weight"),
            "Turnover is outside [0, 1]": turnover_range_ok(),
        } if check else {},
    )
    deciles = range(1, N_PORTFOLIOS + 1)
    wide = legs.groupBy(FORMATION, "model", "weighting").agg(
        *[F.max(F.when(F.col("decile") == d, F.col(v))).alias(name.format(d))
          for v, name in (("gross", "D{}"), ("n", "n_D{}"), ("turnover", "D{}_turnover"))
          for d in deciles],
        F.sum("n").alias("n_stocks"),
    ).withColumn("D10_minus_D1", F.col("D10") - F.col("D1"))
    monthly = wide.join(regimes, [FORMATION, "model"])
    decile_label = F.concat(F.lit("D"), F.col("decile").cast("string"))
    audit = (
        aligned.where(F.col("decile").isin(1, N_PORTFOLIOS))
        .join(regimes.drop(REALIZED), [FORMATION, "model"])
        .join(calendar.select("model", FORMATION, "initial_formation"), ["model", FORMATION])
        .withColumn(
            "absolute_weight_change", F.abs(F.col("target_weight") - F.col("pretrade_weight"))
        )
        .withColumn("decile", decile_label)
    )
    return monthly, by_decile.withColumn("decile", decile_label), audit


def apply_cost_scenarios(
    monthly: DataFrame, scenarios: Sequence[float] = (0, 50), check: bool = True
) -> DataFrame:
    """Leg costs, leg nets and the net spread for each cost level in basis points."""
    levels = F.array(*[
        F.struct(F.lit(int(b) if float(b).is_integer() else float(b)).alias("bps"),
                 F.lit(bps_to_rate(b)).alias("rate")) for b in scenarios
    ])
    rows = monthly.withColumn("__s", F.explode(levels))
    rate = F.col("__s.rate")
    out = rows.select(
        FORMATION, REALIZED, "model", "weighting", "regime_binary", "regime_3state",
        F.col("D1").alias("D1_gross"), F.col("D10").alias("D10_gross"),
        F.col("D10_minus_D1").alias("D10_minus_D1_gross"), "D1_turnover", "D10_turnover",
        F.col("__s.bps").alias("transaction_cost_bps"),
        (F.col("D1_turnover") * rate).alias("D1_cost"),
        (F.col("D10_turnover") * rate).alias("D10_cost"),
    ).withColumns({
        "D1_net": F.col("D1_gross") - F.col("D1_cost"),
        "D10_net": F.col("D10_gross") - F.col("D10_cost"),
        "D1_short_leg_net_contribution": -F.col("D1_gross") - F.col("D1_cost"),
        "long_short_total_turnover": F.col("D10_turnover") + F.col("D1_turnover"),
        "long_short_cost": F.col("D10_cost") + F.col("D1_cost"),
    }).withColumn("D10_minus_D1_net", F.col("D10_minus_D1_gross") - F.col("long_short_cost"))
    if check:
        out = stage_checked(out, "net", {
            "Cost accounting identities fail": ~truthy(_cost_identity_breach())
        })
    return out


def _cost_identity_breach() -> Column:
    legs = F.col("D10_net") + F.col("D1_short_leg_net_contribution")
    return (
        (F.col("D1_cost") < 0) | (F.col("D10_cost") < 0)
        | (F.abs(legs - F.col("D10_minus_D1_net"))
           > 1e-12 + 1e-10 * F.abs("D10_minus_D1_net"))
        | ((F.col("transaction_cost_bps") == 0)
           & (F.col("D10_minus_D1_net") != F.col("D10_minus_D1_gross")))
        | (F.col("D10_minus_D1_net") > F.col("D10_minus_D1_gross") + 1e-12)
    )


def cost_identity_violations(net: DataFrame) -> DataFrame:
    return net.where(_cost_identity_breach()).select(
        FORMATION, "model", "weighting", "transaction_cost_bps")


def extreme_portfolio_returns(
    predictions: DataFrame, bps: float = 50.0, k: int = N_PORTFOLIOS, check: bool = True
) -> DataFrame:
    """Long-short returns, turnover and net returns from tie-preserving sorts.

    Holdings without a finite realised return drop out of the drifted weights.
    """
    if check:
        enforce(duplicate_keys(predictions, ["permno", "date"]), "Duplicate prediction rows")
    long = models_to_rows(predictions)
    rate = bps_to_rate(bps)
    rows = assign_tie_preserving(
        long.withColumn(FORMATION, F.col("date")).where(
            finite_double("actual_next_month_return").isNotNull()
        ),
        k=k, out="decile",
    )
    ends = rows.where(F.col("decile").isin(1, k)).select(
        FORMATION, "model", "decile", "permno", F.lit(None).cast("string").alias("ticker"),
        "regime", "actual_next_month_return", "me_lag",
    )
    weights = stage(target_weights(ends, "actual_next_month_return", "me_lag"), "weights")
    calendar = month_calendar(ends)
    turn = one_way_turnover(aligned_weights(weights, calendar), calendar)
    gross = weights.groupBy(*_LEG).agg(
        F.sum(F.col("target_weight") * F.col("actual_next_month_return")).alias("gross"),
        F.count(F.lit(1)).alias("n"),
        F.upper(F.min("regime")).alias("regime"),
        F.sum("target_weight").alias("weight_sum"),
        F.min("target_weight").alias("least_weight"),
    )
    legs = gross.join(turn.select(*_LEG, "turnover"), _LEG)
    if check:
        legs = stage_checked(legs, "legs", {
            "Weights of a leg do not add up to one": weight_sum_ok("weight_sum", "least_weight"),
            "Turnover is outside [0, 1]": turnover_range_ok(),
        })

    def leg(value: str, side: int):
        return F.max(F.when(F.col("decile") == side, F.col(value)))

    out = legs.groupBy(F.col(FORMATION).alias("date"), "model", "weighting").agg(
        F.min("regime").alias("regime"),
        leg("n", k).alias("n_long"),
        leg("n", 1).alias("n_short"),
        (leg("gross", k) - leg("gross", 1)).alias("gross_long_short_return"),
        leg("turnover", k).alias("long_turnover"),
        leg("turnover", 1).alias("short_turnover"),
    )
    if check:
        out = stage_checked(out, "extremes", {
            "An extreme portfolio is empty": F.expr("n_long IS NOT NULL AND n_short IS NOT NULL"),
        })
    return out.withColumn(
        "total_turnover", F.col("long_turnover") + F.col("short_turnover")
    ).withColumn("transaction_cost", F.lit(rate) * F.col("total_turnover")).withColumn(
        "net_long_short_return", F.col("gross_long_short_return") - F.col("transaction_cost")
    )
