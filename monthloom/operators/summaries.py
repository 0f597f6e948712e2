"""Summaries of monthly portfolio and rank-IC series (one row per series and month)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import finite_double, ratio, safe_corr
from monthloom.operators.regimes import with_regime_definitions
from monthloom.schema import FORMATION, N_PORTFOLIOS


def _series_stats(x: Column) -> dict[str, Column]:
    return {
        "n": F.count(x), "mean": F.avg(x), "median": F.percentile(x, 0.5),
        "sd": F.stddev_samp(x), "positive": F.avg((x > 0).cast("double")),
        "min": F.min(x), "max": F.max(x),
    }


def _sharpe(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, F.sqrt(F.lit(12.0)) * mean / sd)


def spread_summary(
    monthly: DataFrame, definitions: Sequence[str] = ("overall", "binary", "three_state")
) -> DataFrame:
    """D1, D10 and spread statistics for every series under every regime definition."""
    s = _series_stats(finite_double("D10_minus_D1"))
    return with_regime_definitions(monthly, definitions).groupBy(
        "model", "weighting", "regime_definition", "regime"
    ).agg(
        s["n"].alias("n_months"),
        F.avg(finite_double("D1")).alias("mean_D1"),
        F.avg(finite_double("D10")).alias("mean_D10"),
        s["mean"].alias("mean_D10_minus_D1"),
        s["sd"].alias("sd_D10_minus_D1"),
        (F.lit(12.0) * s["mean"]).alias("annualized_D10_minus_D1"),
        (F.sqrt(F.lit(12.0)) * s["sd"]).alias("annualized_volatility"),
        _sharpe(s["mean"], s["sd"]).alias("descriptive_sharpe"),
        s["positive"].alias("fraction_positive"),
        s["min"].alias("min_monthly_spread"),
        s["max"].alias("max_monthly_spread"),
    )


def spread_summary_by_regime(long_short: DataFrame) -> DataFrame:
    """OVERALL/HIGH/LOW summary of a spread series that carries one regime column."""
    x = finite_double("D10_minus_D1")
    rows = long_short.where(x.isNotNull()).withColumn(
        "regime", F.explode(F.array(F.lit("OVERALL"), F.col("regime")))
    ).where(F.col("regime").isin("OVERALL", "HIGH", "LOW"))
    s = _series_stats(x)
    return rows.groupBy("model", "weighting", "regime").agg(
        s["n"].alias("n_months"),
        F.avg("D1_return").alias("average_D1_monthly_return"),
        F.avg("D10_return").alias("average_D10_monthly_return"),
        s["mean"].alias("mean_monthly_D10_minus_D1"),
        s["sd"].alias("sd_monthly_D10_minus_D1"),
        (F.lit(12.0) * s["mean"]).alias("annualized_arithmetic_mean"),
        (F.sqrt(F.lit(12.0)) * s["sd"]).alias("annualized_volatility"),
        _sharpe(s["mean"], s["sd"]).alias("descriptive_sharpe"),
        s["positive"].alias("fraction_positive"),
    )


def regime_comparison(summary: DataFrame) -> DataFrame:
    """Comparison columns in the order OVERALL, HIGH, LOW."""
    order = F.when(F.col("regime") == "OVERALL", 0).when(F.col("regime") == "HIGH", 1).otherwise(2)
    return summary.select(
        "model", "regime", "weighting", order.cast("int").alias("regime_order"),
        "mean_monthly_D10_minus_D1", "annualized_arithmetic_mean", "annualized_volatility",
        "descriptive_sharpe", "fraction_positive", "n_months",
    )


def rank_ic_summary(monthly: DataFrame) -> DataFrame:
    """Mean, median, deviation and share of positive months of the IC, by regime definition."""
    s = _series_stats(finite_double("spearman_ic"))
    return with_regime_definitions(monthly).groupBy("model", "regime_definition", "regime").agg(
        s["n"].alias("n_months"), s["mean"].alias("mean_spearman"),
        s["median"].alias("median_spearman"), s["sd"].alias("sd_spearman"),
        s["positive"].alias("fraction_positive"),
    )


def rank_correlation_summary(monthly: DataFrame) -> DataFrame:
    """As above for a series with one regime column and a Pearson IC."""
    s = _series_stats(finite_double("spearman_ic"))
    rows = monthly.withColumn(
        "regime", F.explode(F.array(F.lit("OVERALL"), F.upper("regime")))
    )
    return rows.groupBy("model", "regime").agg(
        s["mean"].alias("mean_monthly_spearman_ic"), s["median"].alias("median_spearman_ic"),
        s["sd"].alias("std_spearman_ic"), s["positive"].alias("fraction_months_ic_gt_zero"),
        s["n"].alias("n_months"),
        F.avg(finite_double("pearson_ic")).alias("mean_monthly_pearson_ic"),
    ).where("n_months > 0")


def decile_profiles(deciles: DataFrame) -> DataFrame:
    """Mean return of each decile, overall and by three-state regime."""
    r = finite_double("decile_return")
    return with_regime_definitions(deciles, ["overall", "three_state"]).groupBy(
        "model", "weighting", "regime_definition", "regime", "decile"
    ).agg(F.avg(r).alias("mean_realized_return"), F.count(r).alias("n_months"))


def monotonicity(profiles: DataFrame) -> DataFrame:
    """Rank correlation of decile and mean return, and adjacent increases; ten deciles only."""
    keys = ["model", "weighting", "regime_definition", "regime"]
    # At most ten rows per profile.
    g = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, "mean_realized_return")
    avg_rank = F.rank().over(g.orderBy("mean_realized_return")) + (
        F.count(F.lit(1)).over(ties) - 1
    ) / 2.0
    up = F.col("mean_realized_return") > F.lag("mean_realized_return").over(g.orderBy("decile"))
    ranked = profiles.withColumn("__r", avg_rank.cast("double")).withColumn("__up", up)
    return ranked.groupBy(*keys).agg(
        safe_corr(F.col("decile").cast("double"), "__r").alias("decile_return_spearman"),
        F.count_if("__up").alias("adjacent_increases"),
        F.count(F.lit(1)).alias("__n"),
    ).where(F.col("__n") == N_PORTFOLIOS).drop("__n").withColumn(
        "adjacent_comparisons", F.lit(9)
    )


def central_summary(spread: DataFrame, ic: DataFrame) -> DataFrame:
    """Three-state spread summary next to the mean rank IC of the same state."""
    rank = ic.where("regime_definition = 'three_state'").select(
        "model", "regime", F.col("mean_spearman").alias("mean_rank_ic")
    )
    return spread.where("regime_definition = 'three_state'").join(
        rank, ["model", "regime"], "left"
    ).select(
        "model", "weighting", "regime", "n_months", "mean_D1", "mean_D10", "mean_D10_minus_D1",
        "annualized_D10_minus_D1", "annualized_volatility", "descriptive_sharpe",
        "fraction_positive", "mean_rank_ic",
    )


def turnover_summary(monthly: DataFrame, by_decile: DataFrame) -> DataFrame:
    """Turnover distribution per decile and for the spread, by regime definition."""
    facts = [FORMATION, "model", "weighting", "regime_binary", "regime_3state"]
    spread = monthly.select(
        *facts, F.lit("D10-D1").alias("decile"),
        (F.col("D10_turnover") + F.col("D1_turnover")).alias("turnover"),
    )
    rows = by_decile.select(*facts, "decile", "turnover").unionByName(spread)
    t = F.col("turnover")
    q = F.percentile(t, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95)]))
    return with_regime_definitions(rows).groupBy(
        "model", "weighting", "decile", "regime_definition", "regime"
    ).agg(
        F.count(t).alias("n_months"), F.avg(t).alias("mean_turnover"),
        F.stddev_samp(t).alias("std_turnover"), F.max(t).alias("maximum"), q.alias("__q"),
    ).withColumns({
        "p25": F.col("__q")[0], "median_turnover": F.col("__q")[1],
        "p75": F.col("__q")[2], "p95": F.col("__q")[3],
    }).drop("__q")


def cost_summary(net: DataFrame) -> DataFrame:
    """Gross and net spread, turnover and cost attrition per scenario and regime."""
    g, n = F.avg("D10_minus_D1_gross"), F.avg("D10_minus_D1_net")
    sd = F.stddev_samp("D10_minus_D1_net")
    return with_regime_definitions(net).groupBy(
        "model", "weighting", "regime_definition", "regime", "transaction_cost_bps"
    ).agg(
        F.count(F.lit(1)).alias("n_months"),
        g.alias("mean_gross_D10_minus_D1"),
        F.avg("long_short_total_turnover").alias("mean_total_turnover"),
        F.avg("long_short_cost").alias("mean_transaction_cost"),
        n.alias("mean_net_D10_minus_D1"),
        (F.lit(12.0) * g).alias("annualized_gross_arithmetic"),
        (F.lit(12.0) * n).alias("annualized_net_arithmetic"),
        (F.sqrt(F.lit(12.0)) * sd).alias("annualized_net_volatility"),
        _sharpe(n, sd).alias("descriptive_net_sharpe"),
        F.avg((F.col("D10_minus_D1_net") > 0).cast("double")).alias("fraction_net_positive"),
        (g - n).alias("cost_attrition"),
        F.when(F.abs(g) > 1e-10, (g - n) / F.abs(g)).alias("cost_attrition_ratio"),
    )


def breakeven_costs(net: DataFrame, bps: float = 50) -> DataFrame:
    """Cost level at which the mean gross spread is used up; NULL unless both are positive."""
    g, t = F.avg("D10_minus_D1_gross"), F.avg("long_short_total_turnover")
    rate = F.when((g > 0) & (t > 0), ratio(g, t))
    return with_regime_definitions(
        net.where(F.col("transaction_cost_bps") == bps)
    ).groupBy("model", "weighting", "regime_definition", "regime").agg(
        F.count(F.lit(1)).alias("n_months"), g.alias("mean_gross_spread"),
        t.alias("mean_traded_notional"), rate.alias("breakeven_cost_decimal"),
        (rate * 10000.0).alias("breakeven_cost_bps"),
    )


def cumulative_returns(
    monthly: DataFrame, keys: Sequence[str], value: str, date: str = FORMATION
) -> DataFrame:
    """Running arithmetic sum with missing months as zero."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn(
        "cumulative_return", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)
    )
