"""HAC (Newey-West, Bartlett) inference on monthly series, without matrices.

With regime dummies every mean or contrast is the sum of one influence series, so
its variance is a weighted sum of lagged products. All inputs hold one row per
series and calendar month; the windows below run over such series.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    Z_975, finite_double, ratio, significance_stars, two_sided_normal_p,
)
from monthloom.operators.contracts import enforce
from monthloom.operators.regimes import with_regime_definitions
from monthloom.schema import FORMATION, HAC_LAG, PAIRWISE


def _bartlett(series: str, window, lags: int) -> Column:
    """Per-row term whose sum over a series is the HAC variance of that sum."""
    x = F.col(series)
    out = x * x
    for lag in range(1, lags + 1):
        weight = 2.0 * (1.0 - lag / (lags + 1.0))
        out = out + F.lit(weight) * F.coalesce(x * F.lag(series, lag).over(window), F.lit(0.0))
    return out


def _statistics(df: DataFrame, estimate: str) -> DataFrame:
    se = F.sqrt(F.greatest(F.col("__var"), F.lit(0.0)))
    out = df.withColumn("hac_se", se).withColumn("t_stat", ratio(estimate, "hac_se"))
    return out.withColumns({
        "p_value": two_sided_normal_p("t_stat"),
        "ci_lower": F.col(estimate) - F.lit(Z_975) * F.col("hac_se"),
        "ci_upper": F.col(estimate) + F.lit(Z_975) * F.col("hac_se"),
    }).drop("__var")


def hac_means(
    series: DataFrame, keys: Sequence[str], outcome: str, date: str = FORMATION,
    lags: int = HAC_LAG,
) -> DataFrame:
    """Mean, HAC error, t, p and 95 % interval of each series; lags count rows in date order."""
    y = series.select(*keys, date, finite_double(outcome).alias("__y")).where(
        F.col("__y").isNotNull()
    )
    whole = Window.partitionBy(*keys)
    u = y.withColumn("__u", F.col("__y") - F.avg("__y").over(whole))
    terms = u.withColumn("__term", _bartlett("__u", whole.orderBy(date), lags))
    n = F.count(F.lit(1))
    out = terms.groupBy(*keys).agg(
        F.avg("__y").alias("estimate"),
        n.cast("bigint").alias("n_months"),
        F.when(n >= 2, F.sum("__term") / (n * n)).alias("__var"),
    )
    return _statistics(out, "estimate").withColumns({
        "hac_lag": F.lit(lags), "significance": significance_stars("p_value")
    })


def hac_differences(
    series: DataFrame, keys: Sequence[str], outcome: str, regime: str,
    pairs: Sequence[tuple[str, str]] = PAIRWISE, date: str = FORMATION, lags: int = HAC_LAG,
) -> DataFrame:
    """Differences of regime means with HAC errors from the full calendar series."""
    labels = sorted({r for pair in pairs for r in pair})
    rows = series.select(
        *keys, date, F.upper(regime).alias("__r"), finite_double(outcome).alias("__y")
    ).where(F.col("__y").isNotNull() & F.col("__r").isin(*labels))
    state = Window.partitionBy(*keys, "__r")
    centred = rows.withColumn("__n", F.count(F.lit(1)).over(state)).withColumn(
        "__u", F.col("__y") - F.avg("__y").over(state)
    )
    contrasts = F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs
    ])
    each = centred.withColumn("__c", F.explode(contrasts)).withColumn(
        "comparison", F.concat_ws(" - ", "__c.left", "__c.right")
    )
    side = F.when(F.col("__r") == F.col("__c.left"), 1.0).when(
        F.col("__r") == F.col("__c.right"), -1.0
    ).otherwise(0.0)
    psi = each.withColumn("__psi", F.col("__u") * side / F.col("__n"))
    w = Window.partitionBy(*keys, "comparison").orderBy(date)
    left = F.avg(F.when(F.col("__r") == F.col("__c.left"), F.col("__y")))
    right = F.avg(F.when(F.col("__r") == F.col("__c.right"), F.col("__y")))
    out = psi.withColumn("__term", _bartlett("__psi", w, lags)).groupBy(
        *keys, "comparison"
    ).agg(
        left.alias("left_mean"), right.alias("right_mean"),
        (left - right).alias("estimated_difference"),
        F.count(F.lit(1)).cast("bigint").alias("n_months"),
        F.sum("__term").alias("__var"),
    )
    return _statistics(out, "estimated_difference").withColumn("hac_lag", F.lit(lags))


def adjust_p_values(
    table: DataFrame, family: Sequence[str], p: str = "raw_p_value"
) -> DataFrame:
    """Holm and Benjamini-Hochberg p-values within each family of tests; all must be finite."""
    number = finite_double(p)
    enforce(table.where(number.isNull() | (number < 0) | (number > 1)),
            "Adjusted p-values need p-values between 0 and 1")
    members = Window.partitionBy(*family)
    # Ties get successive ranks; the running extremes give them the same result.
    ordered = members.orderBy(p)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    from_here = ordered.rowsBetween(0, Window.unboundedFollowing)
    k, m = F.row_number().over(ordered), F.count(F.lit(1)).over(members)
    ranked = table.withColumn("__k", k).withColumn("__m", m)
    holm = F.max((F.col("__m") - F.col("__k") + 1) * F.col(p)).over(so_far)
    bh = F.min(F.col(p) * F.col("__m") / F.col("__k")).over(from_here)
    return ranked.withColumns({
        "holm_p_value": F.least(F.lit(1.0), holm),
        "bh_fdr_p_value": F.least(F.lit(1.0), bh),
    }).drop("__k", "__m")


def mean_table(
    series: DataFrame, keys: Sequence[str], outcome: str, estimate: str,
    definitions: Sequence[str] = ("overall", "three_state"),
) -> DataFrame:
    """HAC means of every series, overall and by regime."""
    stacked = with_regime_definitions(series, definitions)
    return hac_means(stacked, [*keys, "regime_definition", "regime"], outcome).withColumnRenamed(
        "estimate", estimate
    )


def difference_table(series: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """Pairwise three-state differences with adjusted p-values and stars."""
    raw = hac_differences(series, keys, outcome, "regime_3state").withColumnRenamed(
        "p_value", "raw_p_value"
    ).drop("left_mean", "right_mean")
    out = adjust_p_values(raw, keys)
    return out.withColumns({
        "raw_significance": significance_stars("raw_p_value"),
        "adjusted_significance": significance_stars("holm_p_value"),
    })


def long_short_inference(series: DataFrame) -> DataFrame:
    return mean_table(series, ["model", "weighting"], "D10_minus_D1", "mean_monthly_return")


def rank_ic_inference_table(series: DataFrame) -> DataFrame:
    return mean_table(series, ["model"], "spearman_ic", "mean_spearman_ic")


def long_short_differences(series: DataFrame) -> DataFrame:
    return difference_table(series, ["model", "weighting"], "D10_minus_D1")


def rank_ic_differences(series: DataFrame) -> DataFrame:
    return difference_table(series, ["model"], "spearman_ic")


def binary_means(series: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    return hac_means(
        with_regime_definitions(series, ["binary"]), [*keys, "regime"], outcome
    )


def binary_differences(
    series: DataFrame, keys: Sequence[str], outcome: str, regime: str = "regime_binary"
) -> DataFrame:
    out = hac_differences(series, keys, outcome, regime, [("HIGH", "LOW")])
    return out.drop("left_mean", "right_mean").withColumn(
        "significance", significance_stars("p_value")
    )


def _with_overall(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn(
        "regime", F.explode(F.array(F.lit("OVERALL"), F.upper("regime")))
    )


def performance_summary(monthly: DataFrame, lags: int = HAC_LAG) -> DataFrame:
    """Gross and net spread performance with HAC statistics, overall and by binary regime."""
    keys = ["model", "weighting", "regime"]
    rows = _with_overall(monthly)
    gross = hac_means(rows, keys, "gross_long_short_return", "date", lags).select(
        *keys, F.col("estimate").alias("gross_mean_monthly"),
        F.col("t_stat").alias("gross_hac_t"), F.col("p_value").alias("gross_p_value"),
    )
    net = hac_means(rows, keys, "net_long_short_return", "date", lags).select(
        *keys, F.col("n_months").alias("months"), F.col("estimate").alias("net_mean_monthly"),
        F.col("t_stat").alias("net_hac_t"), F.col("p_value").alias("net_p_value"),
    )
    r = F.col("net_long_short_return")
    plain = rows.groupBy(*keys).agg(
        F.avg("total_turnover").alias("average_total_turnover"),
        F.avg("transaction_cost").alias("average_transaction_cost"),
        F.stddev_samp(r).alias("__sd"),
        F.avg((r > 0).cast("double")).alias("net_fraction_positive"),
    )
    root12 = F.sqrt(F.lit(12.0))
    return gross.join(net, keys).join(plain, keys).withColumns({
        "gross_annualized_mean": F.lit(12.0) * F.col("gross_mean_monthly"),
        "net_annualized_mean": F.lit(12.0) * F.col("net_mean_monthly"),
        "net_annualized_volatility": root12 * F.col("__sd"),
        "net_sharpe": F.when(
            F.col("__sd") > 0, root12 * F.col("net_mean_monthly") / F.col("__sd")
        ),
    }).drop("__sd")


def low_minus_high_tests(
    monthly: DataFrame, keys: Sequence[str], outcome: str, date: str = "date",
    lags: int = HAC_LAG,
) -> DataFrame:
    """LOW-HIGH difference of binary regime means."""
    out = hac_differences(monthly, keys, outcome, "regime", [("LOW", "HIGH")], date, lags)
    return out.select(
        *keys, F.col("right_mean").alias("high_mean"), F.col("left_mean").alias("low_mean"),
        F.col("estimated_difference").alias("low_minus_high"), "hac_se",
        F.col("t_stat").alias("hac_t"), "p_value",
    )


def regime_difference_tests(monthly: DataFrame, lags: int = HAC_LAG) -> DataFrame:
    """LOW-HIGH tests of gross and net spreads."""
    long = monthly.select(
        "model", "weighting", "date", "regime",
        F.explode(F.array(
            F.struct(F.lit("gross").alias("return_type"),
                     F.col("gross_long_short_return").alias("value")),
            F.struct(F.lit("net").alias("return_type"),
                     F.col("net_long_short_return").alias("value")),
        )).alias("__v"),
    ).select("model", "weighting", "date", "regime", "__v.return_type", "__v.value")
    return low_minus_high_tests(long, ["model", "weighting", "return_type"], "value", lags=lags)


def rank_ic_inference(monthly: DataFrame, lags: int = HAC_LAG) -> tuple[DataFrame, DataFrame]:
    """IC means by binary regime and the LOW-HIGH test."""
    within = hac_means(_with_overall(monthly), ["model", "regime"], "spearman_ic", "date", lags)
    return (
        within.select("model", "regime", F.col("n_months").alias("months"),
                      F.col("estimate").alias("mean_spearman_ic"), "hac_se",
                      F.col("t_stat").alias("hac_t"), "p_value"),
        low_minus_high_tests(monthly, ["model"], "spearman_ic", lags=lags),
    )
