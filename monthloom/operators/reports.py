"""Panel and prediction reports. Row-sized inputs are reduced by map-side aggregates;
exact quantiles come from the distributed ordering operator."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    finite_double, ratio, safe_corr, safe_double, truthy,
)
from monthloom.operators.contracts import ContractViolation, enforce, stage_checked
from monthloom.operators.ordering import (
    average_ranks, grouped_quantiles, ordered_index, side_by_side,
)
from monthloom.operators.panel import features_complete
from monthloom.operators.reshape import models_to_rows
from monthloom.schema import FEATURES, FORMATION, REALIZED, TARGET
from monthloom.staging import stage

# Reported quantiles.
PROFILE = {"p0_1": 0.001, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75,
           "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
EXTREME_VARIABLES = ("book_to_market", "mom_12_2", "me", TARGET)
_KEY = ("permno", FORMATION)


def variables_to_rows(
    df: DataFrame, names: Sequence[str], keep: Sequence[str] = _KEY
) -> DataFrame:
    """(variable, value) rows; values that are not numbers become NULL."""
    cells = [
        F.struct(F.lit(n).alias("variable"), safe_double(n).alias("value")) for n in names
    ]
    return df.select(*keep, F.explode(F.array(*cells)).alias("__v")).select(
        *keep, "__v.variable", "__v.value"
    )


def distribution_report(
    panel: DataFrame, names: Sequence[str], key: Sequence[str] = _KEY
) -> DataFrame:
    """Count, missing, moments and exact quantiles of each variable."""
    long = variables_to_rows(panel, names, key)
    v = F.col("value")
    stats = long.groupBy("variable").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return stats.join(
        grouped_quantiles(long, ["variable"], "value", PROFILE), "variable", "left"
    )


def _funnel(panel: DataFrame, stages: Sequence[tuple[str, Column]], distinct: bool) -> DataFrame:
    """Rows (and securities) left after each cumulative condition, in one pass per measure."""
    passed, keep = [], F.lit(True)
    for _, condition in stages:
        keep = keep & truthy(condition)
        passed.append(keep)
    # A row reaches stages 1..depth; counting rows by depth gives every cumulative count.
    depth = sum((p.cast("int") for p in passed[1:]), passed[0].cast("int"))
    rows = panel.withColumn("__depth", depth)
    labels = F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"))
                       for i, (name, _) in enumerate(stages, start=1)])
    wanted = panel.sparkSession.range(1).select(F.explode(labels).alias("s")).select("s.*")
    counts = rows.groupBy("__depth").agg(F.count(F.lit(1)).alias("observations"))
    measures = ["observations"]
    if distinct:
        # The deepest stage of each security decides in which stages it is counted.
        deepest = rows.groupBy("permno").agg(F.max("__depth").alias("__depth"))
        securities = deepest.groupBy("__depth").agg(F.count(F.lit(1)).alias("securities"))
        counts = counts.join(securities, "__depth", "full_outer")
        measures.append("securities")
    # One row per stage from here on: add up from the deepest stage.
    w = Window.orderBy(F.col("stage_order").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return wanted.join(
        counts.withColumnRenamed("__depth", "stage_order"), "stage_order", "left"
    ).select(
        "stage_order", "stage",
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).cast("bigint").alias(c)
          for c in measures],
    )


def sample_flow(panel: DataFrame, min_price: float = 5.0) -> DataFrame:
    """Sequential counts of the construction panel."""
    complete = features_complete()
    return _funnel(
        panel,
        [
            ("Eligible observations", F.lit(True)),
            ("Valid next-month target", F.col(TARGET).isNotNull()),
            (f"Price >= ${min_price:g}", safe_double("prc") >= min_price),
            ("Valid size", F.col("log_me").isNotNull()),
            ("Valid momentum", F.col("mom_12_2").isNotNull()),
            ("Matched link", F.col("gvkey").isNotNull()),
            ("Valid book equity", F.col("book_equity") > 0),
            ("Valid book-to-market", F.col("book_to_market").isNotNull()),
            ("Complete baseline predictor set", complete),
            ("Complete predictors + target + regime", F.col("regime").isNotNull()),
        ],
        distinct=False,
    )


def sample_flow_securities(panel: DataFrame, min_price: float = 5.0) -> DataFrame:
    """Sequential counts of rows and distinct securities of the final panel."""
    return _funnel(
        panel,
        [
            ("Eligible universe", F.lit(True)),
            ("Valid next-month target", F.col(TARGET).isNotNull()),
            (f"Price >= ${min_price:g}", F.col("price_eligible")),
            ("Valid size", F.col("log_me").isNotNull()),
            ("Valid momentum", F.col("mom_12_2").isNotNull()),
            ("Valid link", F.col("gvkey").isNotNull()),
            ("Valid book equity", F.col("book_equity") > 0),
            ("Valid book-to-market", F.col("book_to_market").isNotNull()),
            ("Valid regime", F.col("vix").isNotNull() & F.col("regime").isNotNull()),
            ("Complete baseline predictor set", F.col("baseline_complete_case")),
        ],
        distinct=True,
    )


def missingness(
    panel: DataFrame,
    names: Sequence[str] = (TARGET, "me", "log_me", "me_lag", "book_equity", "me_dec",
                            "book_to_market", "mom_12_2", "vix", "regime"),
) -> DataFrame:
    """Missing and non-missing counts per column, from one scan."""
    present = [F.count(n).alias(n) if n in panel.columns else F.lit(0).cast("bigint").alias(n)
               for n in names]
    wide = panel.agg(F.count(F.lit(1)).alias("__rows"), *present)
    long = wide.unpivot(["__rows"], list(names), "variable", "nonmissing_count")
    gone = F.col("__rows") - F.col("nonmissing_count")
    return long.select(
        "variable", gone.alias("missing_count"),
        ratio(F.lit(100.0) * gone, "__rows").alias("missing_percentage"), "nonmissing_count",
    )


def _valid_counts() -> list[Column]:
    return [
        F.count("log_me").alias("valid_size"),
        F.count("book_to_market").alias("valid_book_to_market"),
        F.count("mom_12_2").alias("valid_momentum"),
        F.count_if(truthy("baseline_complete_case")).alias("complete_baseline"),
    ]


def coverage_by_year(panel: DataFrame) -> DataFrame:
    """Rows, securities, valid counts and HIGH/LOW months per year."""
    rows = panel.withColumn("year", F.year(FORMATION).cast("int"))
    counts = rows.groupBy("year").agg(
        F.count("permno").alias("stock_month_observations"), *_valid_counts()
    )
    securities = rows.groupBy("year", "permno").agg(F.lit(1).alias("x")).groupBy("year").agg(
        F.count("permno").alias("unique_securities")
    )
    months = rows.groupBy("year", FORMATION).agg(F.max(F.upper("regime")).alias("r")).groupBy(
        "year"
    ).agg(
        F.count_if(F.col("r") == "HIGH").alias("HIGH_months"),
        F.count_if(F.col("r") == "LOW").alias("LOW_months"),
    )
    return counts.join(securities, "year").join(months, "year", "left")


def coverage_by_month(panel: DataFrame) -> DataFrame:
    """Valid counts per formation month; the panel key makes rows and securities agree."""
    return panel.groupBy(FORMATION).agg(
        F.count("permno").alias("eligible_securities"), *_valid_counts(),
        F.count_if(features_complete()).alias("all_three_predictors"),
    )


def monthly_count_range(monthly: DataFrame, count: str = "complete_baseline") -> DataFrame:
    """Minimum, median and maximum of a monthly count."""
    return monthly.agg(
        F.coalesce(F.min(count), F.lit(0)).cast("bigint").alias("minimum"),
        F.coalesce(F.percentile(count, 0.5), F.lit(0.0)).alias("median"),
        F.coalesce(F.max(count), F.lit(0)).cast("bigint").alias("maximum"),
    )


def construction_summary(funda: DataFrame, links: DataFrame, panel: DataFrame) -> DataFrame:
    """One row of counts, date ranges, coverage and match rates of a panel build."""
    f = funda.agg(
        F.count(F.lit(1)).alias("fundamentals_rows"),
        F.min("datadate").alias("fiscal_start"), F.max("datadate").alias("fiscal_end"),
        *[(F.count_if(F.col(c).isNull()) if c in funda.columns else F.lit(None).cast("bigint"))
          .alias(f"missing_{c}") for c in ("seq", "ceq", "at", "lt")],
    )
    firms = funda.select("gvkey").distinct().agg(F.count("gvkey").alias("fundamentals_firms"))
    rows = links.agg(F.count(F.lit(1)).alias("link_rows"))
    be = F.col("book_equity")
    p = panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.min("date").alias("panel_start"), F.max("date").alias("panel_end"),
        F.count_if(be.isNull()).alias("book_equity_missing_months"),
        F.count_if(be == 0).alias("book_equity_zero_months"),
        F.count_if(be < 0).alias("book_equity_negative_months"),
        F.count("book_to_market").alias("valid_book_to_market_months"),
        F.count_if(features_complete()).alias("complete_predictor_rows"),
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"coverage_{c}")
          for c in ("log_me", "mom_12_2", "book_to_market", TARGET, "regime")],
    )
    securities = panel.groupBy("permno").agg(
        F.max(F.col("gvkey").isNotNull()).alias("matched")
    ).agg(
        F.count(F.lit(1)).alias("panel_unique_permnos"),
        F.count_if(~F.col("matched")).alias("unmatched_securities"),
    )
    return side_by_side([f, firms, rows, p, securities])


def code_distribution(links: DataFrame) -> DataFrame:
    """Counts per link type and per primary code, NULL included."""
    def part(name: str) -> DataFrame:
        return links.groupBy(F.col(name).alias("code")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("field"), "code", "n"
        )
    return part("linktype").unionByName(part("linkprim"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


def _pair_rows(wide: DataFrame, scope: str, method: str) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                 F.col(f"{a}|{b}").alias("correlation")) for a, b in _PAIRS
    ]
    return wide.select(
        F.lit(scope).alias("scope"), F.lit(method).alias("method"),
        F.explode(F.array(*cells)).alias("__c"), "months", "observations",
    ).select("scope", "method", "__c.feature_1", "__c.feature_2", "__c.correlation", "months",
             "observations")


def _corr_columns() -> list[Column]:
    return [safe_corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS]


def _feature_ranks(complete: DataFrame, group: Sequence[str]) -> DataFrame:
    """Features replaced by their average ranks, through one distributed ordering."""
    long = variables_to_rows(complete, FEATURES)
    by = list(dict.fromkeys([*group, "variable"]))
    ranked = average_ranks(long, by, "value", "r", "__size")
    return ranked.groupBy(*_KEY).agg(
        *[F.max(F.when(F.col("variable") == f, F.col("r"))).alias(f) for f in FEATURES]
    )


def _complete(panel: DataFrame) -> DataFrame:
    return stage(
        panel.select(*_KEY, *[safe_double(f).alias(f) for f in FEATURES]).where(
            features_complete()
        ),
        "complete",
    )


def pooled_correlations(panel: DataFrame) -> DataFrame:
    """Pearson and Spearman correlations over all complete rows."""
    complete = _complete(panel)
    n = F.count(F.lit(1)).alias("observations")
    none = F.lit(None).cast("bigint").alias("months")
    plain = complete.agg(*_corr_columns(), n, none)
    ranked = _feature_ranks(complete, []).agg(*_corr_columns(), n, none)
    return _pair_rows(plain, "pooled", "pearson").unionByName(
        _pair_rows(ranked, "pooled", "spearman")
    )


def average_monthly_correlations(panel: DataFrame) -> DataFrame:
    """Mean over months of the cross-sectional correlations; months with n < 3 are skipped."""
    complete = _complete(panel)

    def averaged(rows: DataFrame, method: str) -> DataFrame:
        monthly = rows.groupBy(FORMATION).agg(*_corr_columns(), F.count(F.lit(1)).alias("n"))
        cells = [
            F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                     F.col(f"{a}|{b}").alias("c")) for a, b in _PAIRS
        ]
        long = monthly.where("n >= 3").select(F.explode(F.array(*cells)).alias("p")).select("p.*")
        return long.groupBy("feature_1", "feature_2").agg(
            F.avg("c").alias("correlation"), F.count("c").alias("months")
        ).select(
            F.lit("average_monthly_cross_section").alias("scope"), F.lit(method).alias("method"),
            "feature_1", "feature_2", "correlation", "months",
            F.lit(None).cast("bigint").alias("observations"),
        )

    return averaged(complete, "pearson").unionByName(
        averaged(_feature_ranks(complete, [FORMATION]), "spearman")
    )


def predictor_correlations(panel: DataFrame) -> DataFrame:
    return pooled_correlations(panel).unionByName(average_monthly_correlations(panel))


def extreme_summary(
    panel: DataFrame, names: Sequence[str] = EXTREME_VARIABLES
) -> DataFrame:
    """Tail quantiles and how many values lie at or beyond them."""
    long = stage(variables_to_rows(panel, names).where(F.col("value").isNotNull()), "values")
    q = stage(
        grouped_quantiles(long, ["variable"], "value", {"lo": 0.001, "hi": 0.999}), "tails"
    )
    v = F.col("value")
    return long.join(q, "variable").groupBy("variable").agg(
        F.count(v).alias("count"), F.min(v).alias("minimum"), F.first("lo").alias("p0_1"),
        F.first("hi").alias("p99_9"), F.max(v).alias("maximum"),
        F.count_if(v <= F.col("lo")).alias("count_at_or_below_p0_1"),
        F.count_if(v >= F.col("hi")).alias("count_at_or_above_p99_9"),
    )


_LINEAGE = (
    "ticker", "gvkey", REALIZED, "accounting_datadate", "fyear", "accounting_eligibility_date",
    "book_equity", "me_dec", "prc", "shrout", "me", "log_me", "book_to_market", "mom_12_2",
    TARGET, "vix", "regime",
)


def extreme_rows(
    panel: DataFrame, n: int = 10, names: Sequence[str] = EXTREME_VARIABLES
) -> DataFrame:
    """The n lowest and n highest rows of each variable with their lineage."""
    long = variables_to_rows(panel, names).where(F.col("value").isNotNull())

    def tail(name: str, order: Column) -> DataFrame:
        # A variable's rows spread over tasks, whatever n is.
        placed = ordered_index(long, ["variable"], [order, "permno", FORMATION], "tail_rank")
        return placed.where(
            F.col("tail_rank") <= n
        ).select(*_KEY, F.col("variable").alias("audit_variable"), F.lit(name).alias("tail"),
                 "tail_rank")

    # Only keys and values are sorted; the few chosen keys then fetch their lineage.
    chosen = stage(
        tail("low", F.col("value")).unionByName(tail("high", (-F.col("value")).alias("__down"))),
        "extremes",
    )
    facts = [c for c in _LINEAGE if c in panel.columns]
    return panel.select(*_KEY, *facts).join(chosen, list(_KEY))


def check_value_report(
    panel: DataFrame, rates: Sequence[str], quantile_names: Sequence[str],
    date: str = "date", regime: str | None = "regime", key: Sequence[str] = ("permno", "date"),
) -> DataFrame:
    """Long (check, value) report of size, missing rates, quantiles and regime counts."""
    n = F.count(F.lit(1))
    wide = panel.agg(
        n.cast("double").alias("n_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_rate_{c}") for c in rates],
    )
    base = wide.unpivot([], wide.columns, "check", "value")
    stocks = panel.select("permno").distinct().agg(
        F.count("permno").cast("double").alias("value")
    ).select(F.lit("n_stocks").alias("check"), "value")
    excess = panel.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum(F.col("c") - 1).cast("double").alias("value")
    ).select(F.lit("duplicate_permno_date").alias("check"), "value")
    q = grouped_quantiles(
        variables_to_rows(panel, quantile_names, key), ["variable"], "value",
        {"p01": 0.01, "p50": 0.5, "p99": 0.99},
    )
    points = q.unpivot(["variable"], ["p01", "p50", "p99"], "q", "value").select(
        F.concat_ws("_", "q", "variable").alias("check"), "value"
    )
    out = base.unionByName(stocks).unionByName(excess).unionByName(points)
    if regime is not None:
        counts = panel.groupBy(regime).agg(n.cast("double").alias("value")).select(
            F.concat(F.lit("regime_count_"), F.coalesce(F.col(regime), F.lit("<NA>")))
            .alias("check"), "value",
        )
        out = out.unionByName(counts)
    return out


def prediction_metrics(
    rows: DataFrame, keys: Sequence[str], actual: str, predicted: str,
    benchmark: str | None = None,
) -> DataFrame:
    """Errors, R2, out-of-sample R2 and correlation over the usable rows of each group."""
    a, p = safe_double(actual), safe_double(predicted)
    b = safe_double(benchmark) if benchmark else F.lit(0.0)
    ok = rows.select(*keys, a.alias("a"), p.alias("p"), b.alias("b")).where(
        "a IS NOT NULL AND p IS NOT NULL AND b IS NOT NULL"
    )
    e = F.col("a") - F.col("p")
    sse, n = F.sum(e * e), F.count(F.lit(1))
    var = F.when(n > 1, F.var_pop("a") * n)
    bench = F.sum((F.col("a") - F.col("b")) ** 2)
    zero = F.sum(F.col("a") * F.col("a"))
    return ok.groupBy(*keys).agg(
        n.alias("n_obs"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(var > 0, 1.0 - sse / var).alias("r2"),
        F.when(bench > 0, 1.0 - sse / bench).alias("oos_r2"),
        F.when(zero > 0, 1.0 - sse / zero).alias("oos_r2_vs_zero"),
        safe_corr("a", "p").alias("correlation"),
    )


def metrics_table(long: DataFrame, actual: str = "actual") -> DataFrame:
    """Prediction metrics by model, overall and by regime."""
    rows = long.withColumn("regime", F.explode(F.array(F.lit("OVERALL"), F.col("regime"))))
    bench = "benchmark_prediction" if "benchmark_prediction" in long.columns else None
    return prediction_metrics(
        rows.where(F.col("regime").isNotNull()), ["model", "regime"], actual, "prediction", bench
    )


def comparison_columns(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "regime", "n_obs", "mse", "rmse", "mae", "r2", "oos_r2",
                          "oos_r2_vs_zero", "correlation")


def _by_binary_regime(long: DataFrame) -> DataFrame:
    return long.withColumn(
        "regime", F.explode(F.array(F.lit("OVERALL"), F.upper("regime")))
    ).where(F.col("regime").isin("OVERALL", "HIGH", "LOW"))


def model_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of wide predictions with the realised deviation and normalised errors."""
    a = finite_double("actual_next_month_return")
    p, b = finite_double("prediction"), finite_double("benchmark_prediction")
    rows = _by_binary_regime(models_to_rows(predictions)).select(
        "model", "regime", a.alias("a"), p.alias("p"), b.alias("b")
    ).where("a IS NOT NULL AND p IS NOT NULL AND b IS NOT NULL")
    e, be = F.col("a") - F.col("p"), F.col("a") - F.col("b")
    mse, bmse, sd = F.avg(e * e), F.avg(be * be), F.stddev_samp("a")
    return rows.groupBy("model", "regime").agg(
        F.count(F.lit(1)).alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(bmse > 0, 1.0 - mse / bmse).alias("oos_r2"),
        safe_corr("a", "p").alias("correlation"), sd.alias("realized_return_std"),
        F.when(sd > 0, F.sqrt(mse) / sd).alias("normalized_rmse"),
        F.sqrt(bmse).alias("benchmark_rmse"),
    )


def prediction_diagnostics(predictions: DataFrame) -> DataFrame:
    """Coverage, missing and infinite counts and the distribution of predictions."""
    long = _by_binary_regime(models_to_rows(predictions)).select(
        "model", "regime", "date", "permno",
        F.col("prediction").cast("double").alias("raw"),
        finite_double("prediction").alias("p"),
        safe_double("actual_next_month_return").alias("a"),
    )
    p = F.col("p")
    missing = F.col("raw").isNull() | F.isnan("raw")
    months = long.groupBy("model", "regime", "date").agg(
        F.avg(p.isNotNull().cast("double")).alias("c")
    ).groupBy("model", "regime").agg(F.min("c").alias("min_monthly_coverage"))
    stats = long.groupBy("model", "regime").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(p.isNotNull().cast("double")).alias("prediction_coverage"),
        F.count_if(missing).alias("missing_predictions"),
        F.count_if(~missing & p.isNull()).alias("infinite_predictions"),
        F.avg(p).alias("prediction_mean"), F.stddev_samp(p).alias("prediction_std"),
        F.min(p).alias("prediction_min"), F.max(p).alias("prediction_max"),
        F.avg("a").alias("actual_mean"), F.stddev_samp("a").alias("actual_std"),
    )
    q = grouped_quantiles(
        long, ["model", "regime"], "p",
        {f"prediction_{k}": v for k, v in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5),
                                           ("p95", 0.95), ("p99", 0.99))},
    )
    return stats.join(months, ["model", "regime"]).join(q, ["model", "regime"], "left")


def check_prediction_diagnostics(diagnostics: DataFrame) -> None:
    """Raise on incomplete, constant, missing or infinite predictions."""
    bad = (
        (F.col("prediction_coverage") < 0.999999) | (F.col("min_monthly_coverage") < 0.999999)
        | (F.abs("prediction_std") < 1e-12) | (F.col("missing_predictions") > 0)
        | (F.col("infinite_predictions") > 0)
    )
    enforce(diagnostics.where((F.col("regime") == "OVERALL") & truthy(bad)),
            "Predictions are incomplete or constant")


def model_comparison(metrics: DataFrame, ic: DataFrame) -> DataFrame:
    """One row per model with the headline numbers of each regime."""
    both = metrics.select("model", "regime", "rmse", "oos_r2", "normalized_rmse").join(
        ic.select("model", "regime", "mean_monthly_spearman_ic"), ["model", "regime"], "left"
    )
    names = {"rmse": "rmse", "oos_r2": "oos_r2", "normalized_rmse": "normalized_rmse",
             "mean_monthly_spearman_ic": "mean_spearman_ic"}
    cells = [
        F.max(F.when(F.col("regime") == r, F.col(c))).alias(f"{r.lower()}_{n}")
        for r in ("OVERALL", "HIGH", "LOW") for c, n in names.items()
    ]
    return both.groupBy("model").agg(*cells).withColumn(
        "high_minus_low_oos_r2", F.col("high_oos_r2") - F.col("low_oos_r2")
    )


def rolling_rmse(predictions: DataFrame, months: int = 12, min_months: int = 3) -> DataFrame:
    """Monthly cross-sectional RMSE and its rolling mean over the last rows of each model."""
    e = safe_double("actual_next_month_return") - safe_double("prediction")
    monthly = models_to_rows(predictions).groupBy("model", "date").agg(
        F.sqrt(F.avg(e * e)).alias("rmse")
    )
    w = Window.partitionBy("model").orderBy("date").rowsBetween(-(months - 1), 0)
    return monthly.withColumn(
        "rolling_rmse", F.when(F.count("rmse").over(w) >= min_months, F.avg("rmse").over(w))
    )


def economic_sanity(panel: DataFrame, check: bool = True) -> DataFrame:
    """Largest identity errors and the scale of book-to-market."""
    be, me = F.col("book_equity"), F.col("me_dec")
    valid = (be > 0) & (me > 0) & F.col("book_to_market").isNotNull()
    errors = panel.agg(
        F.max(F.abs(F.col("market_equity") - F.abs("prc") * F.col("shrout")))
        .alias("market_equity_identity_max_abs_error"),
        F.max(F.when(valid, F.abs(F.col("book_to_market") - F.try_divide(be, me))))
        .alias("book_to_market_identity_max_abs_error"),
    )
    q = grouped_quantiles(
        variables_to_rows(panel, ["book_to_market"], ("permno", "date")), ["variable"], "value",
        {"book_to_market_median": 0.5, "book_to_market_p999": 0.999},
    ).drop("variable")
    out = side_by_side([errors, q])
    ok = F.col("book_to_market_median").between(0.001, 50.0)
    if check:
        out = stage_checked(out, "unit-sanity", {
            "Book-to-market scale points to a unit error":
                ok | F.col("book_to_market_median").isNull()
        })
    return out.withColumn(
        "unit_sanity_status", F.when(ok, "pass").otherwise("fail_scale_check")
    )


def count_audit(panel: DataFrame, eligible: Column) -> DataFrame:
    """Headline counts of a panel."""
    counts = panel.agg(
        F.count(F.lit(1)).alias("total_stock_months"),
        F.count_if(features_complete()).alias("complete_predictor_rows"),
        F.count_if(truthy(eligible)).alias("final_screened_rows"),
    )
    excess = panel.groupBy("permno", FORMATION).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint")
        .alias("duplicate_permno_date_rows")
    )
    return side_by_side([counts, excess])


def check_counts(audit: DataFrame, expected: Mapping[str, int]) -> None:
    """Compare a one-row audit with a stored snapshot."""
    found = audit.first().asDict()
    bad = {k: (found[k], v) for k, v in expected.items() if found[k] != v}
    if bad:
        raise ContractViolation(f"Counts differ from the snapshot: {bad}")


def portfolio_run_report(predictions: DataFrame, deciles: DataFrame) -> DataFrame:
    """(check, model, part, value) rows describing a portfolio run."""
    def named(df: DataFrame, check: str, part: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "model", part.alias("part"), "value")

    rows = predictions.groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("value"))
    per_month = predictions.groupBy(FORMATION, "model", "permno").agg(F.lit(1).alias("x")).groupBy(
        FORMATION, "model"
    ).agg(F.count("permno").alias("n"))
    sizes = per_month.groupBy("model").agg(
        F.min("n").cast("double").alias("min"), F.percentile("n", 0.5).alias("median"),
        F.max("n").cast("double").alias("max"),
    ).unpivot(["model"], ["min", "median", "max"], "part", "value")
    valid = deciles.where(F.col("D10_minus_D1").isNotNull()).groupBy("model", "weighting").agg(
        F.countDistinct(FORMATION).cast("double").alias("value")
    )
    regimes = predictions.groupBy("model", "regime", FORMATION).agg(F.lit(1).alias("x")).groupBy(
        "model", "regime"
    ).agg(F.count(FORMATION).cast("double").alias("value"))
    return (
        named(rows, "rows_by_model", F.lit("ALL"))
        .unionByName(named(sizes, "monthly_stock_counts", F.col("part")))
        .unionByName(named(valid, "valid_portfolio_months", F.col("weighting")))
        .unionByName(named(regimes, "regime_months", F.col("regime")))
    )


def panel_metadata(panel: DataFrame) -> DataFrame:
    """One row describing a validated panel."""
    complete = truthy("baseline_complete_case")
    p = panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(FORMATION).alias("formation_start"), F.max(FORMATION).alias("formation_end"),
        F.min(REALIZED).alias("realized_return_start"),
        F.max(REALIZED).alias("realized_return_end"),
        F.count_if(complete).alias("complete_case_rows"),
        F.count("log_me").alias("size_valid"),
        F.count_if(F.col("log_me").isNull()).alias("size_missing"),
        F.count_if(F.col("me") <= 0).alias("market_equity_nonpositive"),
        F.count("book_to_market").alias("book_to_market_valid"),
    )
    securities = panel.groupBy("permno").agg(F.max(complete).alias("c")).agg(
        F.count(F.lit(1)).alias("unique_permnos"),
        F.count_if("c").alias("complete_case_permnos"),
    )
    months = panel.groupBy(FORMATION).agg(F.max(F.upper("regime")).alias("r")).agg(
        F.count_if(F.col("r") == "HIGH").alias("high_months"),
        F.count_if(F.col("r") == "LOW").alias("low_months"),
    )
    return side_by_side([p, securities, months])
