"""Data contracts. Each check returns the violating rows (or counts); ``enforce`` raises."""
from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    all_of,
    characteristic_year,
    finite_double,
    is_close,
    month_end,
    month_end_shift,
    month_index,
    truthy,
)
from monthloom.schema import FEATURES, FORMATION, REALIZED, TARGET, THREE_REGIMES
from monthloom.staging import delete_path, publish, stage, stage_path


class ContractViolation(ValueError):
    """A table breaks one of its contracts."""


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractViolation(f"Missing columns: {missing}")


def enforce(violations: DataFrame, message: str) -> None:
    """Raise if ``violations`` has any row; reads at most one."""
    found = violations.limit(1).collect()
    if found:
        raise ContractViolation(f"{message}; for example {found[0].asDict()}")


def enforce_all(violations: Mapping[str, DataFrame]) -> None:
    """``enforce`` for several checks at once, in one job."""
    labelled = [
        df.limit(1).select(
            F.lit(message).alias("message"), F.to_json(F.struct(*df.columns)).alias("example")
        )
        for message, df in violations.items()
    ]
    found = reduce(DataFrame.unionByName, labelled).collect()
    if found:
        raise ContractViolation("; ".join(f"{r.message}, for example {r.example}" for r in found))


def enforce_rows(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Check any number of row rules in a single scan; a NULL result counts as a breach."""
    counts = df.agg(*[
        F.count_if(~truthy(ok)).alias(f"rule_{i}") for i, ok in enumerate(rules.values())
    ]).first()
    bad = {m: counts[f"rule_{i}"] for i, m in enumerate(rules) if counts[f"rule_{i}"]}
    if bad:
        raise ContractViolation("; ".join(f"{m} ({n} rows)" for m, n in bad.items()))


def stage_checked(df: DataFrame, label: str, rules: Mapping[str, Column]) -> DataFrame:
    """``stage`` that checks row rules in the pass that writes; a NULL result counts as a breach.

    The counts of breaches are observed on the written rows, so ``df`` is computed once. A breach
    deletes the table before anybody reads it. A task that runs again may count its breaches
    again, but never makes a count zero or a zero count positive.
    """
    path = stage_path(df.sparkSession, label)
    write_checked(df, path, rules)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_checked(df: DataFrame, path: str, rules: Mapping[str, Column]) -> str:
    """Write a Parquet table that appears under ``path`` only if every row rule holds.

    Rows go to a pending folder beside it, which is renamed when the observed counts are zero and
    deleted otherwise, also when the write fails; a table already there stays until then.
    """
    spark = df.sparkSession
    seen = Observation()
    watched = df.observe(seen, *[
        F.count_if(~truthy(ok)).alias(f"rule_{i}") for i, ok in enumerate(rules.values())
    ]) if rules else df
    pending = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    try:
        watched.write.mode("errorifexists").parquet(pending)
        counts = seen.get if rules else {}
        bad = {m: counts[f"rule_{i}"] for i, m in enumerate(rules) if counts[f"rule_{i}"]}
        if bad:
            raise ContractViolation("; ".join(f"{m} ({n} rows)" for m, n in bad.items()))
        publish(spark, pending, path)
    finally:
        delete_path(spark, pending)
    return path


def reject_standardized_shadows(df: DataFrame) -> None:
    """The stored panel must hold raw features only."""
    patterns = ("{}_z", "z_{}", "{}_scaled", "scaled_{}", "{}_standardized", "standardized_{}")
    shadows = {p.format(f) for f in FEATURES for p in patterns}
    found = sorted(c for c in df.columns if c.lower() in shadows)
    if found:
        raise ContractViolation(f"Standardized feature columns are stored: {found}")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def target_date_ok() -> Column:
    """Realized date is the month end after the formation month."""
    return month_end(REALIZED) == month_end_shift(FORMATION, 1)


def target_date_violations(df: DataFrame) -> DataFrame:
    return df.where(~truthy(target_date_ok()))


def formation_date_ok() -> Column:
    """``date`` and ``formation_date`` agree once snapped to month ends."""
    return ~truthy(month_end("date") != month_end(FORMATION))


def formation_date_mismatch(df: DataFrame) -> DataFrame:
    return df.where(~formation_date_ok())


def size_faults() -> dict[str, Column]:
    """Breaches of the three size identities."""
    expected = F.abs("prc") * F.col("shrout")
    gap = F.abs(F.col("me") - expected)
    return {
        "bad_me": truthy(gap > F.greatest(F.lit(1e-8), F.abs(expected) * 1e-10)),
        "bad_nonpositive": truthy((F.col("me") <= 0) & F.col("log_me").isNotNull()),
        "bad_log": truthy(
            (F.col("me") > 0) & ~is_close(F.col("log_me"), F.ln("me"), 1e-10, 1e-10)
        ),
    }


def size_ok() -> Column:
    return all_of(~c for c in size_faults().values())


def size_violations(df: DataFrame) -> DataFrame:
    return df.withColumns(size_faults()).where("bad_me OR bad_nonpositive OR bad_log")


def accounting_timing_ok() -> Column:
    """No accounting data before its June availability, and the June-to-May year rule."""
    has = F.col("accounting_datadate").isNotNull()
    future = month_end("accounting_eligibility_date") > month_end(FORMATION)
    wrong_year = has & ~F.col("characteristic_year").eqNullSafe(characteristic_year(FORMATION))
    wrong_fy = has & ~F.year("accounting_datadate").eqNullSafe(F.col("characteristic_year") - 1)
    return ~(truthy(future) | wrong_year | wrong_fy)


def accounting_timing_violations(df: DataFrame) -> DataFrame:
    return df.where(~accounting_timing_ok())


def book_to_market_ok() -> Column:
    """A present ratio needs positive parts and must equal their quotient."""
    good = (
        (F.col("book_equity") > 0)
        & (F.col("me_dec") > 0)
        & is_close(
            F.col("book_to_market"),
            F.try_divide(F.col("book_equity"), F.col("me_dec")),
            1e-9,
            1e-12,
        )
    )
    return F.col("book_to_market").isNull() | truthy(good)


def book_to_market_violations(df: DataFrame) -> DataFrame:
    return df.where(~book_to_market_ok())


def price_flag_ok(min_price: float = 5.0) -> Column:
    return truthy("price_eligible") == truthy(F.abs("prc") >= float(min_price))


def price_flag_violations(df: DataFrame, min_price: float = 5.0) -> DataFrame:
    return df.where(~price_flag_ok(min_price))


def regime_month_violations(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Months whose index or label varies, breaks the rule, or differs from a reference."""
    values = ("vix", "vix_expanding_median", "regime")
    # min and max of each value tell constancy in one map-side aggregate.
    monthly = df.groupBy(FORMATION).agg(
        *[F.min(v).alias(v) for v in values],
        *[F.max(v).alias(f"max_{v}") for v in values],
        *[F.count(v).alias(f"n_{v}") for v in values],
        F.count(F.lit(1)).alias("n_rows"),
    )
    varies = F.lit(False)
    for v in values:
        partly_null = (F.col(f"n_{v}") > 0) & (F.col(f"n_{v}") < F.col("n_rows"))
        varies = varies | truthy(F.col(v) != F.col(f"max_{v}")) | partly_null
    implied = F.when(F.col("vix") > F.col("vix_expanding_median"), "HIGH").otherwise("LOW")
    known = all_of(F.col(v).isNotNull() for v in values)
    mislabelled = known & (F.upper("regime") != implied)
    out = monthly.select(
        FORMATION, *values, varies.alias("not_constant"), truthy(mislabelled).alias("mislabelled")
    )
    if reference is None:
        return out.where("not_constant OR mislabelled")
    ref = reference.select(
        month_end("date").alias(FORMATION), *[F.col(v).alias(f"ref_{v}") for v in values]
    )
    joined = out.join(ref, FORMATION, "left")
    differs = F.col("vix").isNotNull() & F.col("ref_vix").isNull()
    for v in ("vix", "vix_expanding_median"):
        same = is_close(v, f"ref_{v}", 1e-10, 1e-10)
        both_null = F.col(v).isNull() & F.col(f"ref_{v}").isNull()
        differs = differs | ~truthy(same | both_null)
    differs = differs | ~F.upper("regime").eqNullSafe(F.upper("ref_regime"))
    return joined.select(
        *out.columns, differs.alias("differs_from_reference")
    ).where("not_constant OR mislabelled OR differs_from_reference")


def leakage_rules(predictions: Sequence[str]) -> dict[str, Column]:
    """Training ends before formation and every stored number is finite."""
    return {
        "Training features reach the formation month":
            F.col("train_feature_end_date") < F.col(FORMATION),
        "Training targets were not realized by formation":
            F.col("train_target_end_date") <= F.col(FORMATION),
        "The realized date does not follow formation": F.col(REALIZED) > F.col(FORMATION),
        "A prediction is missing or not finite":
            all_of(finite_double(p).isNotNull() for p in predictions),
    }


def leakage_violations(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    return df.where(~truthy(all_of(leakage_rules(predictions).values())))


def malformed_decile_months(assignments: DataFrame, n: int = 10) -> DataFrame:
    """Assigned (month, model) groups that do not hold every decile."""
    return (
        assignments.where(F.col("decile").isNotNull())
        .groupBy(FORMATION, "model")
        .agg(
            F.countDistinct("decile").alias("n_deciles"),
            F.min("decile").alias("lowest"),
            F.max("decile").alias("highest"),
        )
        .where((F.col("n_deciles") != n) | (F.col("lowest") != 1) | (F.col("highest") != n))
    )


def spread_arithmetic_violations(wide: DataFrame) -> DataFrame:
    return wide.where(~is_close(F.col("D10") - F.col("D1"), "D10_minus_D1", 1e-5, 1e-8))


def assignment_rules() -> dict[str, Column]:
    """Row-level part of the assignment contract."""
    return {
        "Formation date is not a month end": F.col(FORMATION) == F.last_day(FORMATION),
        "Realized date is not the next month end":
            F.col(REALIZED) == month_end_shift(FORMATION, 1),
        "Security id is not an integer": F.col("permno") == F.floor("permno"),
        "Decile is not an integer from 1 to 10":
            (F.col("decile") == F.floor("decile")) & F.col("decile").between(1, 10),
        "Binary regime is unknown": F.upper("regime_binary").isin("LOW", "HIGH"),
        "Three-state regime is unknown": F.upper("regime_3state").isin(*THREE_REGIMES),
        "Realized return is not finite or below -100 %":
            finite_double("realized_next_month_return") >= -1.0,
    }


def assignment_violations(assignments: DataFrame) -> DataFrame:
    return assignments.where(~truthy(all_of(assignment_rules().values())))


def month_gaps(assignments: DataFrame) -> DataFrame:
    """Per model, formation months that do not follow their predecessor."""
    months = assignments.groupBy("model", FORMATION).agg(F.count(F.lit(1)).alias("n_rows"))
    # One row per model and calendar month.
    w = Window.partitionBy("model").orderBy(FORMATION)
    step = month_index(FORMATION) - F.lag(month_index(FORMATION)).over(w)
    return months.select("model", FORMATION, step.alias("months_since_previous")).where(
        "months_since_previous <> 1"
    )


def months_missing_for_a_model(assignments: DataFrame) -> DataFrame:
    """Months that some but not all models have."""
    by_month = assignments.groupBy(FORMATION).agg(F.countDistinct("model").alias("n_models"))
    total = F.max("n_models").over(Window.partitionBy(F.lit(1)))
    # The window runs over one row per calendar month.
    return by_month.withColumn("all_models", total).where("n_models < all_models")


def check_assignments(assignments: DataFrame) -> None:
    """Raise unless the assignment table can be used to rebuild portfolio weights."""
    require_columns(
        assignments,
        [FORMATION, REALIZED, "permno", "model", "decile", "realized_next_month_return",
         "weighting_variable", "regime_binary", "regime_3state"],
    )
    enforce_rows(assignments, assignment_rules())
    # The remaining rules concern months; one aggregate leaves a row per month and decile.
    names = (REALIZED, "regime_binary", "regime_3state")
    months = stage(
        assignments.groupBy(FORMATION, "model", "decile").agg(
            *[F.min(c).alias(f"min_{c}") for c in names],
            *[F.max(c).alias(f"max_{c}") for c in names],
        ),
        "months",
    )
    both = months.select(
        FORMATION, "model",
        F.explode(F.array(*[
            F.struct(*[F.col(f"{side}_{c}").alias(c) for c in names]) for side in ("min", "max")
        ])).alias("v"),
    ).select(FORMATION, "model", "v.*")
    enforce_all({
        "Duplicate assignments": duplicate_keys(assignments, [FORMATION, "model", "permno"]),
        "A month lacks a decile": malformed_decile_months(months),
        "Formation months are not consecutive": month_gaps(months),
        "Models cover different months": months_missing_for_a_model(months),
        "A month has several regimes or realized dates": inconsistent_months(both),
    })


def inconsistent_months(assignments: DataFrame) -> DataFrame:
    """(month, model) groups with more than one realized date or regime."""
    names = [c for c in (REALIZED, "regime_binary", "regime_3state", "regime")
             if c in assignments.columns]
    varied = F.lit(False)
    for c in names:
        varied = varied | (F.col(f"min_{c}") != F.col(f"max_{c}"))
    return (
        assignments.groupBy(FORMATION, "model")
        .agg(
            *[F.min(c).alias(f"min_{c}") for c in names],
            *[F.max(c).alias(f"max_{c}") for c in names],
        )
        .where(varied)
    )


def weight_sum_violations(weights: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Groups whose weights are negative or do not add up to one."""
    return (
        weights.groupBy(*keys)
        .agg(F.sum(weight).alias("total"), F.min(weight).alias("lowest"))
        .where(~is_close("total", F.lit(1.0), 1e-12, 1e-12) | (F.col("lowest") < 0))
    )


def weight_sum_ok(total: str, lowest: str) -> Column:
    """Weights of a leg add up to one, but for rounding over many members; none is negative."""
    return is_close(total, F.lit(1.0), 1e-9, 1e-9) & (F.col(lowest) >= 0)


def turnover_range_ok(turnover: str = "turnover") -> Column:
    """One-way turnover lies in [0, 1]."""
    return F.col(turnover).between(-1e-12, 1.0 + 1e-12)


def turnover_range_violations(turnover: DataFrame) -> DataFrame:
    return turnover.where(~truthy(turnover_range_ok()))


def value_weight_date_ok(date: str = "date") -> Column:
    """Value weights are dated at the previous calendar month end."""
    return F.col("me_lag_date") == month_end_shift(date, -1)


def value_weight_date_violations(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(~truthy(value_weight_date_ok(date)))


def incomplete_model_inputs(df: DataFrame) -> DataFrame:
    """Rows a model would have to impute; they are refused, not filled."""
    return df.where(~all_of(finite_double(c).isNotNull() for c in (*FEATURES, TARGET)))


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    numeric: Sequence[str],
    exact: Sequence[str] = (),
    rtol: float = 1e-10,
    atol: float = 1e-12,
) -> DataFrame:
    """Full-outer comparison; returns keys that are missing on a side or differ in a value."""
    a = left.select(
        *keys, *[F.col(c).alias(f"l_{c}") for c in (*numeric, *exact)], F.lit(1).alias("__l")
    )
    b = right.select(
        *keys, *[F.col(c).alias(f"r_{c}") for c in (*numeric, *exact)], F.lit(1).alias("__r")
    )
    side = (
        F.when(F.col("__r").isNull(), "left_only")
        .when(F.col("__l").isNull(), "right_only")
        .otherwise("both")
    )
    differs = F.lit(False)
    for c in numeric:
        both_null = F.col(f"l_{c}").isNull() & F.col(f"r_{c}").isNull()
        differs = differs | ~truthy(is_close(f"l_{c}", f"r_{c}", rtol, atol) | both_null)
    for c in exact:
        differs = differs | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return (
        a.join(b, list(keys), "full_outer")
        .select(*keys, side.alias("found_in"), differs.alias("differs"))
        .where("found_in <> 'both' OR differs")
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash of a table, in one pass."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("content_hash"),
    )


def check_monthly_series(
    series: DataFrame, keys: Sequence[str], outcome: str, models: Sequence[str]
) -> DataFrame:
    """Contract of a monthly inference input; returns it with labels in upper case."""
    require_columns(series, [FORMATION, outcome, *keys, "regime_binary", "regime_3state"])
    out = series.withColumn("regime_binary", F.upper("regime_binary")).withColumn(
        "regime_3state", F.upper("regime_3state")
    )
    enforce_rows(out, {
        "Formation date is missing": F.col(FORMATION).isNotNull(),
        f"{outcome} is not finite": F.col(outcome).isNull() | finite_double(outcome).isNotNull(),
        "Unknown binary regime": F.col("regime_binary").isin("LOW", "HIGH"),
        "Unknown three-state regime": F.col("regime_3state").isin(*THREE_REGIMES),
    })
    states = out.groupBy(*keys).agg(F.countDistinct("regime_3state").alias("n_states"))
    found = out.select("model").distinct()
    wanted = out.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    )
    enforce_all({
        "Duplicate monthly observation": duplicate_keys(out, [FORMATION, *keys]),
        "A regime is missing": states.where(F.col("n_states") != len(THREE_REGIMES)),
        "Unknown model": found.join(wanted, "model", "left_anti"),
        "Model is missing": wanted.join(found, "model", "left_anti"),
    })
    return out


def summary_mismatches(
    summary: DataFrame, series: DataFrame, keys: Sequence[str], stored: str, value: str,
    rtol: float = 1e-10, atol: float = 1e-12,
) -> DataFrame:
    """Stored means and month counts that a fresh aggregate of the series does not confirm."""
    fresh = series.groupBy(*keys).agg(
        F.avg(value).alias("__mean"), F.count(value).alias("__months")
    )
    ok = is_close("__mean", stored, rtol, atol) & (F.col("__months") == F.col("n_months"))
    return summary.join(fresh, list(keys), "left").where(~truthy(ok)).select(*keys, stored)
