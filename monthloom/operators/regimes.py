"""Volatility regimes from a monthly index series.

The series has one row per calendar month, so the unpartitioned windows below run
over a few thousand rows however large the security panel is.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import finite_double, is_close, month_end, truthy
from monthloom.operators.contracts import duplicate_keys, enforce, require_columns
from monthloom.schema import BINARY_REGIMES, FORMATION, THREE_REGIMES


def daily_to_monthly(daily: DataFrame) -> DataFrame:
    """Last valid observation of each calendar month, dated at the month end.

    A day with different values is refused: nothing says which of them is the last.
    """
    day = F.col("date").try_cast("date")
    clean = daily.select(day.alias("date"), finite_double("vix").alias("vix")).dropna()
    days = clean.groupBy("date").agg(F.min("vix").alias("vix"), F.max("vix").alias("__max"))
    enforce(days.where("vix <> __max"), "More than one index value on a day")
    return clean.groupBy(F.last_day("date").alias("month")).agg(
        F.max_by("vix", "date").alias("vix")
    ).select(F.col("month").alias("date"), "vix")


def _expanding(date: str):
    return Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)


def binary_label(vix: Column, median: Column) -> Column:
    return F.when(vix > median, "HIGH").otherwise("LOW")


def three_state_label(vix: Column, q33: Column, q67: Column) -> Column:
    return F.when(vix <= q33, "LOW").when(vix <= q67, "MIDDLE").otherwise("HIGH")


def label_binary_regime(monthly: DataFrame, sequence: str | None = None) -> DataFrame:
    """Expanding median (month t included) and the HIGH/LOW label.

    ``sequence`` orders the rows of one date, of which the last is kept. Rows of a table have no
    order of their own, so without it a date with different values is refused.
    """
    if sequence is None:
        one = monthly.groupBy("date").agg(F.min("vix").alias("vix"), F.max("vix").alias("__max"))
        enforce(one.where("vix <> __max"), "More than one index value on a date")
        out = one.select("date", "vix")
    else:
        enforce(duplicate_keys(monthly, ["date", sequence]), "The sequence repeats within a date")
        out = monthly.groupBy("date").agg(F.max_by("vix", sequence).alias("vix"))
    median = F.percentile("vix", 0.5).over(_expanding("date"))
    return out.withColumn("vix_expanding_median", median).withColumn(
        "regime", binary_label(F.col("vix"), F.col("vix_expanding_median"))
    )


def expanding_regimes(monthly: DataFrame, min_periods: int = 1) -> DataFrame:
    """Expanding median and terciles with the binary and three-state labels."""
    if min_periods < 1:
        raise ValueError("min_periods must be at least one.")
    series = (
        monthly.select(month_end("date").alias("date"), finite_double("vix").alias("vix"))
        .dropna()
        .groupBy("date")
        .agg(F.min("vix").alias("vix"), F.max("vix").alias("__max"))
    )
    enforce(series.where("vix <> __max"), "More than one index value in a month")
    w = _expanding("date")
    q = F.when(
        F.count("vix").over(w) >= min_periods,
        F.percentile("vix", F.array(F.lit(1.0 / 3.0), F.lit(0.5), F.lit(2.0 / 3.0))).over(w),
    )
    out = series.select("date", "vix", q.alias("__q")).select(
        "date",
        "vix",
        F.col("__q")[1].alias("vix_expanding_median"),
        F.col("__q")[0].alias("vix_expanding_q33"),
        F.col("__q")[2].alias("vix_expanding_q67"),
    )
    known = F.col("vix_expanding_median").isNotNull()
    return out.withColumn(
        "regime_binary", F.when(known, binary_label(F.col("vix"), F.col("vix_expanding_median")))
    ).withColumn(
        "regime_3state",
        F.when(
            known,
            three_state_label(
                F.col("vix"), F.col("vix_expanding_q33"), F.col("vix_expanding_q67")
            ),
        ),
    )


def index_history_from_panel(panel: DataFrame, date: str = FORMATION) -> DataFrame:
    """The monthly index held by a panel; every month must carry a single value."""
    monthly = (
        panel.select(month_end(date).alias("date"), finite_double("vix").alias("vix"))
        .dropna()
        .groupBy("date")
        .agg(F.min("vix").alias("vix"), F.max("vix").alias("__max"))
    )
    enforce(monthly.where("vix <> __max"), "The index is not unique within a month")
    return monthly.drop("__max")


def attach_regimes(rows: DataFrame, regimes: DataFrame, date: str = "date") -> DataFrame:
    """Many-to-one left join of monthly labels; Catalyst broadcasts the small side by size."""
    enforce(duplicate_keys(regimes, [date]), "Duplicate monthly dates in the regime table")
    return rows.join(regimes, date, "left")


def attach_three_state(predictions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Add the three-state columns and prove that the stored binary label is unchanged."""
    require_columns(predictions, ["permno", FORMATION, "vix", "regime"])
    labels = regimes.select(
        F.col("date").alias(FORMATION),
        F.col("vix").alias("__vix"),
        "vix_expanding_median",
        "vix_expanding_q33",
        "vix_expanding_q67",
        "regime_binary",
        "regime_3state",
    )
    own = [c for c in predictions.columns if c not in set(labels.columns) - {FORMATION}]
    out = predictions.select(*own).join(labels, FORMATION, "left")
    ok = (
        F.col("regime_3state").isNotNull()
        & is_close("vix", "__vix", 1e-6, 1e-6)
        & (F.upper("regime") == F.col("regime_binary"))
    )
    enforce(
        out.where(~truthy(ok)).select(FORMATION, "vix", "__vix", "regime", "regime_3state"),
        "Predictions disagree with the index history",
    )
    return out.drop("__vix")


def transition_counts(regimes: DataFrame) -> DataFrame:
    """Counts of month-to-month state changes, with zeros for absent pairs."""
    states = F.array(*[F.lit(s) for s in THREE_REGIMES])
    grid = (
        regimes.sparkSession.range(1)
        .select(F.explode(states).alias("from_regime"))
        .select("from_regime", F.explode(states).alias("to_regime"))
    )
    steps = (
        regimes.where(F.col("regime_3state").isNotNull())
        .select(
            F.lag("regime_3state").over(Window.orderBy("date")).alias("from_regime"),
            F.col("regime_3state").alias("to_regime"),
        )
        .where(F.col("from_regime").isNotNull())
        .groupBy("from_regime", "to_regime")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return grid.join(steps, ["from_regime", "to_regime"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("bigint")
    )


def regime_validation(regimes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Months and rows per state next to the range of the thresholds."""
    valid = regimes.where(F.col("vix_expanding_q33").isNotNull())
    facts = valid.agg(
        F.min("date").alias("earliest_valid_threshold"),
        *[
            f(f"vix_expanding_{q}").alias(f"{q}_{n}")
            for q in ("q33", "q67")
            for n, f in (("min", F.min), ("median", lambda c: F.percentile(c, 0.5)),
                         ("max", F.max))
        ],
        F.min(F.col("vix_expanding_q33") <= F.col("vix_expanding_q67")).alias(
            "q33_le_q67_all_valid"
        ),
    )
    counts = predictions.groupBy(F.col("regime_3state").alias("regime")).agg(
        F.countDistinct(FORMATION).alias("oos_month_count"),
        F.count(F.lit(1)).alias("oos_stock_month_count"),
    )
    states = facts.select(
        F.explode(F.array(*[F.lit(s) for s in THREE_REGIMES])).alias("regime"), "*"
    )
    return states.join(counts, "regime", "left").fillna(
        0, ["oos_month_count", "oos_stock_month_count"]
    )


REGIME_SETS = (("overall", None, ("OVERALL",)), ("binary", "regime_binary", BINARY_REGIMES),
               ("three_state", "regime_3state", THREE_REGIMES))


def with_regime_definitions(df: DataFrame, definitions=("overall", "binary", "three_state")):
    """Repeat each monthly row under every regime definition that it belongs to.

    Binary and three-state labels share names, hence the definition column.
    """
    entries = []
    for name, column, _ in REGIME_SETS:
        if name in definitions:
            label = F.lit("OVERALL") if column is None else F.col(column)
            entries.append(
                F.struct(F.lit(name).alias("regime_definition"), label.alias("regime"))
            )
    return (
        df.withColumn("__r", F.explode(F.array(*entries)))
        .select("*", "__r.regime_definition", "__r.regime")
        .drop("__r")
        .where(F.col("regime").isNotNull())
    )
