"""The modelling panel: assembly, sample flags and the complete-case sample."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import all_of, finite_double, month_end, safe_double, truthy
from monthloom.operators.accounting import (
    annual_accounting, annual_book_to_market, assign_monthly, check_unique_months,
    link_accounting,
)
from monthloom.operators.contracts import (
    ContractViolation, duplicate_keys, enforce, enforce_rows, formation_date_ok, require_columns,
    target_date_ok,
)
from monthloom.operators.features import build_features
from monthloom.operators.regimes import attach_regimes
from monthloom.schema import FEATURES, FORMATION, REALIZED, TARGET
from monthloom.staging import stage


def build_panel(
    prices: DataFrame, funda: DataFrame, links: DataFrame, regimes: DataFrame,
    min_price: float = 5.0,
) -> DataFrame:
    """Features, June book-to-market and regimes in one table keyed by (permno, date)."""
    # The key also bounds the windows of one security, so it is proved before they run.
    check_unique_months(prices)
    features = stage(build_features(prices), "features")
    annual_bm = stage(
        annual_book_to_market(link_accounting(annual_accounting(funda), links), features),
        "annual_bm",
    )
    panel = assign_monthly(features, annual_bm)
    labels = regimes.select("date", "vix", "vix_expanding_median", "regime")
    return (
        attach_regimes(panel, labels)
        .withColumn("me", safe_double("market_equity"))
        .withColumn("price_eligible", F.coalesce(F.col("prc") >= float(min_price), F.lit(False)))
    )


def price_eligible(min_price: float, prc: str = "prc") -> Column:
    return truthy(F.abs(safe_double(prc)) >= float(min_price))


def features_complete() -> Column:
    return all_of(F.col(c).isNotNull() for c in FEATURES)


def finalize_panel(panel: DataFrame, min_price: float = 5.0) -> DataFrame:
    """Add the two date axes, accounting aliases and sample flags."""
    require_columns(panel, ["permno", TARGET, *FEATURES, REALIZED])
    out = panel
    both_dates = FORMATION in out.columns and "date" in out.columns
    if FORMATION not in out.columns:
        require_columns(out, ["date"])
        out = out.withColumn(FORMATION, month_end("date"))
    out = out.withColumn(FORMATION, month_end(FORMATION)).withColumn(REALIZED, month_end(REALIZED))
    if "date" in out.columns:
        out = out.withColumn("date", month_end("date"))
    if both_dates:
        enforce_rows(out, {"date and formation_date disagree": formation_date_ok()})
    if "date" not in out.columns:
        out = out.withColumn("date", F.col(FORMATION))
    if "me" not in out.columns and "market_equity" in out.columns:
        out = out.withColumn("me", safe_double("market_equity"))
    if "market_equity" not in out.columns and "me" in out.columns:
        out = out.withColumn("market_equity", safe_double("me"))
    if "price_eligible" in out.columns:
        out = out.withColumn("price_eligible", truthy("price_eligible"))
    else:
        require_columns(out, ["prc"])
        out = out.withColumn("price_eligible", price_eligible(min_price))
    if "accounting_available_from" in out.columns:
        out = out.withColumn("accounting_eligibility_date", F.col("accounting_available_from"))
    if "characteristic_year" in out.columns:
        year = F.col("characteristic_year").cast("int")
        out = out.withColumns({
            "accounting_eligibility_year": year,
            "accounting_active_through": F.make_date(year + 1, F.lit(5), F.lit(31)),
        })
    gvkey = F.col("gvkey") if "gvkey" in out.columns else F.lit(None)
    regime = F.col("regime") if "regime" in out.columns else F.lit(None)
    keyed = (
        F.col("permno").isNotNull() & F.col(FORMATION).isNotNull()
        & F.col(REALIZED).isNotNull() & gvkey.isNotNull()
    )
    return out.withColumns({
        "target_available": F.col(TARGET).isNotNull(),
        "target_available_date": F.col(REALIZED),
        "baseline_predictors_complete": features_complete(),
        "baseline_complete_case": features_complete() & F.col(TARGET).isNotNull()
        & regime.isNotNull() & F.col("price_eligible") & keyed,
    })


def observable_as_of(panel: DataFrame, as_of: str) -> DataFrame:
    """Rows whose target is known at the month end of ``as_of``."""
    cutoff = F.last_day(F.lit(as_of).cast("date"))
    return panel.where((month_end(FORMATION) < cutoff) & (month_end(REALIZED) <= cutoff))


def model_eligible(panel: DataFrame, min_price: float = 5.0) -> Column:
    """Frozen eligibility rule of the complete-case sample."""
    if "price_eligible" in panel.columns:
        eligible = truthy("price_eligible")
    elif "prc" in panel.columns:
        eligible = price_eligible(min_price)
    else:
        raise ContractViolation("The panel needs price_eligible or prc")
    return (
        eligible & features_complete() & F.col(TARGET).isNotNull() & F.col("regime").isNotNull()
        & F.col("vix").isNotNull() & F.col(FORMATION).isNotNull() & F.col(REALIZED).isNotNull()
    )


_SAMPLE = (
    "date", FORMATION, REALIZED, "permno", "ticker", "regime", "vix", *FEATURES, TARGET, "prc",
    "price_eligible", "baseline_complete_case", "me_lag", "me_lag_date", "market_equity",
    "vix_expanding_median",
)


def complete_case_sample(panel: DataFrame, min_price: float = 5.0, check: bool = True) -> DataFrame:
    """Model rows; with ``check`` the stored flag, timing, labels and values must agree."""
    require_columns(panel, ["permno", FORMATION, REALIZED, TARGET, "regime", "vix", *FEATURES])
    keep = model_eligible(panel, min_price)
    out = panel.where(keep).select(*[c for c in _SAMPLE if c in panel.columns])
    if check:
        enforce_rows(panel, _sample_rules(panel, truthy(keep)))
        enforce(duplicate_keys(out, ["permno", FORMATION]), "Duplicate model rows")
    return out


def _sample_rules(panel: DataFrame, keep: Column) -> dict[str, Column]:
    """Rules of the complete-case sample, all checked in one scan of the panel."""
    finite = all_of(finite_double(c).isNotNull() for c in (*FEATURES, TARGET, "vix"))
    rules = {
        "Target is not realized in the next month": ~keep | target_date_ok(),
        "Unknown regime label": ~keep | F.upper("regime").isin("HIGH", "LOW"),
        "Model inputs are not finite": ~keep | finite,
    }
    if "baseline_complete_case" in panel.columns:
        rules["Stored complete-case flag disagrees with the eligibility rule"] = (
            truthy("baseline_complete_case") == keep
        )
    for c in ("accounting_available_date", "book_to_market_available_date", "bm_available_date",
              "accounting_assignment_date"):
        if c in panel.columns:
            rules[f"{c} after formation"] = ~truthy(month_end(c) > month_end(FORMATION))
    if "vix_expanding_median" in panel.columns:
        implied = F.when(F.col("vix") > F.col("vix_expanding_median"), "HIGH").otherwise("LOW")
        wrong = F.col("vix_expanding_median").isNotNull() & (F.upper("regime") != implied)
        rules["Regime label breaks the expanding-median rule"] = ~keep | ~truthy(wrong)
    return rules


def cut_to_dates(panel: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Drop buffer history kept only so that windows could look back and ahead."""
    return panel.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
