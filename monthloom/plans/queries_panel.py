"""Queries on features, accounting, joins, windows, sorts, set operations and contracts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import month_index
from monthloom.operators import (
    accounting, contracts, features, fingerprints, panel, portfolios, regimes, reports, reshape, splits,
    transforms, universe,
)
from monthloom.operators.ordering import average_ranks, spread_group_stats
from monthloom.plans.catalog import query
from monthloom.schema import FEATURES, FORMATION, MODEL_COLUMNS, REALIZED, TARGET
from monthloom.sources import scans
from monthloom.sources.market_tables import MarketTables
from monthloom.staging import stage


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("check"), "n_rows")


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- domain operators ------------------------------------------------------------------
@query("fea_01_monthly_features", "permno:i date:d market_equity:6 log_me:8 mom_12_2:6 "
       "next_month_return:8 me_lag:6 realized_return_date:d me_lag_date:d")
def _(m: MarketTables) -> DataFrame:
    return features.build_features(m.prices().drop("caldt"))


@query("fea_02_annual_accounting", "gvkey accounting_year:i characteristic_year:i datadate:d "
       "book_equity:6 accounting_available_from:d")
def _(m: MarketTables) -> DataFrame:
    return accounting.annual_accounting(m.fundamentals())


@query("fea_02_annual_audit", "annual_rows_input:i duplicate_firm_year_rows:i "
       "duplicate_firm_year_rows_removed:i annual_book_equity_valid:i "
       "annual_book_equity_missing:i annual_book_equity_zero:i annual_book_equity_negative:i")
def _(m: MarketTables) -> DataFrame:
    return accounting.annual_accounting_audit(m.fundamentals())


@query("fea_03_december_equity", "permno:i december_year:i me_dec_security:6 me_dec_date:d")
def _(m: MarketTables) -> DataFrame:
    return accounting.december_market_equity(m.features())


@query("fea_04_book_to_market", "permno:i gvkey characteristic_year:i book_equity:6 me_dec:6 "
       "linked_permnos:i permnos_with_december_me:i book_to_market:6")
def _(m: MarketTables) -> DataFrame:
    return accounting.annual_book_to_market(m.linked(), m.features())


@query("fea_05_panel_build", "permno:i date:d log_me:8 mom_12_2:6 book_to_market:6 gvkey "
       "next_month_return:8 vix:12 regime me:6 price_eligible:b")
def _(m: MarketTables) -> DataFrame:
    return panel.build_panel(
        m.prices().drop("caldt"), m.fundamentals(), m.links(), m.regimes()
    )


@query("reg_01_binary_regimes", "date:d vix:12 vix_expanding_median:12 regime")
def _(m: MarketTables) -> DataFrame:
    return regimes.label_binary_regime(m.index_monthly())


@query("reg_02_index_from_panel", "date:d vix:12")
def _(m: MarketTables) -> DataFrame:
    return regimes.index_history_from_panel(m.panel())


@query("reg_03_attach_three_state", "permno:i formation_date:d regime_binary regime_3state "
       "vix_expanding_q33:12 vix_expanding_q67:12")
def _(m: MarketTables) -> DataFrame:
    return regimes.attach_three_state(m.predictions(), m.three_regimes())


# --- joins -----------------------------------------------------------------------------
@query("jon_01_interval_join", "permno:i date:d ticker ret:8 prc:8 primaryexch issuertype")
def _(m: MarketTables) -> DataFrame:
    return scans.security_monthly_with_history(
        m.security_file(), m.security_info(), "1995-01-01", "2001-12-31"
    )


@query("jon_02_legacy_interval_join", "permno:i date:d ticker prc:8 market_equity:6 exchcd:i "
       "shrcd:i")
def _(m: MarketTables) -> DataFrame:
    return scans.legacy_security_monthly(
        m.prices(), m.names_history(), "1992-01-01", "2001-12-31"
    )


@query("jon_03_link_interval_join", "gvkey characteristic_year:i permno:i linktype linkprim "
       "linkdt:d linkenddt:d book_equity:6")
def _(m: MarketTables) -> DataFrame:
    return accounting.link_accounting(m.annual(), m.links())


@query("jon_03_link_audit", "accounting_rows:i accounting_rows_with_valid_ccm:i "
       "accounting_rows_unmatched_ccm:i ccm_rows_input:i ccm_rows_retained:i "
       "duplicate_ccm_rows_detected:i duplicate_ccm_rows_resolved:i "
       "permno_year_gvkey_conflict_rows:i permno_year_gvkey_conflicts_resolved:i")
def _(m: MarketTables) -> DataFrame:
    return accounting.link_audit(m.annual(), m.links())


@query("jon_04_regime_attach", "permno:i date:d vix:12 regime")
def _(m: MarketTables) -> DataFrame:
    return regimes.attach_regimes(m.features(), m.regimes())


@query("jon_05_december_join", "permno:i characteristic_year:i gvkey me_dec_security:6")
def _(m: MarketTables) -> DataFrame:
    return m.linked().withColumn("december_year", F.col("characteristic_year") - 1).join(
        accounting.december_market_equity(m.features()), ["permno", "december_year"], "left"
    )


@query("jon_06_firm_totals", "gvkey date:d permno:i firm_me:6 n_classes:i share:8")
def _(m: MarketTables) -> DataFrame:
    rows = m.features().withColumn(
        "gvkey", F.lpad(F.floor((F.col("permno") - 10000) / 2).cast("string"), 6, "0")
    )
    totals = spread_group_stats(
        rows, ["gvkey", "date"], F.sum("market_equity").alias("firm_me"),
        F.count("permno").alias("n_classes"),
    )
    return totals.withColumn("share", F.col("market_equity") / F.col("firm_me"))


@query("jon_07_june_assignment", "permno:i date:d characteristic_year:i gvkey "
       "accounting_datadate:d accounting_available_from:d book_to_market:6 "
       "stockholders_equity_source")
def _(m: MarketTables) -> DataFrame:
    return accounting.assign_monthly(m.features(), m.annual_bm())


@query("jon_08_attach_diagnostics", "permno:i formation_date:d model n_unique_predictions:i "
       "prediction_range:8 prediction_status")
def _(m: MarketTables) -> DataFrame:
    rows = m.predictions_long()
    groups = stage(portfolios.prediction_diagnostics_by_group(rows), "diagnostics")
    return rows.join(groups, [FORMATION, "model"])


@query("jon_09_reconciliation", "formation_date:d model weighting found_in differs:b")
def _(m: MarketTables) -> DataFrame:
    wide = m.deciles_wide()
    # The second side lacks one month, has one month changed and a rounding-size difference.
    month = F.month(FORMATION)
    other = wide.where(
        ~((F.year(FORMATION) == 1999) & (month == 3))
    ).withColumn(
        "D10",
        F.when((F.year(FORMATION) == 2000) & (month == 5), F.col("D10") + 0.25)
        .otherwise(F.col("D10") * (1.0 + 1e-13)),
    )
    return contracts.reconcile(
        wide, other, [FORMATION, "model", "weighting"], ["D1", "D10"],
        ["regime_binary", "n_stocks"],
    )


@query("jon_10_reference_series", "formation_date:d vix:12 regime differs_from_reference:b")
def _(m: MarketTables) -> DataFrame:
    changed = m.regimes().withColumn(
        "vix", F.when(F.month("date") == 4, F.col("vix") * 1.01).otherwise(F.col("vix"))
    )
    rows = m.panel().where(F.col("vix").isNotNull())
    return contracts.regime_month_violations(rows, changed)


@query("jon_11_transition_grid", "from_regime to_regime count:i")
def _(m: MarketTables) -> DataFrame:
    return regimes.transition_counts(m.three_regimes())


@query("jon_12_semi_join", "permno:i date:d market_equity:6")
def _(m: MarketTables) -> DataFrame:
    return universe.restrict_to_universe(
        m.features(), universe.top_by_market_equity(m.features(), "1998-01-31", 50, strict=False)
    )


@query("jon_13_semi_join_or", "permno:i date:d ticker")
def _(m: MarketTables) -> DataFrame:
    return universe.top_n_or_named(m.features(), "1998-01-31", 30, "t10007", min_price=5.0)


@query("jon_14_anti_join", "gvkey characteristic_year:i")
def _(m: MarketTables) -> DataFrame:
    return accounting.unmatched_firm_years(m.annual(), m.links())


@query("jon_17_lookup_with_default", "permno:i formation_date:d benchmark_prediction:8")
def _(m: MarketTables) -> DataFrame:
    train = m.sample().where(F.col(FORMATION) < F.lit("1999-01-01").cast("date"))
    own = train.groupBy("permno").agg(F.avg(TARGET).alias("own"))
    pooled = train.agg(F.avg(TARGET).alias("pooled"))
    test = m.sample().where(F.col(FORMATION) >= F.lit("1999-01-01").cast("date"))
    return test.join(own, "permno", "left").withColumn(
        "benchmark_prediction", F.coalesce(F.col("own"), pooled.scalar())
    )


@query("jon_18_report_merge", "year:i rows:i high_months:i low_months:i")
def _(m: MarketTables) -> DataFrame:
    rows = m.panel().groupBy(F.year(FORMATION).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    months = m.regimes().groupBy(F.year("date").alias("year")).agg(
        F.count_if(F.col("regime") == "HIGH").alias("high_months"),
        F.count_if(F.col("regime") == "LOW").alias("low_months"),
    )
    return rows.join(months, "year", "left")


@query("jon_19_parameter_grid", "fold:i validation_month:d train_months:i alpha:6 l1_ratio:4")
def _(m: MarketTables) -> DataFrame:
    grid = F.array(*[
        F.struct(F.lit(a).alias("alpha"), F.lit(r).alias("l1_ratio"))
        for a in (0.0001, 0.001, 0.01, 0.1) for r in (0.1, 0.5, 0.9)
    ])
    folds = splits.forward_folds(m.sample(), 5, 24)
    return folds.withColumn("g", F.explode(grid)).select("*", "g.*")


# --- windows ---------------------------------------------------------------------------
@query("win_01_calendar_lead_lag", "permno:i date:d next_month_return:8 me_lag:6")
def _(m: MarketTables) -> DataFrame:
    rows = m.prices().withColumn("market_equity", features.market_equity())
    indexed = features.with_calendar_index(rows)
    return indexed.withColumn("next_month_return", features.calendar_shift("ret", 1)).withColumn(
        "me_lag", features.calendar_shift("market_equity", -1)
    )


@query("win_02_momentum", "permno:i date:d mom_12_2:6")
def _(m: MarketTables) -> DataFrame:
    return features.with_calendar_index(m.prices()).withColumn(
        "mom_12_2", features.momentum_12_2()
    )


@query("win_03_expanding_median", "date:d vix_expanding_median:12")
def _(m: MarketTables) -> DataFrame:
    return regimes.label_binary_regime(m.index_monthly())


@query("win_04_expanding_terciles", "date:d vix_expanding_median:12 vix_expanding_q33:12 "
       "vix_expanding_q67:12 regime_binary regime_3state")
def _(m: MarketTables) -> DataFrame:
    return regimes.expanding_regimes(m.index_monthly(), min_periods=6)


@query("win_05_row_lag", "permno:i date:d previous_row_me:6")
def _(m: MarketTables) -> DataFrame:
    w = Window.partitionBy("permno").orderBy("date")
    rows = m.features().where(F.month("date") != 7)
    return rows.withColumn("previous_row_me", F.lag("market_equity", 1).over(w))


@query("win_06_average_rank", "permno:i formation_date:d model avg_rank:2 pct_rank:8")
def _(m: MarketTables) -> DataFrame:
    ranked = average_ranks(m.predictions_long(), [FORMATION, "model"], "prediction")
    return ranked.withColumn("pct_rank", F.col("avg_rank") / F.col("group_size"))


@query("win_07_deciles", "permno:i formation_date:d model decile:i decile_status")
def _(m: MarketTables) -> DataFrame:
    return portfolios.assign_deciles(m.predictions_long())


@query("win_08_tie_preserving_deciles", "permno:i formation_date:d model portfolio:i")
def _(m: MarketTables) -> DataFrame:
    return portfolios.assign_tie_preserving(m.predictions_long())


@query("win_09_priority_dedup", "gvkey characteristic_year:i permno:i linktype linkprim linkdt:d")
def _(m: MarketTables) -> DataFrame:
    return accounting.resolve_pair_duplicates(
        accounting.valid_link_rows(m.annual(), m.links())
    )


@query("win_10_keep_last", "gvkey datadate:d fyear:i accounting_year:i")
def _(m: MarketTables) -> DataFrame:
    return accounting.annual_accounting(m.fundamentals())


@query("win_11_keep_last_per_date", "date:d vix:12")
def _(m: MarketTables) -> DataFrame:
    # Of three rows of a date the last counts, which is neither the largest nor the smallest.
    monthly = m.index_monthly()
    parts = [monthly.withColumns({"vix": F.col("vix") + gap, "place": F.lit(place)})
             for place, gap in enumerate((1.0, -1.0, 0.0))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return regimes.label_binary_regime(rows, "place")


@query("win_12_standardize", "permno:i date:d log_me_z:8 mom_12_2_z:6")
def _(m: MarketTables) -> DataFrame:
    return transforms.standardize_by_month(m.features(), ["log_me", "mom_12_2"])


@query("win_13_winsorize", "permno:i date:d log_me:8 mom_12_2:6")
def _(m: MarketTables) -> DataFrame:
    return transforms.winsorize_by_month(m.features(), ["log_me", "mom_12_2"], 0.05, 0.95)


@query("win_14_rolling_rmse", "model date:d rmse:8 rolling_rmse:8")
def _(m: MarketTables) -> DataFrame:
    return reports.rolling_rmse(m.predictions())


@query("win_15_cumulative_return", "formation_date:d model weighting cumulative_return:8")
def _(m: MarketTables) -> DataFrame:
    from monthloom.operators.summaries import cumulative_returns

    rows = m.deciles_wide().withColumn(
        "D10_minus_D1", F.when(F.month(FORMATION) != 2, F.col("D10_minus_D1"))
    )
    return cumulative_returns(rows, ["model", "weighting"], "D10_minus_D1")


@query("win_16_previous_state", "date:d regime_3state from_regime")
def _(m: MarketTables) -> DataFrame:
    # One row per calendar month.
    w = Window.orderBy("date")
    return m.three_regimes().withColumn("from_regime", F.lag("regime_3state").over(w))


@query("win_17_month_gaps", "permno:i date:d months_since_previous:i")
def _(m: MarketTables) -> DataFrame:
    w = Window.partitionBy("permno").orderBy("date")
    step = month_index("date") - F.lag(month_index("date")).over(w)
    return m.prices().withColumn("months_since_previous", step).where("months_since_previous > 1")


@query("win_18_adjacent_increases", "model weighting n_increases:i")
def _(m: MarketTables) -> DataFrame:
    w = Window.partitionBy("model", "weighting").orderBy(FORMATION)
    up = F.col("D10_minus_D1") > F.lag("D10_minus_D1").over(w)
    return m.deciles_wide().withColumn("up", up).groupBy("model", "weighting").agg(
        F.count_if("up").alias("n_increases")
    )


@query("win_19_pooled_benchmark", "formation_date:d benchmark_prediction:8")
def _(m: MarketTables) -> DataFrame:
    return splits.pooled_benchmark(m.sample())


@query("win_20_stock_benchmark", "permno:i formation_date:d benchmark_prediction:8")
def _(m: MarketTables) -> DataFrame:
    return splits.stock_benchmark(m.sample())


# --- sorts and limits ------------------------------------------------------------------
@query("srt_01_fixed_universe", "permno:i")
def _(m: MarketTables) -> DataFrame:
    return universe.top_by_market_equity(m.features(), "1997-06-30", 25, strict=False)


@query("srt_02_top_n_history", "permno:i date:d market_equity:6")
def _(m: MarketTables) -> DataFrame:
    return universe.top_n_or_named(m.features(), "1999-12-31", 20, None)


@query("srt_03_tail_audit", "audit_variable tail tail_rank:i permno:i formation_date:d "
       "book_to_market:6 me:4 ticker")
def _(m: MarketTables) -> DataFrame:
    return reports.extreme_rows(m.panel(), 10)


@query("srt_04_row_limit", "permno:i date:d prc:8")
def _(m: MarketTables) -> DataFrame:
    return scans.security_monthly(m.security_file(), "1996-01-01", "1996-12-31", limit=40)


@query("srt_05_monthly_sample", "permno:i formation_date:d next_month_return:8")
def _(m: MarketTables) -> DataFrame:
    return universe.monthly_hash_sample(m.sample(), 20, seed=42)


@query("srt_05_sample_sizes", "formation_date:d n_rows:i")
def _(m: MarketTables) -> DataFrame:
    return universe.monthly_hash_sample(m.sample(), 20, seed=42).groupBy(FORMATION).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query("srt_06_sorted_output", "formation_date:d model weighting D10_minus_D1:8")
def _(m: MarketTables) -> DataFrame:
    return m.deciles_wide().orderBy(FORMATION, "model", "weighting")


# --- set operations and reshaping ------------------------------------------------------
@query("set_01_union_all", "permno:i formation_date:d source")
def _(m: MarketTables) -> DataFrame:
    a = m.sample().select("permno", FORMATION, F.lit("sample").alias("source"))
    b = m.predictions().select("permno", FORMATION, F.lit("predictions").alias("source"))
    return a.unionByName(b)


@query("set_02_union_missing_columns", "panel model weighting formation_date:d D10_minus_D1:8 "
       "spearman_ic:8")
def _(m: MarketTables) -> DataFrame:
    return reshape.union_with_panel({
        "spread": m.deciles_wide().select("model", "weighting", FORMATION, "D10_minus_D1"),
        "rank_ic": m.monthly_ic().select("model", FORMATION, "spearman_ic"),
    })


@query("set_03_distinct_months", "formation_date:d regime_3state")
def _(m: MarketTables) -> DataFrame:
    return m.three_state_predictions().select(FORMATION, "regime_3state").distinct()


@query("set_04_domain_difference", "gvkey found_in")
def _(m: MarketTables) -> DataFrame:
    return reshape.set_difference(m.annual(), accounting.filter_links(m.links()), "gvkey")


@query("set_05_duplicate_counts", "gvkey year:i n_rows:i excess:i")
def _(m: MarketTables) -> DataFrame:
    years = m.fundamentals().withColumn("year", F.year("datadate"))
    return contracts.duplicate_keys(years, ["gvkey", "year"]).withColumn(
        "excess", F.col("n_rows") - 1
    )


@query("set_06_models_to_rows", "permno:i formation_date:d model prediction:10")
def _(m: MarketTables) -> DataFrame:
    return reshape.models_to_rows(m.predictions())


@query("set_07_models_to_columns", "permno:i date:d vix:12 regime actual_next_month_return:8 "
       "elastic_net_prediction:10 xgboost_prediction:10")
def _(m: MarketTables) -> DataFrame:
    wide = reshape.models_to_columns(
        m.predictions_long(), ["permno", "date"], list(MODEL_COLUMNS),
        ["vix", "regime", "actual_next_month_return"],
    )
    return wide.withColumnsRenamed({f"{k}_prediction": v for k, v in MODEL_COLUMNS.items()})


@query("set_08_deciles_to_columns", "formation_date:d model weighting D1:8 D2:8 D5:8 D10:8 "
       "n_D1:i n_D10:i n_stocks:i D10_minus_D1:8")
def _(m: MarketTables) -> DataFrame:
    return portfolios.decile_returns_wide(m.deciles_long())


@query("set_09_long_short", "formation_date:d realized_return_date:d model weighting "
       "regime_binary regime_3state D10_return:8 D1_return:8 D10_minus_D1:8 n_stocks:i")
def _(m: MarketTables) -> DataFrame:
    return portfolios.long_short(m.deciles_wide())


@query("set_10_prediction_export", "formation_date:d permno:i model prediction:10 "
       "value_weight_date:d me_lag:6 train_feature_end_date:d")
def _(m: MarketTables) -> DataFrame:
    return reshape.prediction_export(m.predictions_long())


# --- contracts -------------------------------------------------------------------------
# Each query breaks some cells on purpose, so that the check has something to find.
def _broken(m: MarketTables) -> DataFrame:
    """Panel with faults in the rows of some securities."""
    k, hit = F.col("permno"), F.month(FORMATION) == 9
    return m.panel().withColumns({
        REALIZED: F.when((k % 31 == 1) & hit, F.last_day(F.add_months(REALIZED, 1)))
        .otherwise(F.col(REALIZED)),
        "me": F.when((k % 29 == 2) & hit, F.col("me") * 1.01).otherwise(F.col("me")),
        "log_me": F.when((k % 23 == 3) & hit, F.col("log_me") + 0.5).otherwise(F.col("log_me")),
        "book_to_market": F.when((k % 19 == 4) & hit, F.col("book_to_market") * 2.0)
        .otherwise(F.col("book_to_market")),
        "accounting_eligibility_date": F.when(
            (k % 17 == 5) & hit, F.make_date(F.year(FORMATION) + 1, F.lit(6), F.lit(30))
        ).otherwise(F.col("accounting_eligibility_date")),
        "price_eligible": F.when((k % 13 == 6) & hit, ~F.col("price_eligible"))
        .otherwise(F.col("price_eligible")),
        "regime": F.when((k == 10007) & hit, F.lit("HIGH")).otherwise(F.col("regime")),
        "date": F.when((k % 11 == 7) & hit, F.last_day(F.add_months("date", 1)))
        .otherwise(F.col("date")),
    })


@query("dq_01_required_columns", "column present:b n_rows:i n_values:i")
def _(m: MarketTables) -> DataFrame:
    """Required columns, whether the panel has them, and how many of its rows hold a value."""
    contracts.require_columns(m.panel(), ["permno", FORMATION, REALIZED, *FEATURES, TARGET])
    contracts.reject_standardized_shadows(m.panel())
    wanted = ["permno", FORMATION, REALIZED, *FEATURES, TARGET, "log_me_z"]
    have = set(m.panel().columns)
    counts = m.panel().agg(F.count(F.lit(1)).alias("__rows"), *[
        F.count(c if c in have else F.lit(None)).alias(c) for c in wanted])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"),
                               F.col(c).alias("n_values")) for c in wanted])
    return counts.select(F.col("__rows").alias("n_rows"), F.explode(cells).alias("c")).select(
        "n_rows", "c.*")


@query("dq_02_unique_key", "permno:i date:d n_rows:i")
def _(m: MarketTables) -> DataFrame:
    rows = m.prices().select("permno", "date")
    twice = rows.unionByName(rows.where(F.col("permno") % 10 == 3))
    return contracts.duplicate_keys(twice, ["permno", "date"])


@query("dq_03_target_date", "permno:i formation_date:d realized_return_date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.target_date_violations(_broken(m))


@query("dq_04_size_identity", "permno:i formation_date:d bad_me:b bad_nonpositive:b bad_log:b")
def _(m: MarketTables) -> DataFrame:
    return contracts.size_violations(_broken(m))


@query("dq_05_book_to_market", "permno:i formation_date:d book_to_market:6")
def _(m: MarketTables) -> DataFrame:
    return contracts.book_to_market_violations(_broken(m))


@query("dq_05_median_range", "median:8 in_range:b")
def _(m: MarketTables) -> DataFrame:
    return reports.economic_sanity(m.panel()).select(
        F.col("book_to_market_median").alias("median"),
        (F.col("unit_sanity_status") == "pass").alias("in_range"),
    )


@query("dq_06_accounting_timing", "permno:i formation_date:d accounting_eligibility_date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.accounting_timing_violations(_broken(m))


@query("dq_07_price_flag", "permno:i formation_date:d prc:8 price_eligible:b")
def _(m: MarketTables) -> DataFrame:
    return contracts.price_flag_violations(_broken(m))


@query("dq_08_regime_constancy", "formation_date:d not_constant:b")
def _(m: MarketTables) -> DataFrame:
    return contracts.regime_month_violations(_broken(m)).where("not_constant")


def _broken_predictions(m: MarketTables) -> DataFrame:
    k = F.col("permno")
    late = (k % 41 == 1) & (F.month(FORMATION) == 5)
    return m.predictions().withColumns({
        "train_feature_end_date": F.when(late, F.col(FORMATION))
        .otherwise(F.col("train_feature_end_date")),
        "xgboost_prediction": F.when(
            (k % 43 == 2) & (F.month(FORMATION) == 6), F.lit(float("inf"))
        ).otherwise(F.col("xgboost_prediction")),
        "me_lag_date": F.when((k % 37 == 3) & (F.month(FORMATION) == 8), F.col(FORMATION))
        .otherwise(F.col("me_lag_date")),
    })


@query("dq_09_leakage", "permno:i formation_date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.leakage_violations(
        _broken_predictions(m), ["elastic_net_prediction", "xgboost_prediction"]
    )


def _broken_assignments(m: MarketTables) -> DataFrame:
    y, mth = F.year(FORMATION), F.month(FORMATION)
    rows = m.assignments().where(
        ~((y == 1999) & (mth == 4) & (F.col("model") == "XGBoost"))
    )
    return rows.withColumns({
        "decile": F.when((y == 2000) & (mth == 2) & (F.col("decile") == 4), 5)
        .when((y == 1998) & (mth == 7) & (F.col("permno") % 10 == 1), 11)
        .otherwise(F.col("decile")),
        "realized_next_month_return": F.when(
            (y == 1997) & (mth == 3) & (F.col("permno") % 10 == 2), F.lit(float("nan"))
        ).otherwise(F.col("realized_next_month_return")),
    })


@query("dq_10_decile_months", "formation_date:d model n_deciles:i")
def _(m: MarketTables) -> DataFrame:
    return contracts.malformed_decile_months(_broken_assignments(m))


@query("dq_10_spread_arithmetic", "check n_rows:i")
def _(m: MarketTables) -> DataFrame:
    wide = m.deciles_wide().withColumn(
        "D10_minus_D1",
        F.when(F.month(FORMATION) == 10, F.col("D10_minus_D1") + 1.0)
        .otherwise(F.col("D10_minus_D1")),
    )
    return _stack([
        _count(contracts.spread_arithmetic_violations(wide), "changed"),
        _count(contracts.spread_arithmetic_violations(m.deciles_wide()), "original"),
    ])


@query("dq_11_assignment_contract", "check n_rows:i")
def _(m: MarketTables) -> DataFrame:
    rows = _broken_assignments(m)
    return _stack([
        _count(contracts.assignment_violations(rows), "rows"),
        _count(contracts.month_gaps(rows), "gaps"),
        _count(contracts.months_missing_for_a_model(rows), "models"),
        _count(contracts.inconsistent_months(rows), "months"),
        _count(contracts.duplicate_keys(rows, [FORMATION, "model", "permno"]), "keys"),
    ])


@query("dq_12_weights", "formation_date:d model weighting decile:i total:8")
def _(m: MarketTables) -> DataFrame:
    from monthloom.operators.costs import target_weights

    w = target_weights(m.assignments()).withColumn(
        "target_weight",
        F.when(F.month(FORMATION) == 11, F.col("target_weight") * 1.5)
        .otherwise(F.col("target_weight")),
    )
    return contracts.weight_sum_violations(
        w, [FORMATION, "model", "weighting", "decile"], "target_weight"
    )


@query("dq_13_summary_consistency", "model weighting regime_definition regime")
def _(m: MarketTables) -> DataFrame:
    from monthloom.operators.summaries import spread_summary

    series = regimes.with_regime_definitions(m.deciles_wide())
    stored = spread_summary(m.deciles_wide()).withColumn(
        "mean_D10_minus_D1",
        F.when(F.col("regime") == "HIGH", F.col("mean_D10_minus_D1") + 1e-6)
        .otherwise(F.col("mean_D10_minus_D1")),
    )
    return contracts.summary_mismatches(
        stored, series, ["model", "weighting", "regime_definition", "regime"],
        "mean_D10_minus_D1", "D10_minus_D1",
    )


@query("dq_14_value_weight_date", "permno:i formation_date:d me_lag_date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.value_weight_date_violations(_broken_predictions(m))


@query("dq_15_table_fingerprint", "table n_rows:i same_content:b")
def _(m: MarketTables) -> DataFrame:
    a = contracts.fingerprint(m.prices())
    b = contracts.fingerprint(m.prices().repartition(7, "date"))
    return a.withColumnRenamed("content_hash", "h").join(
        b.select("n_rows", F.col("content_hash").alias("g")), "n_rows"
    ).select(F.lit("prices").alias("table"), "n_rows", (F.col("h") == F.col("g"))
             .alias("same_content"))


_PRICE_TEXT = {
    "permno": "permno", "ticker": "ticker", "date": "date",
    "shares": "CAST(floor(shrout) AS BIGINT)", "price": "CAST(floor(prc * 1000) AS BIGINT)",
    "return": "CAST(floor(ret * 1000) AS BIGINT)",
}


def _price_tree(prices: DataFrame) -> DataFrame:
    plain = prices.select(*[F.expr(e).alias(n) for n, e in _PRICE_TEXT.items()])
    return fingerprints.fingerprint_tree(plain, "permno", list(_PRICE_TEXT))


@query("dq_15_fingerprint_nodes", "level:i node:i first_key:i last_key:i n_rows:i low:i high:i")
def _(m: MarketTables) -> DataFrame:
    return _price_tree(m.prices())


@query("dq_15_changed_ranges", "level:i node:i first_key:i last_key:i n_left:i n_right:i")
def _(m: MarketTables) -> DataFrame:
    """A copy of the price table with some corrected shares and one security's year left out."""
    prices = m.prices()
    corrected = (F.col("permno") % 23 == 5) & (F.month("date") == 3)
    missing = (F.col("permno") % 41 == 7) & (F.year("date") == 1997)
    copy = prices.withColumn(
        "shrout", F.when(corrected, F.col("shrout") + 1).otherwise(F.col("shrout"))
    ).where(~missing)
    return fingerprints.changed_ranges(_price_tree(prices), _price_tree(copy))


@query("dq_16_panel_metadata", "rows:i unique_permnos:i formation_start:d formation_end:d "
       "realized_return_start:d realized_return_end:d complete_case_rows:i "
       "complete_case_permnos:i size_valid:i size_missing:i market_equity_nonpositive:i "
       "book_to_market_valid:i high_months:i low_months:i")
def _(m: MarketTables) -> DataFrame:
    from monthloom.plans.panel_build import validate_panel

    return validate_panel(m.panel(), m.regimes(), require_regime=False)


@query("dq_17_monthly_series", "model formation_date:d spearman_ic:8 regime_binary regime_3state")
def _(m: MarketTables) -> DataFrame:
    lower = m.monthly_ic().withColumn("regime_binary", F.lower("regime_binary"))
    return contracts.check_monthly_series(lower, ["model"], "spearman_ic", list(MODEL_COLUMNS))


@query("dq_18_incomplete_inputs", "permno:i formation_date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.incomplete_model_inputs(m.panel())


@query("dq_19_date_agreement", "permno:i formation_date:d date:d")
def _(m: MarketTables) -> DataFrame:
    return contracts.formation_date_mismatch(_broken(m))


@query("dq_20_predictions_unchanged", "check n_rows:i")
def _(m: MarketTables) -> DataFrame:
    before = m.predictions_long()
    after = m.assignments()
    both = before.select(FORMATION, "model", "permno", "prediction").join(
        after.select(FORMATION, "model", "permno"), [FORMATION, "model", "permno"], "left_semi"
    )
    diff = contracts.reconcile(
        both, after, [FORMATION, "model", "permno"], ["prediction"], rtol=0.0, atol=0.0
    )
    return _stack([_count(diff, "changed"), _count(after, "compared")])


@query("dq_21_one_date_and_regime", "formation_date:d model")
def _(m: MarketTables) -> DataFrame:
    rows = m.assignments().withColumn(
        "regime_3state",
        F.when((F.month(FORMATION) == 12) & (F.col("permno") % 50 == 0), F.lit("other"))
        .otherwise(F.col("regime_3state")),
    )
    return contracts.inconsistent_months(rows)
