"""Queries on scans, sinks, projections and filters."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    characteristic_year, finite_double, is_close, month_end, month_end_shift, numeric_or_null,
    one_way_cost, safe_double, significance_stars,
)
from monthloom.operators import accounting, features, panel, universe
from monthloom.operators.exact_sums import exact_sums
from monthloom.operators.regimes import binary_label, three_state_label, with_regime_definitions
from monthloom.plans.catalog import query
from monthloom.schema import FORMATION
from monthloom.sources import scans, sinks
from monthloom.sources.market_tables import MarketTables
from monthloom.staging import stage_path


def _sum_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total")
    )


# --- scans -----------------------------------------------------------------------------
@query("src_01_parquet_scan", "s_suppkey:i s_name s_nationkey:i s_acctbal:4")
def _(m: MarketTables) -> DataFrame:
    return scans.scan(m.spark, f"{m.folder}/supplier.parquet")


@query("src_02_projected_scan", "l_suppkey:i l_shipdate:d l_extendedprice:4")
def _(m: MarketTables) -> DataFrame:
    return scans.projected_scan(
        m.spark, f"{m.folder}/lineitem.parquet", ["l_suppkey", "l_shipdate"],
        ["l_extendedprice", "no_such_column"],
    )


@query("src_03_csv_scan", "date:d vix:12 source_type")
def _(m: MarketTables) -> DataFrame:
    path = stage_path(m.spark, "index-csv")
    sinks.write_csv(m.index_text(), path)
    return scans.index_from_csv(scans.scan(m.spark, path, "csv"), "1995-02-01", "2001-06-30")


@query("src_04_scan_dispatch", "file_format rows:i total:2")
def _(m: MarketTables) -> DataFrame:
    path = stage_path(m.spark, "index") + ".csv"
    sinks.write_csv(m.index_daily(), path)
    text = scans.scan(m.spark, path).select(safe_double("vix").alias("v"))
    binary = scans.scan(m.spark, f"{m.folder}/orders.parquet").select(
        (F.col("o_totalprice") / 10000.0).alias("v")
    )
    agg = [F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total")]
    return text.agg(*agg).withColumn("file_format", F.lit("csv")).unionByName(
        binary.agg(*agg).withColumn("file_format", F.lit("parquet"))
    )


@query("src_05_security_monthly", "permno:i date:d ticker ret:8 prc:8 shrout:4 market_equity:6 "
       "primaryexch issuertype")
def _(m: MarketTables) -> DataFrame:
    return scans.security_monthly(m.security_file(), "1996-01-01", "2000-12-31", min_price=5.0)


@query("src_06_normalize_security", "permno:i date:d ret:8 prc:8 shrout:4 market_equity:6 "
       "me_lag:6 source_format source_table")
def _(m: MarketTables) -> DataFrame:
    raw = scans.security_monthly(m.security_file(), "1995-01-01", "2001-12-31")
    raw = raw.drop("market_equity").withColumnRenamed("prc", "PRC")
    return scans.normalize_security_monthly(raw, "ciz", "security_file")


@query("src_07_fundamentals", "gvkey datadate:d fyear:i fyr:i seq:6 ceq:6 at:6 lt:6 txditc:6 "
       "txdb:6 itcb:6 pstkrv:6 pstkl:6 pstk:6 curcd source_table")
def _(m: MarketTables) -> DataFrame:
    firms = accounting.filter_links(m.links()).select("gvkey").distinct()
    return scans.fundamentals(m.fundamentals_file(), "1995-06-01", "2000-12-31", firms)


@query("src_08_link_history", "gvkey lpermno:i linktype linkprim linkdt:d linkenddt:d")
def _(m: MarketTables) -> DataFrame:
    return scans.link_history(m.links().withColumnRenamed("lpermno", "PERMNO"))


@query("src_09_index_daily", "date:d vix:12 source_type source_value_col")
def _(m: MarketTables) -> DataFrame:
    return scans.index_daily(m.index_daily(), "1996-01-01", "1999-12-31")


@query("src_10_read_through", "date:d vix:12")
def _(m: MarketTables) -> DataFrame:
    path = stage_path(m.spark, "read-through")
    sinks.read_through(m.spark, path, m.index_monthly)
    return sinks.read_through(m.spark, path, lambda: m.index_monthly().limit(0))


@query("src_11_source_fallback", "date:d vix:12 source_type")
def _(m: MarketTables) -> DataFrame:
    return scans.first_available(
        m.spark, "no_such_index_table", lambda t: scans.index_daily(t, "1995-01-01", "2001-12-31"),
        lambda: scans.index_from_csv(m.index_text()),
    )


# --- sinks -----------------------------------------------------------------------------
@query("snk_01_parquet_sink", "permno:i n_rows:i total:6")
def _(m: MarketTables) -> DataFrame:
    path = sinks.write_parquet(
        m.prices().withColumn("year", F.year("date")), stage_path(m.spark, "prices"), ("year",)
    )
    return _sum_by(m.spark.read.parquet(path), "permno", "shrout")


@query("snk_02_csv_sink", "permno:i date:d prc:8 ret:8 equal_after_reading:b")
def _(m: MarketTables) -> DataFrame:
    rows = m.prices().select("permno", "date", "prc", "ret")
    path = sinks.write_csv(rows, stage_path(m.spark, "prices-csv"))
    back = m.spark.read.option("header", True).schema(
        "permno BIGINT, date DATE, p DOUBLE, r DOUBLE"
    ).csv(path)
    same = F.col("p").eqNullSafe(F.col("prc")) & F.col("r").eqNullSafe(F.col("ret"))
    return rows.join(back, ["permno", "date"], "left").withColumn("equal_after_reading", same)


@query("snk_03_resumable_months", "formation_date:d n_rows:i mean_return:8 run")
def _(m: MarketTables) -> DataFrame:
    rows = m.predictions()
    path = stage_path(m.spark, "monthly-runs")

    def compute(months: DataFrame, run: str) -> DataFrame:
        return rows.join(months, FORMATION, "left_semi").groupBy(FORMATION).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("actual_next_month_return").alias("mean_return"),
            F.lit(run).alias("run"),
        )

    early = rows.where(F.col(FORMATION) < F.lit("1999-01-01").cast("date"))
    sinks.resume_months(m.spark, path, early, lambda t: compute(t, "first"),
                        run_key="design-1")
    return sinks.resume_months(m.spark, path, rows, lambda t: compute(t, "second"),
                               run_key="design-1")


@query("snk_04_json_metadata", "rows:i first_month:d last_month:d")
def _(m: MarketTables) -> DataFrame:
    facts = m.prices().agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_month"),
        F.max("date").alias("last_month"),
    )
    path = sinks.write_json(facts, stage_path(m.spark, "metadata"))
    return m.spark.read.schema("rows BIGINT, first_month DATE, last_month DATE").json(path)


# --- projections -----------------------------------------------------------------------
@query("prj_01_safe_numeric", "p_partkey:i size_text price_or_null:4 inverse_size:8 absent:4")
def _(m: MarketTables) -> DataFrame:
    size = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    rows = m.raw("part").withColumn("size_text", size)
    infinite = F.when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(
        F.lit(1.0) / F.col("p_size")
    )
    return rows.select(
        "p_partkey", "size_text", safe_double("size_text").alias("price_or_null"),
        finite_double(infinite).alias("inverse_size"),
        numeric_or_null(rows, "absent").alias("absent"),
    )


@query("prj_02_month_end", "day:d month_end:d next_end:d previous_end:d again:d n_orders:i")
def _(m: MarketTables) -> DataFrame:
    days = m.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return days.select(
        "day", month_end("day").alias("month_end"), month_end_shift("day", 1).alias("next_end"),
        month_end_shift("day", -1).alias("previous_end"),
        month_end(month_end("day")).alias("again"), "n_orders",
    )


@query("prj_03_stockholders_equity",
       "gvkey datadate:d stockholders_equity:6 stockholders_equity_source")
def _(m: MarketTables) -> DataFrame:
    return accounting.stockholders_equity(m.fundamentals())


@query("prj_04_preferred_stock", "gvkey datadate:d preferred_stock:6 preferred_stock_source")
def _(m: MarketTables) -> DataFrame:
    return accounting.preferred_stock(m.fundamentals())


@query("prj_05_deferred_taxes", "gvkey datadate:d deferred_taxes_itc:6 deferred_taxes_source")
def _(m: MarketTables) -> DataFrame:
    return accounting.deferred_taxes(m.fundamentals())


@query("prj_06_book_equity", "gvkey datadate:d book_equity:6 book_equity_valid:b")
def _(m: MarketTables) -> DataFrame:
    return accounting.book_equity(m.fundamentals())


@query("prj_07_market_equity", "permno:i date:d market_equity:6 log_me:8")
def _(m: MarketTables) -> DataFrame:
    rows = m.prices().withColumn("market_equity", features.market_equity())
    return rows.withColumn("log_me", features.log_positive("market_equity"))


@query("prj_08_characteristic_year",
       "permno:i date:d characteristic_year:i available_from:d active_through:d")
def _(m: MarketTables) -> DataFrame:
    year = F.col("characteristic_year")
    return m.prices().withColumn("characteristic_year", characteristic_year("date")).select(
        "permno", "date", "characteristic_year",
        F.make_date(year, F.lit(6), F.lit(30)).alias("available_from"),
        F.make_date(year + 1, F.lit(5), F.lit(31)).alias("active_through"),
    )


@query("prj_09_panel_flags", "permno:i formation_date:d realized_return_date:d "
       "target_available:b baseline_predictors_complete:b price_eligible:b "
       "baseline_complete_case:b accounting_eligibility_date:d accounting_active_through:d")
def _(m: MarketTables) -> DataFrame:
    built = m.panel().drop(
        "target_available", "baseline_predictors_complete", "baseline_complete_case", FORMATION
    )
    return panel.finalize_panel(built)


@query("prj_10_binary_label", "date:d vix:12 vix_expanding_median:12 regime")
def _(m: MarketTables) -> DataFrame:
    return m.three_regimes().withColumn(
        "regime", binary_label(F.col("vix"), F.col("vix_expanding_median"))
    )


@query("prj_11_three_state_label", "date:d vix:12 regime")
def _(m: MarketTables) -> DataFrame:
    label = three_state_label(
        F.col("vix"), F.col("vix_expanding_q33"), F.col("vix_expanding_q67")
    )
    return m.three_regimes().withColumn("regime", label)


@query("prj_12_significance_stars", "l_orderkey:i l_linenumber:i l_discount:4 stars")
def _(m: MarketTables) -> DataFrame:
    return m.raw("lineitem").withColumn("stars", significance_stars("l_discount"))


@query("prj_13_one_way_cost", "permno:i formation_date:d model net:8")
def _(m: MarketTables) -> DataFrame:
    rows = m.assignments().withColumn("turnover", F.col("decile") / 10.0)
    return rows.withColumn("net", one_way_cost("realized_next_month_return", "turnover", 50))


# --- filters ---------------------------------------------------------------------------
@query("flt_01_common_stock", "permno:i mthcaldt:d primaryexch issuertype")
def _(m: MarketTables) -> DataFrame:
    return m.security_file().where(universe.common_stock())


@query("flt_02_legacy_common_stock", "permno:i namedt:d shrcd:i exchcd:i")
def _(m: MarketTables) -> DataFrame:
    return m.names_history().where(universe.legacy_common_stock())


@query("flt_03_price_screen", "permno:i date:d prc:8 next_month_return:8")
def _(m: MarketTables) -> DataFrame:
    # The target was computed before the screen, so next month's price does not matter.
    return m.features().where(panel.price_eligible(5.0))


@query("flt_04_link_filter", "gvkey lpermno:i linktype linkprim linkdt:d linkenddt:d")
def _(m: MarketTables) -> DataFrame:
    return accounting.filter_links(m.links())


@query("flt_05_complete_case", "permno:i formation_date:d log_me:8 book_to_market:8 mom_12_2:8 "
       "next_month_return:8 regime")
def _(m: MarketTables) -> DataFrame:
    return panel.complete_case_sample(m.panel())


@query("flt_06_observable", "permno:i formation_date:d next_month_return:8")
def _(m: MarketTables) -> DataFrame:
    return panel.observable_as_of(m.panel(), "1998-06-15")


@query("flt_07_finite_rows", "p_partkey:i value:8")
def _(m: MarketTables) -> DataFrame:
    rows = m.raw("part").withColumn(
        "value",
        F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan")))
        .when(F.col("p_partkey") % 7 == 0, F.lit(float("-inf")))
        .when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")),
    )
    return rows.where(finite_double("value").isNotNull())


@query("flt_08_regime_subsets", "formation_date:d model weighting regime_definition regime")
def _(m: MarketTables) -> DataFrame:
    return with_regime_definitions(m.deciles_wide())


@query("flt_09_date_window", "permno:i date:d next_month_return:8 mom_12_2:8")
def _(m: MarketTables) -> DataFrame:
    return panel.cut_to_dates(m.features(), "1997-01-01", "1999-12-31")


# --- scalar functions ------------------------------------------------------------------
@query("fn_01_basic_math", "permno:i date:d a:8 b:8 c:8 d:i e:i f:8")
def _(m: MarketTables) -> DataFrame:
    prc = F.col("prc")
    return m.prices().select(
        "permno", "date", F.abs(prc).alias("a"), F.ln(F.abs(prc)).alias("b"),
        F.sqrt(F.abs(prc)).alias("c"), F.floor(prc).alias("d"), F.ceil(prc).alias("e"),
        F.least(F.greatest(prc, F.lit(1.0)), F.lit(10.0)).alias("f"),
    )


@query("fn_02_normal_p", "c_custkey:i p_value:9")
def _(m: MarketTables) -> DataFrame:
    from monthloom.functions.scalars import two_sided_normal_p

    return m.raw("customer").withColumn(
        "p_value", two_sided_normal_p(F.col("c_acctbal") / 2500.0)
    )


@query("fn_03_normal_interval", "model weighting lower:8 upper:8")
def _(m: MarketTables) -> DataFrame:
    from monthloom.functions.scalars import Z_975

    x = F.col("D10_minus_D1")
    mean, se = F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))
    return m.deciles_wide().groupBy("model", "weighting").agg(
        (mean - Z_975 * se).alias("lower"), (mean + Z_975 * se).alias("upper")
    )


@query("fn_04_is_close", "permno:i date:d close:b loose:b")
def _(m: MarketTables) -> DataFrame:
    a, b = F.col("prc") * F.col("shrout"), F.floor(F.col("prc") * 10000.0) / 10000.0 * F.col("shrout")
    return m.prices().select(
        "permno", "date", is_close(a, b, 0.0, 1e-3).alias("close"),
        is_close(a, b, 1e-4, 0.0).alias("loose"),
    )


@query("fn_05_text", "c_custkey:i a b c")
def _(m: MarketTables) -> DataFrame:
    return m.raw("customer").select(
        "c_custkey", F.lower("c_name").alias("a"), F.upper("c_mktsegment").alias("b"),
        F.concat(F.trim("c_name"), F.lit("."), F.trim("c_mktsegment")).alias("c"),
    )


@query("fn_06_named_security", "permno:i mthcaldt:d ticker")
def _(m: MarketTables) -> DataFrame:
    return m.security_file().where(F.upper("ticker") == "t10007".upper())


@query("fn_07_calendar", "day:d y:i m:i end:d ahead:d made:d")
def _(m: MarketTables) -> DataFrame:
    return m.index_daily().select(
        F.col("date").alias("day"), F.year("date").alias("y"), F.month("date").alias("m"),
        F.last_day("date").alias("end"), month_end_shift("date", 3).alias("ahead"),
        F.make_date(F.year("date") + 1, F.lit(6), F.lit(30)).alias("made"),
    )


@query("fn_08_weighted_average", "formation_date:d model value:8 n_valid:i")
def _(m: MarketTables) -> DataFrame:
    w, r = F.col("weighting_variable"), F.col("realized_next_month_return")
    ok = (w > 0) & r.isNotNull()
    return m.assignments().groupBy(FORMATION, "model").agg(
        F.try_divide(F.sum(F.when(ok, w * r)), F.sum(F.when(ok, w))).alias("value"),
        F.count_if(ok).alias("n_valid"),
    )


@query("fn_09_exact_sum", "permno:i total:2 parts:4")
def _(m: MarketTables) -> DataFrame:
    exact = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    return m.raw("lineitem").groupBy(
        (F.col("l_suppkey") + 10000).alias("permno")
    ).agg(exact.alias("total"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("parts"))


@query("fn_09_exact_double_sum", "permno:i total:3")
def _(m: MarketTables) -> DataFrame:
    """Rounded once, so that values which cancel leave what is left of them."""
    taxed = F.col("l_extendedprice") * F.col("l_tax")
    shifted = F.when(F.col("l_linenumber") % 2 == 0, 1e9).otherwise(-1e9) + taxed
    rows = m.raw("lineitem").select((F.col("l_suppkey") + 10000).alias("permno"),
                                    shifted.alias("x"))
    return exact_sums(rows, ["permno"], "x")


@query("fn_10_annualize", "model weighting mean_year:8 sd_year:8")
def _(m: MarketTables) -> DataFrame:
    return m.deciles_wide().groupBy("model", "weighting").agg(
        (F.lit(12.0) * F.avg("D10_minus_D1")).alias("mean_year"),
        (F.sqrt(F.lit(12.0)) * F.stddev_samp("D10_minus_D1")).alias("sd_year"),
    )


@query("fn_11_params_json", "permno:i params")
def _(m: MarketTables) -> DataFrame:
    rows = m.raw("supplier").select((F.col("s_suppkey") + 10000).alias("permno"), "s_nationkey")
    return rows.select(
        "permno",
        F.to_json(F.struct(F.col("s_nationkey").alias("max_depth"),
                           F.lit("hist").alias("tree_method"))).alias("params"),
    )


@query("fn_12_code_rank", "gvkey lpermno:i prim_rank:i type_rank:i linkdt:d")
def _(m: MarketTables) -> DataFrame:
    from monthloom.functions.scalars import code_rank

    return m.links().select(
        "gvkey", "lpermno", "linkdt", code_rank("linkprim", {"P": 0, "C": 1}).alias("prim_rank"),
        code_rank("linktype", {"LC": 0, "LU": 1}).alias("type_rank"),
    )



