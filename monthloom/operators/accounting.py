"""Book equity, firm-security links and the June book-to-market assignment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    characteristic_year,
    code_rank,
    month_end,
    numeric_or_null,
    ratio,
    safe_double,
)
from monthloom.operators.contracts import duplicate_keys, enforce, require_columns
from monthloom.operators.ordering import side_by_side, spread_group_stats
from monthloom.schema import LINK_PRIMARY, LINK_TYPES, THOUSANDS_PER_MILLION
from monthloom.staging import stage

_ASSUMED_ZERO = "assumed_zero_missing"


def _first_available(options: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Value and source label of the first non-NULL option."""
    value = F.coalesce(*[c for _, c in options])
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in options])
    return value, label


def stockholders_equity(df: DataFrame) -> DataFrame:
    seq, ceq, pstk, at, lt = (numeric_or_null(df, c) for c in ("seq", "ceq", "pstk", "at", "lt"))
    value, source = _first_available(
        [("seq", seq), ("ceq_plus_pstk", ceq + pstk), ("at_minus_lt", at - lt)]
    )
    return df.withColumns(
        {"stockholders_equity": value, "stockholders_equity_source": source}
    )


def preferred_stock(df: DataFrame) -> DataFrame:
    value, source = _first_available(
        [(c, numeric_or_null(df, c)) for c in ("pstkrv", "pstkl", "pstk")]
        + [(_ASSUMED_ZERO, F.lit(0.0))]
    )
    return df.withColumns({"preferred_stock": value, "preferred_stock_source": source})


def deferred_taxes(df: DataFrame) -> DataFrame:
    txditc, txdb, itcb = (numeric_or_null(df, c) for c in ("txditc", "txdb", "itcb"))
    parts = F.when(
        txdb.isNotNull() | itcb.isNotNull(),
        F.coalesce(txdb, F.lit(0.0)) + F.coalesce(itcb, F.lit(0.0)),
    )
    value, source = _first_available(
        [("txditc", txditc), ("txdb_plus_itcb", parts), (_ASSUMED_ZERO, F.lit(0.0))]
    )
    return df.withColumns({"deferred_taxes_itc": value, "deferred_taxes_source": source})


def book_equity(df: DataFrame) -> DataFrame:
    out = deferred_taxes(preferred_stock(stockholders_equity(df)))
    be = F.col("stockholders_equity") + F.col("deferred_taxes_itc") - F.col("preferred_stock")
    return out.withColumn("book_equity", be).withColumn(
        "book_equity_valid", F.coalesce(F.col("book_equity") > 0, F.lit(False))
    )


def _dated_book_equity(funda: DataFrame) -> DataFrame:
    out = book_equity(funda).withColumn("datadate", F.col("datadate").try_cast("date"))
    return out.where(F.col("gvkey").isNotNull() & F.col("datadate").isNotNull()).withColumn(
        "accounting_year", F.year("datadate")
    )


def annual_accounting(funda: DataFrame) -> DataFrame:
    """Latest fiscal-year end per firm and calendar year, with its June availability."""
    dated = _dated_book_equity(funda)
    newest = [F.col("datadate").desc()]
    if "fyear" in dated.columns:
        newest.append(F.col("fyear").desc_nulls_last())
    # What still ties is settled by the whole row, so that no run depends on row order.
    newest += [F.to_json(F.struct(*sorted(funda.columns))).desc()]
    # A firm-year holds a handful of filings; the rank filter is applied before the shuffle too.
    w = Window.partitionBy("gvkey", "accounting_year").orderBy(*newest)
    return (
        dated.withColumn("__n", F.row_number().over(w))
        .where("__n = 1")
        .drop("__n")
        .withColumn("characteristic_year", F.col("accounting_year") + 1)
        .withColumn(
            "accounting_available_from", F.make_date("characteristic_year", F.lit(6), F.lit(30))
        )
    )


def annual_accounting_audit(funda: DataFrame) -> DataFrame:
    """Counts of inputs, duplicates and the sign of book equity."""
    dated = _dated_book_equity(funda)
    years = dated.groupBy("gvkey", "accounting_year").agg(F.count(F.lit(1)).alias("n"))
    dup = years.agg(
        F.sum("n").cast("bigint").alias("annual_rows_input"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
        .cast("bigint").alias("duplicate_firm_year_rows"),
        F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_firm_year_rows_removed"),
    )
    be = F.col("book_equity")
    signs = annual_accounting(funda).agg(
        F.count_if(be > 0).alias("annual_book_equity_valid"),
        F.count_if(be.isNull()).alias("annual_book_equity_missing"),
        F.count_if(be == 0).alias("annual_book_equity_zero"),
        F.count_if(be < 0).alias("annual_book_equity_negative"),
    )
    return side_by_side([dup, signs])


def normalize_links(links: DataFrame) -> DataFrame:
    return links.select(
        F.col("gvkey").cast("string").alias("gvkey"),
        F.col("lpermno").try_cast("bigint").alias("lpermno"),
        F.upper("linktype").alias("linktype"),
        F.upper("linkprim").alias("linkprim"),
        F.col("linkdt").try_cast("date").alias("linkdt"),
        F.col("linkenddt").try_cast("date").alias("linkenddt"),
    )


def filter_links(links: DataFrame) -> DataFrame:
    """Usable link types with both keys present."""
    return normalize_links(links).where(
        F.col("linktype").isin(*LINK_TYPES)
        & F.col("linkprim").isin(*LINK_PRIMARY)
        & F.col("gvkey").isNotNull()
        & F.col("lpermno").isNotNull()
    )


def valid_link_rows(annual: DataFrame, links: DataFrame) -> DataFrame:
    """Firm-years joined to links in force on the fiscal-year end; open ends are NULL.

    The annual side has one row per firm and year, so a firm with very many links
    still produces at most (years on file) rows per link; AQE splits such firms.
    """
    in_force = (F.col("linkdt").isNull() | (F.col("linkdt") <= F.col("datadate"))) & (
        F.col("linkenddt").isNull() | (F.col("datadate") <= F.col("linkenddt"))
    )
    return (
        annual.join(filter_links(links), "gvkey")
        .where(in_force)
        .withColumn("permno", F.col("lpermno"))
    )


def _prim_rank() -> Column:
    return code_rank("linkprim", {"P": 0, "C": 1})


def _type_rank() -> Column:
    return code_rank("linktype", {"LC": 0, "LU": 1})


def _keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve_pair_duplicates(valid: DataFrame) -> DataFrame:
    """One link per firm-year and security: primary, then LC, then latest start."""
    return _keep_first(
        valid,
        ["gvkey", "characteristic_year", "permno"],
        [_prim_rank(), _type_rank(), F.col("linkdt").desc_nulls_last(),
         F.col("linkenddt").asc_nulls_last()],
    )


def resolve_firm_conflicts(pairs: DataFrame) -> DataFrame:
    """One firm per security-year: primary, LC, latest accounting date, lowest firm key."""
    return _keep_first(
        pairs,
        ["permno", "characteristic_year"],
        [_prim_rank(), _type_rank(), F.col("datadate").desc_nulls_last(), F.col("gvkey").asc()],
    )


def link_accounting(annual: DataFrame, links: DataFrame) -> DataFrame:
    return resolve_firm_conflicts(resolve_pair_duplicates(valid_link_rows(annual, links)))


def link_audit(annual: DataFrame, links: DataFrame) -> DataFrame:
    """Counts at each step of the link resolution."""
    valid = valid_link_rows(annual, links)
    pairs = valid.groupBy("gvkey", "characteristic_year", "permno").agg(
        F.count(F.lit(1)).alias("n")
    )
    pair_counts = pairs.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
        .cast("bigint").alias("duplicate_ccm_rows_detected"),
        F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_ccm_rows_resolved"),
    )
    years = pairs.groupBy("permno", "characteristic_year").agg(F.count(F.lit(1)).alias("n"))
    conflicts = years.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
        .cast("bigint").alias("permno_year_gvkey_conflict_rows"),
        F.sum(F.col("n") - 1).cast("bigint").alias("permno_year_gvkey_conflicts_resolved"),
    )
    rows = annual.agg(F.count(F.lit(1)).alias("accounting_rows"))
    linked = link_accounting(annual, links).select("gvkey", "characteristic_year").distinct().agg(
        F.count(F.lit(1)).alias("accounting_rows_with_valid_ccm")
    )
    kept = filter_links(links).agg(F.count(F.lit(1)).alias("ccm_rows_retained"))
    seen = links.agg(F.count(F.lit(1)).alias("ccm_rows_input"))
    return side_by_side([rows, linked, seen, kept, pair_counts, conflicts]).withColumn(
        "accounting_rows_unmatched_ccm",
        F.col("accounting_rows") - F.col("accounting_rows_with_valid_ccm"),
    )


def december_market_equity(features: DataFrame) -> DataFrame:
    """December market equity per security and year, in millions."""
    require_columns(features, ["permno", "date", "market_equity"])
    day = month_end("date")
    return features.where(F.month(day) == 12).select(
        "permno",
        F.year(day).alias("december_year"),
        (safe_double("market_equity") / THOUSANDS_PER_MILLION).alias("me_dec_security"),
        day.alias("me_dec_date"),
    )


def annual_book_to_market(linked: DataFrame, features: DataFrame) -> DataFrame:
    """Firm book equity over the summed December equity of all its share classes.

    The firm denominator is NULL when any linked class lacks its December value.
    """
    universe = features.select("permno").distinct()
    rows = (
        linked.join(universe, "permno", "left_semi")
        .withColumn("december_year", F.col("characteristic_year") - 1)
        .join(december_market_equity(features), ["permno", "december_year"], "left")
    )
    firm = ["gvkey", "characteristic_year"]
    with_totals = spread_group_stats(
        stage(rows, "linked_december"), firm,
        F.count("permno").alias("linked_permnos"),
        F.count("me_dec_security").alias("permnos_with_december_me"),
        F.sum("me_dec_security").alias("__total"),
    )
    complete = F.col("permnos_with_december_me") == F.col("linked_permnos")
    return (
        with_totals.withColumn("me_dec", F.when(complete, F.col("__total")))
        .drop("__total")
        .withColumn(
            "book_to_market",
            F.when(
                (F.col("book_equity") > 0) & (F.col("me_dec") > 0),
                ratio("book_equity", "me_dec"),
            ),
        )
    )


_ASSIGNED = (
    "permno", "characteristic_year", "gvkey", "datadate", "fyear", "fyr", "book_equity",
    "accounting_available_from", "me_dec", "book_to_market", "stockholders_equity_source",
    "preferred_stock_source", "deferred_taxes_source", "linkprim", "linktype",
)


def one_assignment_per_security_year(annual_bm: DataFrame) -> DataFrame:
    rows = annual_bm.select(*[c for c in _ASSIGNED if c in annual_bm.columns])
    prim = _prim_rank() if "linkprim" in rows.columns else F.lit(0)
    newest = [F.col("datadate").desc_nulls_last()] if "datadate" in rows.columns else []
    last = [F.col("gvkey").asc()] if "gvkey" in rows.columns else []
    kept = _keep_first(rows, ["permno", "characteristic_year"], [prim, *newest, *last])
    if "datadate" in kept.columns:
        kept = kept.withColumnRenamed("datadate", "accounting_datadate")
    return kept


def assign_monthly(monthly: DataFrame, annual_bm: DataFrame, check: bool = True) -> DataFrame:
    """Attach the annual record in force from June to May; early records raise."""
    rows = monthly.withColumn("date", month_end("date")).withColumn(
        "characteristic_year", characteristic_year("date")
    )
    key = ["permno", "characteristic_year"]
    annual = one_assignment_per_security_year(annual_bm)
    if check:
        # Only records dated after June of their own year can be early; usually there are none.
        june = F.make_date("characteristic_year", F.lit(6), F.lit(30))
        late = annual.where(F.col("accounting_available_from") > june)
        enforce(
            early_accounting(rows.select(*key, "date").join(
                late.select(*key, "accounting_available_from"), key
            )),
            "Accounting data entered before its June date",
        )
    return rows.join(annual, key, "left")


def early_accounting(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("date") < F.col("accounting_available_from"))


def unmatched_firm_years(annual: DataFrame, links: DataFrame) -> DataFrame:
    """Firm-years without any usable link."""
    return annual.select("gvkey", "characteristic_year").join(
        link_accounting(annual, links).select("gvkey", "characteristic_year"),
        ["gvkey", "characteristic_year"],
        "left_anti",
    )


def check_unique_months(df: DataFrame) -> None:
    """At most one row per security and calendar month, whatever the day."""
    months = df.select("permno", month_end("date").alias("date"))
    enforce(duplicate_keys(months, ["permno", "date"]), "Duplicate security-month rows")
