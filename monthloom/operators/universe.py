"""Security universes: predicates, top-N membership and samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import month_end, safe_double
from monthloom.operators.contracts import ContractViolation
from monthloom.operators.ordering import ordered_index
from monthloom.schema import FORMATION
from monthloom.staging import stage

# Codes of the common-stock universe.
COMMON_STOCK = {
    "sharetype": ("NS",),
    "securitytype": ("EQTY",),
    "securitysubtype": ("COM",),
    "usincflg": ("Y",),
    "issuertype": ("ACOR", "CORP"),
    "primaryexch": ("N", "A", "Q"),
    "conditionaltype": ("RW",),
    "tradingstatusflg": ("A",),
}


def common_stock() -> Column:
    """Eight conjuncts, each of which reaches the scan as a pushed filter."""
    out = F.lit(True)
    for name, codes in COMMON_STOCK.items():
        out = out & (F.col(name).isin(*codes) if len(codes) > 1 else F.col(name) == codes[0])
    return out


def legacy_common_stock() -> Column:
    return F.col("shrcd").isin(10, 11) & F.col("exchcd").isin(1, 2, 3)


def top_by_market_equity(
    monthly: DataFrame, formation_date: str, top_n: int, strict: bool = True
) -> DataFrame:
    """The N largest securities of one month; a distributed top-k, ties by security id."""
    if top_n < 1:
        raise ValueError("top_n must be positive.")
    me = safe_double("market_equity")
    month = F.last_day(F.lit(formation_date).cast("date"))
    picked = stage(
        monthly.where((month_end("date") == month) & (me > 0) & F.col("permno").isNotNull())
        .select("permno", me.alias("market_equity"))
        .orderBy(F.col("market_equity").desc(), F.col("permno").asc())
        .limit(top_n)
        .select("permno"),
        "universe",
    )
    if strict:
        n = picked.count()
        if n < top_n:
            raise ContractViolation(f"Only {n} valid securities for a top-{top_n} universe")
    return picked


def restrict_to_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    return rows.join(universe.select("permno"), "permno", "left_semi")


def top_n_or_named(
    monthly: DataFrame, formation_date: str, top_n: int, ticker: str | None,
    min_price: float | None = None, order: str = "market_equity",
) -> DataFrame:
    """History of the top-N of a formation month plus, optionally, one named security."""
    month = F.last_day(F.lit(formation_date).cast("date"))
    at = monthly.where(F.col("date") == month)
    if min_price is not None:
        at = at.where(F.abs("prc") >= float(min_price))
    picked = (
        at.orderBy(F.col(order).desc_nulls_last(), F.col("permno").asc())
        .limit(int(top_n))
        .select("permno")
    )
    chosen = monthly.join(picked, "permno", "left_semi")
    if ticker is None:
        return chosen
    named = monthly.where(F.upper("ticker") == ticker.upper())
    return chosen.unionByName(named.join(picked, "permno", "left_anti"))


def monthly_hash_sample(
    rows: DataFrame, max_rows_per_month: int | None, seed: int, date: str = FORMATION
) -> DataFrame:
    """At most k rows per month, those with the least md5 of ``permno|month|seed``.

    The same rows come in every run with the same seed, and SQL can repeat the draw. Up to Spark's
    own bound for top-k windows, each task sends at most k rows per month; beyond it the digests
    are placed by range. Equal digests, that is repeated (permno, month) keys, are drawn by permno
    alone, so which of them comes first is open. Rows without a month form a group of their own. A
    missing k draws every row.
    """
    if not max_rows_per_month or max_rows_per_month <= 0:
        return rows
    drawn = rows.withColumn("__draw", F.md5(F.concat_ws(
        "|", F.col("permno").cast("string"), F.col(date).cast("string"), F.lit(str(seed)))))
    order = ["__draw", "permno"]
    bound = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if max_rows_per_month <= bound:
        window = Window.partitionBy(date).orderBy(*order)
        placed = drawn.withColumn("__n", F.row_number().over(window))
    else:
        month = F.coalesce(F.col(date).cast("string"), F.lit(""))
        placed = ordered_index(
            drawn.withColumn("__month", month), ["__month"], order, "__n", "__size"
        ).drop("__month", "__size")
    return placed.where(F.col("__n") <= max_rows_per_month).drop("__draw", "__n")
