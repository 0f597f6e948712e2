"""Calendar-exact monthly features per security."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import (
    month_end,
    month_end_shift,
    month_index,
    ratio,
    safe_double,
)
from monthloom.operators.contracts import require_columns

_MI = "__mi"


def _calendar_window(first: int, last: int):
    # One security has at most one row per calendar month, so a partition stays short.
    return Window.partitionBy("permno").orderBy(_MI).rangeBetween(first, last)


def calendar_shift(value: str, months: int) -> Column:
    """Value of the row exactly ``months`` calendar months away, else NULL."""
    return F.first(value).over(_calendar_window(months, months))


def momentum_12_2(ret: str = "ret") -> Column:
    """Compounded return over months t-12 to t-2; all eleven must be present."""
    span = _calendar_window(-12, -2)
    return F.when(
        F.count(ret).over(span) == 11, F.product(F.lit(1.0) + F.col(ret)).over(span) - 1.0
    )


def market_equity(prc: str = "prc", shrout: str = "shrout") -> Column:
    return F.abs(safe_double(prc)) * safe_double(shrout)


def log_positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.ln(c))


def with_calendar_index(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn(_MI, month_index(date))


def build_features(prices: DataFrame) -> DataFrame:
    """Size, momentum, next-month target, lagged size and their dates, in one shuffle."""
    require_columns(prices, ["permno", "date", "ret", "prc", "shrout"])
    base = (
        prices.withColumn("date", month_end("date"))
        .withColumn("prc", F.abs(safe_double("prc")))
        .withColumn("shrout", safe_double("shrout"))
        .withColumn("ret", safe_double("ret"))
        .withColumn("market_equity", F.col("prc") * F.col("shrout"))
        .withColumn("log_me", log_positive("market_equity"))
    )
    out = (
        with_calendar_index(base)
        .withColumn("mom_12_2", momentum_12_2())
        .withColumn("next_month_return", calendar_shift("ret", 1))
        .withColumn("me_lag", calendar_shift("market_equity", -1))
        .drop(_MI)
        .withColumn("realized_return_date", month_end_shift("date", 1))
        .withColumn("me_lag_date", month_end_shift("date", -1))
    )
    if "book_equity" in out.columns:
        out = out.withColumn(
            "book_to_market", ratio(safe_double("book_equity"), F.col("market_equity"))
        )
    return out
