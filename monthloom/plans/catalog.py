"""Registry of queries: a name, an output layout and a function of the market tables.

The layout lists the output columns with a kind: ``d`` date (as ISO text), ``i`` 64-bit
integer, ``b`` boolean, a number for doubles rounded to that many places, none for text.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.sources.market_tables import MarketTables

Build = Callable[[MarketTables], DataFrame]
LAYOUTS: dict[str, str] = {}
BUILDERS: dict[str, Build] = {}
_tables: dict[tuple[str, str], MarketTables] = {}


def query(name: str, layout: str) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        LAYOUTS[name] = layout
        BUILDERS[name] = build
        return build

    return register


def fields(layout: str) -> list[tuple[str, str]]:
    out = []
    for item in layout.split():
        name, _, kind = item.partition(":")
        out.append((name, kind))
    return out


def _shaped(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("boolean")
    elif kind:
        c = F.round(c.cast("double"), int(kind))
    else:
        c = c.cast("string")
    return c.alias(name)


def shape(df: DataFrame, layout: str) -> DataFrame:
    return df.select(*[_shaped(n, k) for n, k in fields(layout)])


def market_tables(spark: SparkSession, folder: str) -> MarketTables:
    """Tables of one folder, staged at most once per application."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _tables:
        _tables[key] = MarketTables(spark, folder)
    return _tables[key]


def forget_tables() -> None:
    """Make the next query derive its tables again."""
    _tables.clear()


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return shape(BUILDERS[name](market_tables(spark, folder)), LAYOUTS[name])


def load() -> None:
    """Import the modules that register queries."""
    from monthloom.plans import (  # noqa: F401
        queries_data, queries_models, queries_panel, queries_portfolio, queries_reports,
    )
