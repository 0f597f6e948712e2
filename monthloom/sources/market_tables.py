"""Domain tables derived by Spark from the star-schema test tables.

Suppliers play the securities, their shipments the monthly prices, orders the daily
index. Money is summed in whole cents, so that sums do not depend on the order of the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import month_end_shift, month_index
from monthloom.operators.accounting import (
    annual_accounting, annual_book_to_market, link_accounting,
)
from monthloom.operators.costs import (
    apply_cost_scenarios, extreme_portfolio_returns, reconstruct,
)
from monthloom.operators.features import build_features
from monthloom.operators.panel import build_panel, complete_case_sample, finalize_panel
from monthloom.operators.portfolios import (
    assign_from_wide, decile_returns_long, decile_returns_wide,
)
from monthloom.operators.rank_ic import monthly_rank_ic
from monthloom.operators.regimes import (
    attach_three_state, daily_to_monthly, expanding_regimes, label_binary_regime,
)
from monthloom.staging import stage

FIRST_PERMNO = 10_000
# Odd scales keep quotients away from exact decimal halves, where engines round differently.
PRICE_SCALE = 300.007
BOOK_SCALE = 2_000_003.0


def _cents(c: str) -> Column:
    return F.rint(F.col(c) * 100.0).cast("bigint")


def _units(cents: str) -> Column:
    return F.col(cents).cast("double") / 100.0


class MarketTables:
    """Lazy domain tables over one folder; staged ones are written once per instance."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._staged: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = stage(build(), name)
        return self._staged[name]

    # --- prices -----------------------------------------------------------------
    def _lots(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                (F.col("l_suppkey") + FIRST_PERMNO).alias("permno"),
                F.last_day(F.col("l_shipdate").cast("date")).alias("date"),
            )
            .agg(
                F.sum(_cents("l_extendedprice")).alias("val"),
                F.sum(_cents("l_quantity")).alias("qty"),
                F.min(F.col("l_shipdate").cast("date")).alias("caldt"),
            )
        )

    def _prices(self) -> DataFrame:
        base = self._lots().select(
            "permno",
            F.concat(F.lit("T"), F.col("permno").cast("string")).alias("ticker"),
            "caldt",
            "date",
            month_index("date").alias("mi"),
            (_units("val") / _units("qty") / PRICE_SCALE).alias("p"),
            _units("qty").alias("shrout"),
        )
        previous = Window.partitionBy("permno").orderBy("mi").rangeBetween(-1, -1)
        tag = F.col("permno") + F.col("mi")
        ret = F.when(tag % 211 != 0, F.col("p") / F.first("p").over(previous) - 1.0)
        return base.withColumn("ret", ret).withColumn(
            "prc", F.when(tag % 37 == 0, -F.col("p")).otherwise(F.col("p"))
        ).select("permno", "ticker", "caldt", "date", "prc", "shrout", "ret")

    def prices(self) -> DataFrame:
        return self._once("prices", self._prices)

    def security_file(self) -> DataFrame:
        """Monthly file with descriptive codes and mid-month dates."""
        k = F.col("permno") - FIRST_PERMNO
        cap = F.abs("prc") * F.col("shrout")
        return self.prices().select(
            "permno",
            F.col("caldt").alias("mthcaldt"),
            "ticker",
            F.col("ret").alias("mthret"),
            F.col("prc").alias("mthprc"),
            "shrout",
            cap.alias("mthcap"),
            F.lit(None).cast("double").alias("mthprevcap"),
            *self._codes(k),
        )

    @staticmethod
    def _codes(k: Column) -> list[Column]:
        return [
            F.when(k % 4 == 0, "N").when(k % 4 == 1, "A").when(k % 13 == 5, "X")
            .otherwise("Q").alias("primaryexch"),
            F.when(k % 10 == 7, "AD").otherwise("NS").alias("sharetype"),
            F.when(k % 19 == 3, "FUND").otherwise("EQTY").alias("securitytype"),
            F.lit("COM").alias("securitysubtype"),
            F.when(k % 17 == 2, "N").otherwise("Y").alias("usincflg"),
            F.when(k % 3 == 0, "ACOR").otherwise("CORP").alias("issuertype"),
            F.lit("RW").alias("conditionaltype"),
            F.lit("A").alias("tradingstatusflg"),
        ]

    def security_info(self) -> DataFrame:
        """Two validity intervals per security; the class changes in some of them."""
        k = F.col("s_suppkey")
        part = F.explode(F.array(F.lit(0), F.lit(1)))
        rows = self.raw("supplier").select("s_suppkey", part.alias("part"))
        shifted = k + F.col("part") * 7
        return rows.select(
            (k + FIRST_PERMNO).alias("permno"),
            F.when(F.col("part") == 0, F.lit("1990-01-01")).otherwise(F.lit("1998-07-01"))
            .cast("date").alias("secinfostartdt"),
            F.when(F.col("part") == 0, F.lit("1998-06-30")).otherwise(F.lit("2099-12-31"))
            .cast("date").alias("secinfoenddt"),
            F.concat(F.lit("T"), (k + FIRST_PERMNO).cast("string"),
                     F.when(F.col("part") == 0, "A").otherwise("B")).alias("ticker"),
            *self._codes(shifted),
        )

    def names_history(self) -> DataFrame:
        k = F.col("s_suppkey")
        part = F.explode(F.array(F.lit(0), F.lit(1)))
        return self.raw("supplier").select("s_suppkey", part.alias("part")).select(
            (k + FIRST_PERMNO).alias("permno"),
            F.when(F.col("part") == 0, F.lit("1990-01-01")).otherwise(F.lit("1998-07-01"))
            .cast("date").alias("namedt"),
            F.when(F.col("part") == 0, F.lit("1998-06-30")).otherwise(F.lit("2099-12-31"))
            .cast("date").alias("nameendt"),
            F.concat(F.lit("L"), (k + FIRST_PERMNO).cast("string")).alias("ticker"),
            (F.lit(10) + (k + F.col("part")) % 3).cast("int").alias("shrcd"),
            (F.lit(1) + k % 4).cast("int").alias("exchcd"),
        )

    # --- index ------------------------------------------------------------------
    def index_daily(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.sum(_cents("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))
            .select("date", (_units("total") / F.col("n") / 10000.0).alias("vix"))
        )

    def index_text(self) -> DataFrame:
        """The daily index as text columns, with some unreadable values."""
        bad = F.dayofmonth("date") == 13
        return self.index_daily().select(
            F.date_format("date", "MM/dd/yyyy").alias(" DATE"),
            F.when(bad, "n/a").otherwise(F.col("vix").cast("string")).alias("Close"),
        )

    def index_monthly(self) -> DataFrame:
        return daily_to_monthly(self.index_daily())

    def regimes(self) -> DataFrame:
        return self._once("regimes", lambda: label_binary_regime(self.index_monthly()))

    def three_regimes(self) -> DataFrame:
        return self._once("three_regimes", lambda: expanding_regimes(self.index_monthly()))

    # --- accounting -------------------------------------------------------------
    def fundamentals_file(self) -> DataFrame:
        price = _cents("l_extendedprice")

        def part(condition: Column) -> Column:
            return F.sum(F.when(condition, price).otherwise(F.lit(0)))

        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        yearly = (
            self.raw("lineitem")
            .groupBy(
                F.floor(F.col("l_suppkey") / 2).cast("bigint").alias("k"),
                F.year("l_shipdate").alias("y"),
            )
            .agg(
                part(flag == "A").alias("sa"), part(flag == "N").alias("sn"),
                part(flag == "R").alias("sr"), part(status == "F").alias("sf"),
                part(status == "O").alias("so"), F.sum(price).alias("tot"),
            )
        )
        s = {c: _units(c) / BOOK_SCALE for c in ("sa", "sn", "sr", "sf", "so", "tot")}
        t = F.col("k") + F.col("y")

        def keep(condition: Column, value: Column) -> Column:
            return F.when(condition, value)

        copies = yearly.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where(
            (F.col("copy") == 0) | (t % 11 == 0)
        )
        sign = F.when(F.col("k") % 23 == 5, -1.0).otherwise(1.0)
        shrink = F.when(F.col("copy") == 1, 0.9).otherwise(1.0)
        return copies.select(
            F.lpad(F.col("k").cast("string"), 6, "0").alias("gvkey"),
            F.when(F.col("copy") == 1, F.make_date("y", F.lit(6), F.lit(30)))
            .when(F.col("k") % 5 == 0, F.make_date("y", F.lit(9), F.lit(30)))
            .otherwise(F.make_date("y", F.lit(12), F.lit(31))).alias("datadate"),
            F.col("y").cast("int").alias("fyear"),
            F.when(F.col("copy") == 1, 6).when(F.col("k") % 5 == 0, 9).otherwise(12)
            .cast("int").alias("fyr"),
            keep(t % 3 != 0, s["sa"] * sign * shrink).alias("seq"),
            keep(t % 5 != 0, s["sn"]).alias("ceq"),
            keep(t % 7 != 0, s["tot"]).alias("at"),
            keep(t % 7 != 3, s["sf"]).alias("lt"),
            keep(t % 2 != 0, s["so"] / 20.0).alias("txditc"),
            keep(t % 6 != 0, s["so"] / 40.0).alias("txdb"),
            keep(t % 8 >= 6, s["sf"] / 50.0).alias("itcb"),
            keep(t % 3 != 1, s["sr"] / 12.0).alias("pstkrv"),
            keep(t % 9 >= 4, s["sr"] / 11.0).alias("pstkl"),
            keep(t % 4 != 0, s["sr"] / 10.0).alias("pstk"),
            F.when((F.col("copy") == 1) & (F.col("k") % 2 == 1), "FS").otherwise("INDL")
            .alias("indfmt"),
            F.lit("STD").alias("datafmt"),
            F.lit("D").alias("popsrc"),
            F.lit("C").alias("consol"),
            F.when(F.col("k") % 17 == 16, "CAD").otherwise("USD").alias("curcd"),
        )

    def fundamentals(self) -> DataFrame:
        from monthloom.sources.scans import fundamentals

        return self._once(
            "fundamentals",
            lambda: fundamentals(self.fundamentals_file(), "1990-01-01", "2010-12-31"),
        )

    def links(self) -> DataFrame:
        """Link history with unusable codes, closed intervals, duplicates and conflicts."""
        s = F.col("s_suppkey")
        rows = self.raw("supplier").select(
            "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part")
        ).where(
            (F.col("part") == 0) | ((F.col("part") == 1) & (s % 6 == 0))
            | ((F.col("part") == 2) & (s % 9 == 0))
        )
        part = F.col("part")
        firm = F.floor(s / 2).cast("bigint") + F.when(part == 2, 1).otherwise(0)
        return rows.select(
            F.lpad(firm.cast("string"), 6, "0").alias("gvkey"),
            (s + FIRST_PERMNO).alias("lpermno"),
            F.when(part == 1, "LU").when(part == 2, "LC").when(s % 7 == 0, "LU")
            .when(s % 7 == 3, "LD").when(s % 7 == 5, "lc").otherwise("LC").alias("linktype"),
            F.when(part == 1, "C").when(part == 2, "P").when(s % 11 == 10, "J")
            .when(s % 5 == 4, "c").otherwise("P").alias("linkprim"),
            F.when(part == 2, F.lit("1998-01-01")).when(s % 3 == 0, F.lit(None))
            .otherwise(F.lit("1992-01-01")).cast("date").alias("linkdt"),
            F.when((part == 0) & (s % 8 == 1), F.lit("1999-06-30")).cast("date")
            .alias("linkenddt"),
        )

    # --- panel and predictions ---------------------------------------------------
    def features(self) -> DataFrame:
        return self._once("features", lambda: build_features(self.prices().drop("caldt")))

    def annual(self) -> DataFrame:
        return self._once("annual", lambda: annual_accounting(self.fundamentals()))

    def linked(self) -> DataFrame:
        return self._once("linked", lambda: link_accounting(self.annual(), self.links()))

    def annual_bm(self) -> DataFrame:
        return self._once(
            "annual_bm", lambda: annual_book_to_market(self.linked(), self.features())
        )

    def _panel(self) -> DataFrame:
        panel = build_panel(
            self.prices().drop("caldt"), self.fundamentals(), self.links(), self.regimes()
        )
        return finalize_panel(panel)

    def panel(self) -> DataFrame:
        return self._once("panel", self._panel)

    def sample(self) -> DataFrame:
        return self._once("sample", lambda: complete_case_sample(self.panel()))

    def _wide_predictions(self) -> DataFrame:
        """Scores of two made-up models; the second one is a step function with many ties."""
        f = self.features().join(self.regimes(), "date")
        rows = f.where(
            F.col("mom_12_2").isNotNull() & F.col("log_me").isNotNull()
            & F.col("me_lag").isNotNull() & F.col("next_month_return").isNotNull()
        )
        smooth = F.lit(0.02) - F.col("log_me") * 0.001 + F.col("mom_12_2") * 0.01
        steps = F.floor(F.col("mom_12_2") * 20.0).cast("double") / 1000.0 + F.when(
            F.col("log_me") > 7.0, 0.0
        ).otherwise(0.0005)
        return rows.select(
            "date",
            F.col("date").alias("formation_date"),
            "realized_return_date",
            "permno",
            "ticker",
            "regime",
            "vix",
            F.col("next_month_return").alias("actual_next_month_return"),
            "me_lag",
            "me_lag_date",
            F.round(smooth, 10).alias("elastic_net_prediction"),
            F.round(steps, 10).alias("xgboost_prediction"),
            F.lit(0.01).alias("benchmark_prediction"),
            month_end_shift("date", -1).alias("train_feature_end_date"),
            F.col("date").alias("train_target_end_date"),
        )

    def predictions(self) -> DataFrame:
        return self._once("predictions", self._wide_predictions)

    def predictions_long(self) -> DataFrame:
        from monthloom.operators.reshape import models_to_rows

        return models_to_rows(self.predictions())

    def three_state_predictions(self) -> DataFrame:
        if "three_state" not in self._staged:
            self._staged["three_state"] = attach_three_state(
                self.predictions(), self.three_regimes()
            )
        return self._staged["three_state"]

    def assignments(self) -> DataFrame:
        return self._once(
            "assignments", lambda: assign_from_wide(self.three_state_predictions())
        )

    def deciles_long(self) -> DataFrame:
        return self._once("deciles_long", lambda: decile_returns_long(self.assignments()))

    def deciles_wide(self) -> DataFrame:
        return self._once("deciles_wide", lambda: decile_returns_wide(self.deciles_long()))

    def monthly_ic(self) -> DataFrame:
        return self._once("monthly_ic", lambda: monthly_rank_ic(self.three_state_predictions()))

    def reconstruction(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if "reconstruction" not in self._staged:
            parts = reconstruct(self.assignments())
            names = ("reconstruction", "turnover_by_decile", "weight_audit")
            self._staged.update({n: stage(d, n) for n, d in zip(names, parts, strict=True)})
        return tuple(self._staged[n] for n in (
            "reconstruction", "turnover_by_decile", "weight_audit"))

    def net_returns(self) -> DataFrame:
        return self._once("net_returns", lambda: apply_cost_scenarios(self.reconstruction()[0]))

    def extreme_portfolios(self) -> DataFrame:
        return self._once(
            "extreme_portfolios", lambda: extreme_portfolio_returns(self.predictions())
        )
