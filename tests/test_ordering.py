"""Distributed ranks and quantiles against brute force, with a hot group and hot values."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthloom.operators import ordering
from monthloom.operators.portfolios import assign_deciles, assign_tie_preserving


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    hot = rng.random(n) < 0.6
    pdf = pd.DataFrame({
        "g": np.where(hot, 0, rng.integers(1, 40, n)),
        "v": np.where(rng.random(n) < 0.4, 1.25, rng.normal(size=n)),
        "k": np.arange(n),
    })
    return pdf, spark.createDataFrame(pdf).repartition(13, "k")


def test_exact_rank_and_size(skewed):
    pdf, df = skewed
    got = ordering.ordered_index(df, ["g"], ["v", "k"]).toPandas().sort_values("k")
    want = pdf.sort_values(["g", "v", "k"])
    want["r"] = want.groupby("g").cumcount() + 1
    want = want.sort_values("k")
    assert (got.rank_in_group.to_numpy() == want.r.to_numpy()).all()
    sizes = pdf.groupby("g").size()
    assert (got.group_size.to_numpy() == got.g.map(sizes).to_numpy()).all()


def test_hot_group_spreads_over_tasks(skewed, spark):
    _, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = [F.col("g"), F.col("v"), F.col("k")]
        per_task = df.repartitionByRange(*keys).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in per_task) < 0.5 * 6000


def test_average_ranks(skewed):
    pdf, df = skewed
    got = ordering.average_ranks(df, ["g"], "v").toPandas().sort_values("k")
    want = pdf.groupby("g").v.rank(method="average").to_numpy()
    assert np.allclose(got.avg_rank.to_numpy(), want, atol=0)


def test_quantiles(skewed):
    pdf, df = skewed
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999}
    got = ordering.grouped_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for name, p in probs.items():
        want = pdf.groupby("g").v.quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index(), atol=1e-12)


def test_decile_rules(make):
    schema = "formation_date DATE, model STRING, permno BIGINT, prediction DOUBLE"
    day = "2020-01-31"
    tied = make([(day, "m", i, 0.5) for i in range(20)], schema)
    got = {r.permno: r.decile for r in assign_deciles(tied).collect()}
    assert [got[i] for i in range(20)] == [d for d in range(1, 11) for _ in range(2)]
    nine = make([(day, "m", i, float(i)) for i in range(9)], schema)
    rows = assign_deciles(nine).collect()
    assert {(r.decile, r.decile_status) for r in rows} == {(None, "insufficient_securities")}
    twelve = make([(day, "m", i, float(i)) for i in range(12)], schema)
    got = {r.permno: r.decile for r in assign_deciles(twelve).collect()}
    assert [got[i] for i in range(12)] == [i * 10 // 12 + 1 for i in range(12)]
    part = make([(day, "m", i, None if i == 3 else float(i)) for i in range(12)], schema)
    got = {r.permno: r.decile for r in assign_deciles(part).collect()}
    assert got[3] is None and got[0] == 1 and got[11] == 10
    two = make([(day, "m", i, float(i >= 10)) for i in range(20)], schema)
    got = {r.permno: r.portfolio for r in assign_tie_preserving(two).collect()}
    assert len({got[i] for i in range(10)}) == 1 and len({got[i] for i in range(10, 20)}) == 1
    assert got[0] != got[10]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_value_is_one_row_of_counts(skewed, spark):
    _, df = skewed
    ranks = ordering.value_ranks(df, ["g"], "v")
    assert ranks.count() == df.select("g", "v").distinct().count()
    hot = df.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    row = ranks.where((F.col("g") == hot["g"]) & (F.col("v") == 1.25)).first()
    assert row["group_size"] == hot["n"]


def test_rank_is_null_free_with_signed_zeros(make):
    df = make([(0, 0.0, 1), (0, -0.0, 2), (0, 1.0, 3)], "g INT, v DOUBLE, k INT")
    got = {r.k: r.avg_rank for r in ordering.average_ranks(df, ["g"], "v").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0}


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_quantiles_are_bit_equal_whatever_the_sketch(skewed, accuracy):
    pdf, df = skewed
    probs = {"min": 0.0, "a": 0.013, "b": 0.5, "c": 0.87, "max": 1.0}
    got = ordering.grouped_quantiles(df, ["g"], "v", probs, accuracy).toPandas().set_index("g")
    for g, values in pdf.groupby("g").v:
        x = np.sort(values.to_numpy())
        for name, p in probs.items():
            h = (len(x) - 1) * p
            lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
            assert got.loc[g, name] == lo + (hi - lo) * (h - np.floor(h))


def test_quantiles_sort_only_what_a_bracket_holds(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    quantiles = ordering.grouped_quantiles(df, ["g"], "v", {"p": 0.5}, 1000)
    assert "rangepartitioning" not in _plan(quantiles)
    assert quantiles.count() == 1
    # The window sees one row per value inside the bracket: about four parts in 1000.
    exact = np.quantile([r.v for r in df.collect()], 0.5)
    assert quantiles.first().p == pytest.approx(exact, abs=1e-15)


def test_deciles_keep_all_rows_and_move_none(spark, make):
    schema = "formation_date DATE, model STRING, permno BIGINT, prediction DOUBLE, wide STRING"
    rows = [("2020-01-31", "m", None if i == 5 else i, None if i == 7 else float(i % 3), "x")
            for i in range(25)] + [("2020-02-29", "m", 1, 1.0, "x"), ("2020-02-29", "m", 2, None, "x")]
    got = assign_deciles(make(rows, schema))
    assert got.columns == [*[c.split()[0] for c in schema.split(", ")], "decile", "decile_status"]
    out = got.collect()
    assert len(out) == len(rows)
    ranked = sorted((r.prediction, r.permno) for r in out
                    if r.decile is not None)
    assert len(ranked) == 23
    place = {k: i for i, k in enumerate(ranked)}
    for r in out:
        if r.formation_date.month == 2:
            assert (r.decile, r.decile_status) == (None, "insufficient_securities")
        elif r.permno is None or r.prediction is None:
            assert (r.decile, r.decile_status) == (None, "assigned")
        else:
            assert r.decile == place[r.prediction, r.permno] * 10 // 23 + 1


def test_tie_preserving_rows_are_not_joined_by_value(spark, monkeypatch):
    rows = [("2010-01-31", "m", i, v) for i, v in enumerate(
        [0.0, -0.0, 1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 5.0, 8.0, float("nan"), None])]
    df = spark.createDataFrame(rows, "formation_date string, model string, permno long, "
                               "prediction double")
    out = assign_tie_preserving(df)
    assert {r.permno: r.portfolio for r in out.collect()} == {
        0: 2, 1: 2, 2: 4, 3: 4, 4: 4, 5: 6, 6: 8, 7: 8, 8: 9, 9: 10}
    assert out.columns == ["formation_date", "model", "permno", "prediction", "portfolio"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "prediction" not in joins[0]
