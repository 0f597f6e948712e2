"""Exact sums against math.fsum, whatever the partitioning."""
import math
import random

import pytest

from monthloom.operators.exact_sums import exact_sums


def _values(seed):
    rng = random.Random(seed)
    big = [1e16, 1.0, -1e16, 3.0, 1e300, -1e300, 5e-324, 2.2e-308, -0.0, 0.1, 0.2, -0.3]
    out = [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(400)]
    return out + big * 5


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_fsum(spark, parts):
    groups = {1: _values(1), 2: [1e16, 1.0, -1e16] * 50, 3: [0.1] * 1000, None: [2.5, 5e-324],
              5: [1.7e308, 1.7e308, -1.7e308], 6: [-5e-324] * 3}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
    got = {r.g: r.total for r in exact_sums(df, ["g"], "x").collect()}
    assert got == {g: (math.fsum(xs) if g != 5 else 1.7e308) for g, xs in groups.items()}


def test_special_values_nulls_and_no_group(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("c", 1.0), ("d", None),
            ("e", None), ("e", 2.0), ("f", -inf), ("g", 1.7e308), ("g", 1.7e308)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.s for r in exact_sums(df, ["g"], "x", "s").collect()}
    assert got["a"] == inf and got["f"] == -inf and got["g"] == inf
    assert math.isnan(got["b"]) and math.isnan(got["c"])
    assert got["d"] is None and got["e"] == 2.0
    assert exact_sums(df.limit(0), ["g"], "x").count() == 0
    whole = exact_sums(spark.range(10).selectExpr("cast(id as double) as x"), [], "x")
    assert [r.total for r in whole.collect()] == [45.0]
