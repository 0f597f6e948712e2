"""Whitening against a dense eigendecomposition, and odd rows."""
import numpy as np
import pytest

import __spark_entry__ as entry
from monthloom.llm.whitening import largest_pairs, minres, whiten
from tests.conftest import MEDIUM, SMALL


def dense(vectors, k):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    z = ((x * n - sums) / n) @ axes[:, :k] / np.sqrt(values[:k])
    return n, ((x * n - sums) ** 2).sum(axis=1), np.abs(z), values[:k] / values.sum()


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query_equals_a_dense_decomposition(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = entry.queries()["op13_whitening"](spark, folder).toPandas()
    n, deviation, z, share = dense(np.vstack(rows["embedding"]), 16)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]]
    assert np.abs(np.abs(wide.to_numpy()) - z).max() < 1e-9
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1
    assert 0 <= got["identity_error"][0] < 1e-12
    first = got[got["component"] == 1].set_index("vec_id").loc[rows["vec_id"]]
    assert (first["deviation"].to_numpy() == deviation).all()
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-12)


@pytest.mark.parametrize(("dim", "wanted"), [(1, 1), (6, 6), (40, 16), (200, 12)])
def test_solver_reaches_double_precision(dim, wanted):
    rng = np.random.default_rng(dim)
    q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    spectrum = np.sort(rng.exponential(size=dim))[::-1] * 1000
    a = (q * spectrum) @ q.T
    values, axes = largest_pairs(lambda b: a @ b, dim, wanted)
    assert np.allclose(values, spectrum[:wanted], rtol=1e-12)
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-13 * spectrum[0]


def test_solver_with_repeated_eigenvalues():
    a = np.diag([5.0] * 7 + [1.0] * 53)
    values, axes = largest_pairs(lambda b: a @ b, 60, 10)
    assert np.allclose(values, [5] * 7 + [1] * 3)
    assert np.allclose(axes.T @ axes, np.eye(10), atol=1e-12)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = np.diag(np.array([-3.0, -1, 2, 5, 9]))
    b = rng.normal(size=(5, 3))
    assert np.allclose(a @ minres(lambda v: a @ v, b, 6), b)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(30, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (5, good[1]), (5, good[1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]),
           (94, [float("inf"), 1.0, 2.0]), (95, [1.0, 2.0])]
    table = spark.createDataFrame([(k, v, 1, 0.5) for k, v in rows + bad],
                                  "vec_id long, embedding array<double>, component int, n double")
    got = whiten(table.repartition(4)).toPandas()
    n, deviation, z, _ = dense([v for _, v in rows], 3)
    assert n == 30 and len(got) == 3 * len(rows)
    assert set(got["vec_id"].dropna()) == set(range(30)) and got["vec_id"].isna().sum() == 3
    ours = got[got["vec_id"] == 7].sort_values("component")
    assert np.allclose(np.abs(ours["whitened"]), z[7], atol=1e-12)
    assert (ours["deviation"] == deviation[7]).all()


def test_little_to_fit(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whiten(one).count() == 0 and whiten(one.limit(0)).count() == 0
    # One direction without variance, one distinct pair: a single component.
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert [(r.component, round(abs(r.whitened), 12)) for r in two] == [(1, 1.0)] * 2
    huge = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>"))
    assert [r.deviation for r in huge.collect()] == [None, None]
