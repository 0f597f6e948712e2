"""Elastic net for many training windows at once.

A linear fit needs only moments. One aggregate per month gives them, centred; adding up
months gives every expanding window. Every fit proves its convergence by its duality gap. Rows are read once, however many windows and
parameter sets are fitted; only month-level rows reach the Python solver.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions.scalars import month_index, safe_double
from monthloom.operators.contracts import enforce, incomplete_model_inputs
from monthloom.operators.splits import forward_folds
from monthloom.schema import FEATURES, FORMATION, TARGET
from monthloom.shipping import ship_package
from monthloom.staging import stage


def _moment_names(features: Sequence[str]) -> list[str]:
    k = len(features)
    return ["n", "sy", "syy", *[f"s{c}{i}" for i in range(k) for c in ("x", "xy")],
            *[f"sxx{i}_{j}" for i in range(k) for j in range(i, k)]]


def monthly_moments(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Sums, squares and cross products of features and target per formation month, each less the
    first month's mean, which is in the columns ``ry`` and ``rx0``, ``rx1``, ...

    Spark merges (count, means, centred products) of partitions pairwise, so nothing is lost where
    a mean is large beside the spread; moving the centre to one point lets months be added up.
    """
    values = {"y": safe_double(TARGET), **{f"x{i}": safe_double(f) for i, f in enumerate(features)}}
    names = list(values)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    centred = stage(
        rows.select(FORMATION, *[c.alias(n) for n, c in values.items()]).groupBy(FORMATION).agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.avg(n).alias(f"m{n}") for n in names],
            *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs]), "centred-moments")
    first = centred.orderBy(FORMATION).first()
    centre = {n: float((first[f"m{n}"] if first else None) or 0.0) for n in names}
    off = {n: F.col(f"m{n}") - F.lit(centre[n]) for n in names}

    def product(a: str, b: str) -> Column:
        return F.col("n") * (F.col(f"c{a}{b}") + off[a] * off[b])

    k = range(len(features))
    return centred.select(
        FORMATION, "n", (F.col("n") * off["y"]).alias("sy"), product("y", "y").alias("syy"),
        *[(F.col("n") * off[f"x{i}"]).alias(f"sx{i}") for i in k],
        *[product("y", f"x{i}").alias(f"sxy{i}") for i in k],
        *[product(f"x{i}", f"x{j}").alias(f"sxx{i}_{j}") for i in k for j in k if i <= j],
        *[F.lit(centre[n]).alias(f"r{n}") for n in names],
    )


def expanding_moments(monthly: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Moments of all months before each month, whose targets are realised by then."""
    before = Window.orderBy("__mi").rangeBetween(Window.unboundedPreceding, -1)
    names = _moment_names(features)
    centre = ["ry", *[f"rx{i}" for i in range(len(features))]]
    return monthly.withColumn("__mi", month_index(FORMATION)).select(
        FORMATION,
        F.count(F.lit(1)).over(before).alias("train_months"),
        F.max(FORMATION).over(before).alias("train_formation_end_date"),
        *[F.sum(n).over(before).alias(n) for n in names], *centre,
    )


def _arrays(row, k: int) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, float]:
    sxx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            sxx[i, j] = sxx[j, i] = getattr(row, f"sxx{i}_{j}")
    sx = np.array([getattr(row, f"sx{i}") for i in range(k)])
    sxy = np.array([getattr(row, f"sxy{i}") for i in range(k)])
    return row.n, sx, sxx, row.sy, sxy, row.syy


class Unconverged(RuntimeError):
    """An elastic net whose duality gap proves that its objective can still fall."""


def duality_gap(gram, target, yy, w, alpha, l1_ratio) -> float:
    """How far the objective at ``w`` may lie above its least value, from moments alone.

    Without an L1 part the gradient bounds it instead, by the curvature of the L2 part or, without
    that either, by the length of the coefficients.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    slope = target - gram @ w - l2 * w
    if l1 == 0:
        size = float(np.linalg.norm(slope))
        return size * size / (2 * l2) if l2 > 0 else size * float(np.linalg.norm(w))
    residual = max(float(yy - 2 * w @ target + w @ gram @ w), 0.0)
    largest = float(np.abs(slope).max(initial=0.0))
    shrink = l1 / largest if largest > l1 else 1.0
    return float(residual * (1 + shrink * shrink) / 2 + l1 * np.abs(w).sum()
                 - shrink * (yy - w @ target) + l2 * (1 + shrink * shrink) / 2 * (w @ w))


def solve_moments(n, sx, sxx, sy, sxy, alpha, l1_ratio, syy=None, max_iter=20_000, tol=1e-13,
                  most_gap=1e-9):
    """Coordinate descent for the penalised fit on standardised features.

    Minimises mean squared error / 2 + alpha * (l1_ratio * |w| + (1 - l1_ratio) * w^2 / 2).
    Returns the intercept, the raw and the standardised coefficients. With ``syy`` the duality gap
    must end below ``most_gap`` of the target's variance, else ``Unconverged`` is raised.
    """
    mean, ybar = sx / n, sy / n
    scale = np.sqrt(np.maximum(np.diag(sxx) / n - mean**2, 0.0))
    scale[scale == 0.0] = 1.0
    gram = (sxx / n - np.outer(mean, mean)) / np.outer(scale, scale)
    target = (sxy / n - mean * ybar) / scale
    w = np.zeros(len(sx))
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(w)):
            pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
            size = gram[j, j] + alpha * (1.0 - l1_ratio)
            new = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / size if size > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    if syy is not None:
        yy = max(syy / n - ybar * ybar, 0.0)
        gap = duality_gap(gram, target, yy, w, alpha, l1_ratio)
        if gap > most_gap * yy + 1e-300:
            raise Unconverged(f"The duality gap is still {gap:.3g} of a variance of {yy:.3g}.")
    raw = w / scale
    return ybar - mean @ raw, raw, w


def _coefficient_schema(k: int) -> str:
    return ", ".join(
        ["intercept DOUBLE", *[f"raw{i} DOUBLE" for i in range(k)],
         *[f"std{i} DOUBLE" for i in range(k)]]
    )


def fit_windows(
    windows: DataFrame, alpha: float, l1_ratio: float, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Coefficients per window; the input has one row of moments per month."""
    k = len(features)
    keep = [FORMATION, "train_months", "train_formation_end_date", "n"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                n, sx, sxx, sy, sxy, syy = _arrays(row, k)
                b0, raw, std = solve_moments(n, sx, sxx, sy, sxy, alpha, l1_ratio, syy)
                centre = np.array([getattr(row, f"rx{i}") for i in range(k)])
                rows.append([row.ry + b0 - centre @ raw, *raw, *std])
            names = ["intercept", *[f"raw{i}" for i in range(k)], *[f"std{i}" for i in range(k)]]
            fitted = pd.DataFrame(rows, columns=names, dtype=float)
            yield pd.concat([batch[keep].reset_index(drop=True), fitted], axis=1)

    schema = (f"{FORMATION} DATE, train_months BIGINT, train_formation_end_date DATE, n DOUBLE, "
              + _coefficient_schema(k))
    ship_package(windows.sparkSession)
    return windows.where(F.col("n") > 0).mapInPandas(solve, schema)


def linear_score(features: Sequence[str] = FEATURES) -> Column:
    """Prediction column for rows joined with fitted coefficients."""
    out = F.col("intercept")
    for i, f in enumerate(features):
        out = out + F.col(f"raw{i}") * F.col(f)
    return out


def coefficient_rows(fits: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Standardised coefficients in long form."""
    cells = [
        F.struct(F.lit(f).alias("predictor"),
                 F.col(f"std{i}").alias("standardized_coefficient"))
        for i, f in enumerate(features)
    ]
    return fits.select(
        F.col(FORMATION).alias("refit_date"), F.lit("elastic_net").alias("model"),
        F.explode(F.array(*cells)).alias("__c"),
    ).select("refit_date", "model", "__c.predictor", "__c.standardized_coefficient")


def tune(
    rows: DataFrame, alphas: Sequence[float], l1_ratios: Sequence[float], n_splits: int = 5,
    min_train_months: int = 12, features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Mean validation error of every parameter pair over forward-chaining folds.

    The error of a linear model on a month is a quadratic form in that month's
    moments, so the whole grid is scored from one pass over the rows.
    """
    enforce(incomplete_model_inputs(rows), "Tuning needs complete rows")
    k = len(features)
    monthly = stage(monthly_moments(rows, features), "moments")
    folds = forward_folds(rows, n_splits, min_train_months)
    train = expanding_moments(monthly, features)
    names = _moment_names(features)
    valid = monthly.select(FORMATION, *[F.col(c).alias(f"v_{c}") for c in names])
    grid = F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(r)).alias("l1_ratio"))
        for a in alphas for r in l1_ratios
    ])
    cells = (
        folds.withColumnRenamed("validation_month", FORMATION)
        .drop("train_months")
        .join(train, FORMATION)
        .join(valid, FORMATION)
        .where(F.col("n") > 0)
        .withColumn("__g", F.explode(grid))
        .select("*", "__g.alpha", "__g.l1_ratio")
        .drop("__g")
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, sx, sxx, sy, sxy, syy = _arrays(row, k)
                b0, b, _ = solve_moments(n, sx, sxx, sy, sxy, row.alpha, row.l1_ratio, syy)
                held = pd.Series(row._asdict()).filter(like="v_").rename(lambda c: c[2:])
                vn, vx, vxx, vy, vxy, vyy = _arrays(held, k)
                sse = (vyy - 2 * b0 * vy - 2 * b @ vxy + vn * b0**2 + 2 * b0 * (b @ vx)
                       + b @ vxx @ b)
                out.append((row.fold, row.alpha, row.l1_ratio, sse / vn))
            yield pd.DataFrame(out, columns=["fold", "alpha", "l1_ratio", "mse"])

    ship_package(cells.sparkSession)
    scored = cells.mapInPandas(score, "fold INT, alpha DOUBLE, l1_ratio DOUBLE, mse DOUBLE")
    table = stage(
        scored.groupBy("alpha", "l1_ratio").agg(
            F.avg("mse").alias("mean_cv_mse"), F.count(F.lit(1)).alias("n_folds")
        ),
        "tuning",
    )
    best = Window.partitionBy(F.lit(1)).orderBy("mean_cv_mse", "alpha", "l1_ratio")
    return table.select(
        F.lit("elastic_net").alias("model"), "alpha", "l1_ratio",
        F.to_json(F.struct("alpha", "l1_ratio")).alias("params"), "mean_cv_mse", "n_folds",
        (F.row_number().over(best) == 1).alias("selected"),
    )
