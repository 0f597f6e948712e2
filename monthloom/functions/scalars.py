"""Column helpers used by every operator; all stay inside JVM code generation."""
from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 97.5 % standard normal quantile.
Z_975 = 1.959963984540054


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c: Column | str) -> Column:
    """Numeric coercion: unparsable text and NaN become NULL."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def finite_double(c: Column | str) -> Column:
    """Numeric coercion that also turns infinities into NULL."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def numeric_or_null(df: DataFrame, name: str) -> Column:
    """``safe_double`` of a column that may not exist."""
    return safe_double(name) if name in df.columns else F.lit(None).cast("double")


def is_finite(c: Column | str) -> Column:
    return finite_double(c).isNotNull()


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c).try_cast("date"))


def month_end_shift(c: Column | str, months: int) -> Column:
    """Calendar month end ``months`` away from the month of ``c``."""
    return F.last_day(F.add_months(col(c).try_cast("date"), months))


def month_index(c: Column | str) -> Column:
    """Months since year 0; consecutive calendar months differ by one."""
    d = col(c).try_cast("date")
    return (F.year(d) * 12 + F.month(d)).cast("int")


def is_close(a: Column | str, b: Column | str, rtol: float, atol: float) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division with NULL for a zero denominator."""
    return F.try_divide(col(a), col(b))


def truthy(c: Column | str) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(col(c), F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def code_rank(c: Column | str, ranks: Mapping[str, int], other: int = 9) -> Column:
    """Map short codes to integer priorities."""
    out = F.lit(other)
    for code, rank in reversed(list(ranks.items())):
        out = F.when(col(c) == code, F.lit(rank)).otherwise(out)
    return out


def _log_erfc_over_t(z: float) -> float:
    """``ln(erfc(z) / t) + z**2`` with ``t = 2 / (2 + z)``, also where erfc underflows."""
    t = 2.0 / (2.0 + z)
    if z < 20.0:
        return math.log(math.erfc(z) / t) + z * z
    tail, term = 1.0, 1.0
    for n in range(1, 12):
        term *= -(2 * n - 1) / (2 * z * z)
        tail += term
    return math.log(tail / (z * math.sqrt(math.pi) * t))


@lru_cache(maxsize=1)
def _erfc_coefficients(n: int = 40) -> tuple[float, ...]:
    """Chebyshev coefficients of that smooth function of t over (0, 1]."""
    nodes = [math.cos(math.pi * (k + 0.5) / n) for k in range(n)]
    values = [_log_erfc_over_t(4.0 / (x + 1.0) - 2.0) for x in nodes]
    return tuple(
        2.0 / n * sum(v * math.cos(math.pi * j * (k + 0.5) / n) for k, v in enumerate(values))
        for j in range(n)
    )


def erfc(z: Column) -> Column:
    """Complementary error function of a nonnegative column, by plain column arithmetic.

    The relative error stays near 1e-14 until the value itself leaves double precision.
    """
    t = F.lit(2.0) / (F.lit(2.0) + z)
    # ``transform`` over one element binds a value once, so that the recurrence does not copy it.
    def bound(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def series(y: Column) -> Column:
        state = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("e"))
        c = _erfc_coefficients()
        return F.aggregate(
            F.array(*[F.lit(x) for x in reversed(c[1:])]), state,
            lambda s, x: F.struct((y * s["d"] - s["e"] + x).alias("d"), s["d"].alias("e")),
            lambda s: F.lit(0.5) * (y * s["d"] + F.lit(c[0])) - s["e"],
        )

    return t * F.exp(-z * z + bound(F.lit(4.0) * t - F.lit(2.0), series))


def two_sided_normal_p(t: Column | str) -> Column:
    """``2 * (1 - Phi(|t|))``, without a cut-off in the tail."""
    return erfc(F.abs(col(t)) / F.lit(math.sqrt(2.0)))


def significance_stars(p: Column | str) -> Column:
    p = col(p)
    return (
        F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise(F.lit(""))
    )


def bps_to_rate(bps: float) -> float:
    value = float(bps)
    if not math.isfinite(value) or value < 0:
        raise ValueError("Cost basis points must be finite and nonnegative.")
    return value / 10_000.0


def one_way_cost(gross: Column | str, turnover: Column | str, bps: Column | str | float) -> Column:
    rate = F.lit(bps_to_rate(bps)) if isinstance(bps, (int, float)) else col(bps) / 10_000.0
    return col(gross) - col(turnover) * rate


def characteristic_year(d: Column | str, first_month: int = 6) -> Column:
    """Accounting year in force: June of y through May of y+1 belong to y."""
    d = col(d).try_cast("date")
    return F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1).cast("int")


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation aggregate that yields NULL, not an error, on constants."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xv, yv = F.when(both, x), F.when(both, y)
    varied = (F.min(xv) < F.max(xv)) & (F.min(yv) < F.max(yv))
    return F.when(
        varied, F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))
    )
