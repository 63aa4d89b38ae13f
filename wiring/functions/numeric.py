"""Number policy: missing is NULL, ratios never raise, and each convention for a zero denominator has a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, NULL where ``d`` is zero or anything is missing."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def ratio_or_zero(n: Column, d: Column) -> Column:
    """Zero where ``n`` is zero, whatever ``d``."""
    return F.when(n == 0, F.lit(0.0)).otherwise(ratio(n, d))


def ieee_ratio(n: Column, d: Column) -> Column:
    """``n / d`` as floating point has it: signed infinity for ``n / 0``, NaN for ``0 / 0``."""
    n, d = n.cast("double"), d.cast("double")
    return F.when(d != 0, F.try_divide(n, d)).when(n == 0, F.lit(NAN)).otherwise(F.signum(n) * F.lit(INF))


def known(c: Column) -> Column:
    """NaN made NULL."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Whether a number is neither missing nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def differs(c: Column, value) -> Column:
    """``c <> value`` that keeps missing values."""
    return ~c.eqNullSafe(F.lit(value))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over pairs without missing values; NULL for a constant side instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def numbers_in(text: Column) -> Column:
    """Every signed decimal in a string, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda s: s.cast("double"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
