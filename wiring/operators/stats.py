"""Correlations, lines, curves and box statistics as single aggregations.

Defined results: a pair with a missing value takes no part (lines and densities leave out infinite ones too); a constant
side has no correlation, fewer than three pairs no p; equal values share their average rank; quantiles
are linear between neighbours; a key that is missing has no box, flier or density; empty tables give empty tables, or one row
of NULLs where a single row is asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiring.functions.numeric import correlation, finite, stars
from wiring.functions.ranges import running


_STEPS = 120  # of the continued fraction; 70 are enough for any count of rows
_SHIFT = 30


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, each step one turn of ``aggregate``."""

    def turn(held: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i % 2 == 1, odd).otherwise(even)
        d, c = 1 / (1 + term * held["d"]), 1 + term / held["c"]
        return F.named_struct(F.lit("d"), d, F.lit("c"), c, F.lit("h"), held["h"] * d * c)

    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.named_struct(F.lit("d"), first, F.lit("c"), F.lit(1.0), F.lit("h"), first)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, turn, lambda held: held["h"])


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series at ``a`` plus ``_SHIFT``, carried back by the recurrence."""
    z = a + _SHIFT
    series = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), series, lambda v, k: v * (a + k) / (a + k + 0.5))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r over ``n`` pairs, by the incomplete beta function at 1 - r²; all in expressions.

    NULL below three pairs and without r; 0 for an r of 1 or -1 and beyond (rounding).
    """
    r, a, half = r.cast("double"), (n.cast("double") - 2) / 2, F.lit(0.5)
    x = 1 - r * r
    front = F.exp(a * F.log1p(-r * r)) * F.abs(r) * _gamma_ratio(a) / math.sqrt(math.pi)
    tail = F.when(x < (a + 1) / (a + 2.5), front / a * _fraction(a, half, x)).otherwise(1 - front / half * _fraction(half, a, r * r))
    return F.when((n < 3) | r.isNull() | F.isnan(r), None).when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).otherwise(F.greatest(tail, F.lit(0.0)))


def regression(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), with_p: bool = False) -> DataFrame:
    """Count, r, slope, intercept, R² and the ends of the fitted line over finite pairs."""
    rows = df.where(finite(F.col(x)) & finite(F.col(y)))
    a, b = F.col(x), F.col(y)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(a, b).alias("r"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
                                  F.regr_r2(b, a).alias("r2"), F.min(a).alias("x_min"), F.max(a).alias("x_max"))
    out = out.withColumns({"y_min": F.col("slope") * F.col("x_min") + F.col("intercept"), "y_max": F.col("slope") * F.col("x_max") + F.col("intercept")})
    return out.withColumn("p", p_value(F.col("r"), F.col("n"))).withColumn("stars", stars(F.col("p"))) if with_p else out


def log_curve(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``y = a ln(x + 1) + b`` in closed form, for x above zero."""
    rows = df.dropna(subset=[x, y]).where(F.col(x) > 0)
    lx, b = F.log1p(F.col(x).cast("double")), F.col(y)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(b, lx).alias("a"), F.regr_intercept(b, lx).alias("b"), F.regr_r2(b, lx).alias("r2"))


def ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks by value: distinct values are counted, then summed by range, so no task sorts all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col(column).isNotNull())
    placed = running(counts, column, "__n", name="__before").select(column, (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(placed, column, "left")


def spearman(df: DataFrame, x: str, y: str, with_p: bool = False) -> DataFrame:
    """Number of complete pairs, the correlation of their average ranks and, if asked for, its two-sided p and stars."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = ranks(ranks(rows, x, "__rx"), y, "__ry")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__rx"), F.col("__ry")).alias("rho"))
    return out.withColumn("p", p_value(F.col("rho"), F.col("n"))).withColumn("stars", stars(F.col("p"))) if with_p else out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair of columns, the second before the first, in one aggregation; pairwise complete."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[:k]]
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("c")).select("c.*")


def correlations_with(df: DataFrame, target: str, columns: list[str], with_p: bool = False) -> DataFrame:
    """Each column's correlation with the target, in one aggregation; with its number of pairs, p and stars if asked for."""
    both = {c: F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()) for c in columns}
    one = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in columns], *[n.alias(f"n|{c}") for c, n in both.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"), F.col(f"`n|{c}`").alias("n")) for c in columns])
    out = one.select(F.explode(rows).alias("c")).select("c.*")
    return out.withColumn("p", p_value(F.col("r"), F.col("n"))).withColumn("stars", stars(F.col("p"))) if with_p else out.select("feature", "r")


def quantiles(counts: DataFrame, value: str, key: str, places: dict[str, float]) -> DataFrame:
    """Exact quantiles by key of distinct values with their number ``__n``, linear between neighbours."""
    placed = running(counts, value, "__n", (key,), "__first")
    total = counts.groupBy(key).agg(F.sum("__n").alias("__total"))
    rows = placed.join(total, key)
    aggs = []
    for name, p in places.items():
        at = F.lit(p) * (F.col("__total") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("__first") <= place) & (place < F.col("__first") + F.col("__n"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"__{name}_{end}"))
    found = rows.groupBy(key, "__total").agg(*aggs)

    def between(name: str, p: float) -> Column:
        at = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return lo + (at - F.floor(at)) * (hi - lo)

    return found.select(key, *[between(name, p).alias(name) for name, p in places.items()])


def box(df: DataFrame, value: str, key: str) -> DataFrame:
    """Exact quartiles, whiskers within 1.5 times their range, mean and number of values beyond, by key; missing values go.

    Values are counted first and placed by range, so no key's values meet in one buffer.
    """
    v, n = F.col(value), F.col("__n")
    counts = df.where(v.isNotNull() & F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    q = quantiles(counts, value, key, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return counts.join(q, key).groupBy(key, "q1", "median", "q3").agg(
        (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"),
        F.sum(F.when(inside, 0).otherwise(n)).alias("beyond"))


def fliers(df: DataFrame, value: str, key: str) -> DataFrame:
    """The values that ``box`` counts as beyond its whiskers: ``key, value, n`` with how often each occurs; missing values go."""
    v = F.col(value)
    counts = df.where(v.isNotNull() & F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    q = quantiles(counts, value, key, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return counts.join(q, key).where(~v.between(F.col("q1") - reach, F.col("q3") + reach)).select(key, value, F.col("__n").alias("n"))


def _binned(rows: DataFrame, key: str, width: Column) -> DataFrame:
    """``key, place, weight``: each ``__v`` shared between the two neighbouring multiples of ``width``, in proportion to its nearness."""
    at = F.col("__v") / width
    held = rows.select(key, F.floor(at).alias("place"), (at - F.floor(at)).alias("part"))
    held = held.groupBy(key, "place").agg(F.sum(1 - F.col("part")).alias("low"), F.sum("part").alias("high"))
    both = F.explode(F.array(*[F.struct((F.col("place") + k).alias("place"), F.col(c).alias("weight")) for k, c in ((0, "low"), (1, "high"))])).alias("b")
    return held.select(key, both).select(key, "b.*").groupBy(key, "place").agg(F.sum("weight").alias("weight"))


def density(df: DataFrame, value: str, key: str, grid: list[float], bandwidth: float | None = None, adjust: float = 1.0, fineness: int = 2048, reach: float = 8.0) -> DataFrame:
    """``key, x, density``: Gaussian kernel density on a grid, each key's curve normed by itself.

    Values are first shared among bins of a bandwidth / ``fineness``, one map-side sum; the kernel, cut off at
    ``reach`` bandwidths, then goes from bins to the points of the grid near them.  So the work after the scan grows
    with the bins, not the rows, and the density is that of all rows within (1 / ``fineness``)² / 8 of its curvature.
    Without ``bandwidth`` a key has its own by Scott's rule, the sample deviation times n^(-1/5) times ``adjust``.

    Missing and infinite values take no part; a key whose bandwidth would be 0 or that has one value only has no curve;
    a point of the grid that no value reaches has density 0.
    """
    rows = df.where(finite(F.col(value)) & F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias("__v"))
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"))
    each = each.select(key, "__n", (F.lit(float(bandwidth)) if bandwidth is not None else F.col("__sd") * F.col("__n") ** -0.2 * adjust).alias("__bw")).where("__bw > 0")
    if bandwidth is None:  # a row a key: read beside the rows
        bins = _binned(rows.join(each, key), key, F.col("__bw") / fineness)
    else:
        bins = _binned(rows, key, F.lit(float(bandwidth) / fineness))
    points = F.array(*[F.lit(float(x)) for x in grid])
    at = F.col("place") * F.col("__bw") / fineness
    near = bins.join(each, key).withColumn("x", F.explode(F.filter(points, lambda x: F.abs(x - at) <= reach * F.col("__bw"))))
    z = (F.col("x") - at) / F.col("__bw")
    sums = near.groupBy(key, "x").agg(F.sum(F.col("weight") * F.exp(-z * z / 2)).alias("__s"))
    every = each.withColumn("x", F.explode(points))
    norm = F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi)
    return every.join(sums, [key, "x"], "left").select(key, "x", (F.coalesce("__s", F.lit(0.0)) / norm).alias("density"))


def saturating_mean(df: DataFrame, dist: str, key: str, top: float, half: float) -> DataFrame:
    """Mean over a neuron's synapses of ``top * d / (d + half)``."""
    d = F.col(dist)
    return df.groupBy(key).agg(F.avg(F.lit(top) * d / (d + half)).alias("predicted"))


def end_shares(df: DataFrame, column: str) -> DataFrame:
    """Shares of rows at zero and at infinity; missing values stay below the line."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), (F.count_if(F.col(column) == 0) / n).alias("at_zero"), (F.count_if(F.col(column) == float("inf")) / n).alias("at_infinity"))


def p_label(p: Column) -> Column:
    """A p-value as figures print it: one digit and an exponent below 0.001, else three decimals."""
    return F.when(p < 0.001, F.format_string("p = %.1e", p)).otherwise(F.format_string("p = %.3f", p))
