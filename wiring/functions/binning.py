"""Bins by their literal edges: comparing with the edges themselves, as widths are not exact in binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_edges(low: float, high: float, n_edges: int) -> list[float]:
    """``n_edges`` equally spaced edges, so ``n_edges - 1`` bins; the last is ``high`` itself."""
    step = (high - low) / (n_edges - 1)
    return [*(low + step * k for k in range(n_edges - 1)), float(high)]


def centre(edges: list[float], k: Column) -> Column:
    e = F.array(*[F.lit(float(x)) for x in edges])
    return (F.get(e, k) + F.get(e, k + 1)) / 2


def _at_most(edges: list[float], x: Column) -> Column:
    """How many edges are at most ``x``, by bisection over the literals: a few comparisons, no lambda."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= float(edges[mid]), pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(edges))


def below(edges: list[float], x: Column) -> Column:
    """How many edges are at most ``x``."""
    return F.when(x.isNotNull(), _at_most(edges, x))


def histogram_bin(edges: list[float], x: Column) -> Column:
    """Half-open bins, the last closed; NULL out of range and for missing values.

    The bisection stands in it once, so that the code made of it stays small enough for the JVM to compile.
    """
    return F.when((x >= float(edges[0])) & (x <= float(edges[-1])), _at_most(edges[1:-1], x)).cast("int")


def clamped_bin(edges: list[float], x: Column) -> Column:
    """Bins with out-of-range values in the outer ones."""
    return F.when(x.isNotNull(), _at_most(edges[1:-1], x)).cast("int")
