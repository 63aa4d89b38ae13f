"""Weighted curve fits to binned profiles: a group is at most its bins, so NumPy solves many at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saturating(d, top, half):
    return top * d / (d + half)


def biphasic(d, base, top, half, bump, centre, width):
    """A saturating rise from ``base`` to ``top`` and a Gaussian bump on it."""
    return base + (top - base) * d / (d + half) + bump * np.exp(-((d - centre) ** 2) / (2 * width**2))


#: Fixed values of the biphasic fit: name, least, start and greatest value of each parameter.
BIPHASIC = (
    ("base", 0.0, 0.2, 0.5),
    ("top", 0.5, 0.8, 1.0),
    ("half", 1.0, 150.0, 1200.0),
    ("bump", 0.0, 0.15, 0.5),
    ("centre", 10.0, 50.0, 200.0),
    ("width", 5.0, 30.0, 150.0),
)


def fit_saturating(d, y, w) -> tuple[float, float]:
    """``fit_saturating_all`` for one series."""
    top, half = fit_saturating_all(*(np.asarray(v, float)[None] for v in (d, y, w)))
    return float(top[0]), float(half[0])


#: Least distances that rows searched together have between them, and rows that are searched together.
_PLACES, _ROWS = 256, 1024


def fit_saturating_all(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least weighted squares with ``top`` in [0, 1] and ``half`` from 1e-5 up, without an upper bound, for each row.

    For each ``half`` the best ``top`` is closed, so one search remains, over its logarithm.  Far beyond the
    greatest distance the curve is the line ``d * top / half``; the line that fits best has a slope of
    ``s``, so with ``top`` at most 1 no fit has its ``half`` far above ``1 / s`` and the search goes well past that.
    Shares that are all 0 have ``top`` 0 and the least ``half``.  Rows are searched side by side, each as it
    would be alone.
    """
    slope = (w * d * y).sum(1) / np.maximum((w * d * d).sum(1), 1e-300)
    tops, halves = np.zeros(len(d)), np.full(len(d), 1e-5)
    tops[np.isnan(slope)] = halves[np.isnan(slope)] = np.nan
    left = np.flatnonzero(slope > 0)  # rows with more to find
    rows = _ROWS if len(np.unique(d[left])) <= _PLACES else max(1, _PLACES // d.shape[1])
    for begin in range(0, len(left), rows):
        own = left[begin : begin + rows]
        high = np.log(np.maximum(np.maximum(10 * d[own].max(1), 1.0), 1000 / slope[own]))
        tops[own], halves[own] = _search(d[own], y[own], w[own], high)
    return tops, halves


def _search(d: np.ndarray, y: np.ndarray, w: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best ``top`` and ``half`` of each row, ``half`` up to ``exp(high)``.

    The slope of the loss over a grid takes four products of matrices over the rows' distances, and every place where
    it turns from falling to rising is then found in its own row.  These and the two ends are all that can be least.
    """
    low = np.log(1e-5)
    grid = low + 0.05 * np.arange(int((high.max() - low) / 0.05) + 2)
    places, at = np.unique(d, return_inverse=True)
    row = np.repeat(np.arange(len(d)), d.shape[1]) * len(places) + at.ravel()
    weight, value = (np.bincount(row, v.ravel(), len(d) * len(places)).reshape(len(d), -1) for v in (w, w * y))
    half = np.exp(grid)
    f, rest = places[:, None] / (places[:, None] + half), half / (places[:, None] + half)
    top = np.clip((value @ f) / np.maximum(weight @ (f * f), 1e-300), 0, 1)
    falls = top * (value @ (f * rest) - top * (weight @ (f * f * rest))) < 0
    own, k = np.nonzero(falls[:, :-1] & ~falls[:, 1:] & (grid[:-1] < high[:, None]))

    def tried(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``top``, loss and its slope (as far as its sign and its roots go) of rows at ``h``."""
        half = np.exp(h)[:, None]
        f, rest = d[own] / (d[own] + half), half / (d[own] + half)
        wf = w[own] * f
        top = np.clip((wf * y[own]).sum(1) / np.maximum((wf * f).sum(1), 1e-300), 0, 1)
        off = y[own] - top[:, None] * f
        return top, (w[own] * off * off).sum(1), top * (wf * rest * off).sum(1)

    a, b = grid[k], np.minimum(grid[k + 1], high[own])
    ga, gb = tried(own, a)[2], tried(own, b)[2]
    turn, left = b.copy(), np.flatnonzero((ga < 0) & (gb > 0))
    side = np.zeros(len(own), int)
    for _ in range(100):  # false position; an end that stays has its slope halved
        if not len(left):
            break
        x = np.clip(b[left] - gb[left] * (b[left] - a[left]) / (gb[left] - ga[left]), a[left], b[left])
        g = tried(own[left], x)[2]
        done = (g == 0) | (np.abs(x - turn[left]) < 1e-13) | (b[left] - a[left] < 1e-13)
        turn[left] = x
        up, down = left[g > 0], left[g <= 0]
        ga[up[side[up] > 0]] /= 2
        gb[down[side[down] < 0]] /= 2
        b[up], gb[up], side[up] = x[g > 0], g[g > 0], 1
        a[down], ga[down], side[down] = x[g <= 0], g[g <= 0], -1
        left = left[~done]
    every = np.arange(len(d))
    own, h = np.concatenate([own, every, every]), np.concatenate([turn, np.full(len(d), low), high])
    top, loss, _ = tried(own, h)
    order = np.lexsort((h, loss, own))
    first = order[np.r_[True, own[order][1:] != own[order][:-1]]]
    return top[first], np.exp(h[first])


def fit_bounded(model, d, y, w, low, start, high, rounds: int = 2000):
    """Levenberg-Marquardt on parameters scaled to their bounds; one at a bound that wants beyond it rests for the round."""
    low, high = np.array(low, float), np.array(high, float)
    span, sw = high - low, np.sqrt(w)
    p, mu = (np.array(start, float) - low) / span, 1e-2

    def residuals(q: np.ndarray) -> np.ndarray:
        return sw * (y - model(d, *(low + q * span)))

    r = residuals(p)
    for _ in range(rounds):
        h = np.where(p < 0.5, 1e-6, -1e-6)
        jac = np.stack([(r - residuals(p + np.eye(len(p))[k] * h[k])) / h[k] for k in range(len(p))], 1)
        slope = jac.T @ r
        free = ~((p <= 0) & (slope < 0) | (p >= 1) & (slope > 0))
        if not free.any():
            break
        a = (jac.T @ jac)[np.ix_(free, free)]
        step = np.zeros(len(p))
        step[free] = np.linalg.lstsq(a + mu * np.diag(np.maximum(np.diag(a), 1e-12)), slope[free], rcond=None)[0]
        q = np.clip(p + step, 0, 1)
        s = residuals(q)
        if s @ s < r @ r:
            done = r @ r - s @ s < 1e-14 * max(r @ r, 1e-300)
            p, r, mu = q, s, max(mu / 3, 1e-12)
            if done:
                break
        else:
            mu *= 4
            if mu > 1e12:
                break
    return low + p * span


def goodness(y, fitted, w) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean squared error and R² of each row: 1 without residuals, 0 without spread."""
    mean = (w * y).sum(1) / w.sum(1)
    res, tot = (w * (y - fitted) ** 2).sum(1), (w * (y - mean[:, None]) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (w * (y - fitted) ** 2).mean(1), np.where(res == 0, 1.0, np.where(tot == 0, 0.0, 1 - res / tot))


def fits(profile: DataFrame, keys: list[str], x: str, y: str, n: str, model: str = "saturating") -> DataFrame:
    """``keys``, the parameters, weighted error and R² of each group's profile; weights are the counts ``n``.

    A group is one row with its bins; groups with as many bins are fitted side by side.
    """
    if model not in ("saturating", "biphasic"):
        raise ValueError(f"unknown model {model!r}")
    names = ["top", "half"] if model == "saturating" else [name for name, *_ in BIPHASIC]
    width = len(keys)

    def solve(d: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        if model == "saturating":
            p, f = np.stack(fit_saturating_all(d, v, w), 1), saturating
        else:
            p = np.stack([fit_bounded(biphasic, *one, *zip(*[values for _, *values in BIPHASIC], strict=True)) for one in zip(d, v, w, strict=True)])
            f = biphasic
        return np.column_stack([p, *goodness(v, f(d, *(c[:, None] for c in p.T)), w)])

    def run(batches):
        for batch in batches:
            lists = batch.columns[width:]
            group = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
            d, v, w = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in lists)
            known = ~(np.isnan(d) | np.isnan(v) | np.isnan(w))
            group, d, v, w = (c[known] for c in (group, d, v, w))
            order = np.lexsort((d, group))
            d, v, w = d[order], v[order], w[order]
            bins = np.bincount(group, minlength=batch.num_rows)
            starts = np.cumsum(bins) - bins
            found = np.full((batch.num_rows, len(names) + 2), np.nan)
            for size in np.unique(bins[bins >= len(names)]):
                own = np.flatnonzero(bins == size)
                at = starts[own][:, None] + np.arange(size)
                found[own] = solve(d[at], v[at], w[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(c, pa.float64(), from_pandas=True) for c in found.T)], [*keys, *names, "w_mse", "r2"])

    kinds = {f.name: f.dataType.simpleString() for f in profile.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` double" for c in [*names, "w_mse", "r2"]]])
    rows = profile.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(a) for c, a in ((x, "x"), (y, "y"), (n, "n"))])).alias("__bins"))
    return rows.select(*keys, *[F.col(f"__bins.{c}").alias(f"__{c}") for c in "xyn"]).mapInArrow(run, schema)


def fit_population(tagged: DataFrame, edges: list[float], model: str = "saturating", key: str = "pre_id") -> DataFrame:
    """The fit to the mean over neurons of their shares by bin, weighed by the synapses of all neurons in the bin."""
    from wiring.operators.profiles import macro_profile

    profile = macro_profile(tagged, edges, key=key).withColumn("model", F.lit("population"))
    return fits(profile, ["model"], "centre", "mean", "n", model)


def fit_single(tagged: DataFrame, edges: list[float], model: str = "saturating", key: str = "pre_id", least: int = 0) -> DataFrame:
    """A fit for each neuron to its own shares, over bins with more than ``least`` synapses."""
    from wiring.functions.binning import centre
    from wiring.operators.profiles import by_neuron

    profile = by_neuron(tagged, edges, key=key).where(F.col("n") > least).withColumn("centre", centre(edges, F.col("bin")))
    return fits(profile, [key], "centre", "share", "n", model)
