"""Distance profiles, histograms and binned trends; every bin comes from ``functions.binning``.

Defined results: a row whose distance is missing, NaN or out of range is in no bin of a profile; trends put values
out of range into the outer bins and leave out rows without one of their two values; a bin without rows has no row; a
missing flag is false; the deviation of a single row is 0 in trends and profiles over neurons; a series
that never exceeds its level crosses at infinity; repeated rows count each; empty tables give empty tables, and
``ValueError`` where bins are to be laid out between values that do not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.functions.binning import centre, clamped_bin, histogram_bin
from wiring.functions.numeric import INF, ratio

EPS = 1e-9


def _flag(inh_pref: bool) -> Column:
    """Spine preference, or with ``inh_pref`` preference for excitatory targets; a missing flag is false."""
    return F.coalesce(F.col("post_clf_type") == "E" if inh_pref else F.col("tag") == "spine", F.lit(False))


def micro_profile(tagged: DataFrame, edges: list[float], dist: str = "dist", inh_pref: bool = False, least: int = 0) -> DataFrame:
    """Pooled share per distance bin with binomial deviations; bins with more than ``least`` rows."""
    binned = tagged.select(histogram_bin(edges, F.col(dist)).alias("bin"), _flag(inh_pref).alias("hit")).where("bin IS NOT NULL")
    found = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k")).where(F.col("n") > least)
    p = F.col("k") / F.col("n")
    return found.select("bin", centre(edges, F.col("bin")).alias("centre"), "n", p.alias("share"), F.sqrt(p * (1 - p)).alias("sd"), F.sqrt(p * (1 - p) / F.col("n")).alias("sem"))


def by_neuron(tagged: DataFrame, edges: list[float], dist: str = "dist", inh_pref: bool = False, key: str = "pre_id") -> DataFrame:
    binned = tagged.select(key, histogram_bin(edges, F.col(dist)).alias("bin"), _flag(inh_pref).alias("hit")).where("bin IS NOT NULL")
    return binned.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k")).withColumn("share", F.col("k") / F.col("n"))


def macro_profile(tagged: DataFrame, edges: list[float], dist: str = "dist", inh_pref: bool = False, key: str = "pre_id") -> DataFrame:
    """Share per neuron and bin, then mean and population deviation over neurons; ``n`` counts the synapses of all."""
    one = by_neuron(tagged, edges, dist, inh_pref, key)
    found = one.groupBy("bin").agg(F.count(F.lit(1)).alias("n_neurons"), F.sum("n").alias("n"), F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"))
    return found.select("bin", centre(edges, F.col("bin")).alias("centre"), "n_neurons", "n", "mean", "sd", (F.col("sd") / F.sqrt("n_neurons")).alias("sem"))


def crossings(shares: DataFrame, edges: list[float], key: str, at_start: str, level: float = 0.5) -> DataFrame:
    """Where the share first exceeds ``level``, interpolated between bin centres.

    ``at_start`` says what a neuron above it from its first bin gets: ``zero`` or the ``centre`` of
    that bin.  Those that never cross are infinite.
    """
    order = Window.partitionBy(key).orderBy("bin")
    c = centre(edges, F.col("bin"))
    rows = shares.select(key, "bin", "share", c.alias("x"), F.lag(c).over(order).alias("x0"), F.lag("share").over(order).alias("y0"))
    between = F.col("x0") + (level - F.col("y0")) / (F.col("share") - F.col("y0") + EPS) * (F.col("x") - F.col("x0"))
    start = F.lit(0.0) if at_start == "zero" else F.col("x")
    cross = F.when(F.col("y0").isNull(), start).otherwise(between)
    return rows.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("share") > level, cross), F.when(F.col("share") > level, F.col("bin"))), F.lit(INF)).alias("crossing"))


def binned_trend(df: DataFrame, x: str, y: str, edges: list[float], error: str = "sem", least: int = 1) -> DataFrame:
    """Mean and error of ``y`` per bin of ``x``; outer values fall into the outer bins, a single row has error 0."""
    if error not in ("sem", "std"):
        raise ValueError(f"unknown error {error!r}")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(clamped_bin(edges, F.col(x)).alias("bin"), F.col(y).alias("__y"))
    found = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.coalesce(F.stddev_samp("__y"), F.lit(0.0)).alias("std")).where(F.col("n") >= least)
    err = F.col("std") if error == "std" else F.col("std") / F.sqrt("n")
    return found.select("bin", centre(edges, F.col("bin")).alias("centre"), "mean", err.alias("error"), "n")


def equal_edges(df: DataFrame, x: str, bins: int) -> list[float]:
    """Edges of ``bins`` bins of equal width between the least and the greatest value: one row comes to the driver."""
    low, high = df.agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double"))).first()
    if low is None:
        raise ValueError(f"no value in {x}")
    step = (high - low) / bins
    return [*(low + step * k for k in range(bins)), high]


def labelled_trends(df: DataFrame, x: str, ys: list[str], bins: int | list[float], error: str = "sem", least: int = 1) -> DataFrame:
    """``binned_trends`` with each series' Pearson r, p, stars, slope, intercept and R² beside it.

    A whole number of bins has its edges between the least and the greatest ``x``.
    """
    from wiring.operators.stats import regression

    edges = equal_edges(df, x, bins) if isinstance(bins, int) else bins
    trend = binned_trends(df, x, ys, edges, error, least)
    long = df.select(F.col(x).cast("double").alias("x"), F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("y")) for y in ys])).alias("s"))
    lines = regression(long.select("x", "s.*"), "x", "y", ("series",), with_p=True).select("series", "r", "p", "stars", "slope", "intercept", "r2")
    return trend.join(lines, "series")


#: The edges of the panels by what is on their x axis.
PANEL_EDGES = {
    "spine_density": [0.0, 0.001, 0.005, 0.01, 0.02, 0.04, 0.08],
    "ds_spine_density": [0.125, 0.375, 0.625, 0.875, 1.125, 1.375],
    "spine": [0.0, 25.0, 50.0, 75.0, 100.0, 125.0, 150.0, 175.0, 200.0],
}
PANELS = {"synapses": ("in_synapses", "syn_density"), "contacts": ("contacts", "contacts"), "partners": ("in_neurons", "partner_density")}


def panel_trends(df: DataFrame, x: str, density: bool = False, error: str = "sem", least: int = 1, edges: list[float] | None = None) -> DataFrame:
    """Trends of excitatory and inhibitory input in three panels: synapses, synapses per contact and partners.

    Columns as ``connectivity_features`` names them, raw or by dendrite length; edges by the name of
    ``x`` unless given.  All six columns are binned in one job.
    """
    c = {f"{kind}_{panel}": F.col(f"{kind}_{PANELS[panel][density]}") for panel in PANELS for kind in ("ex", "inh")}
    if density:
        c |= {name: ratio(value, F.col("dendrite_length")) for name, value in c.items() if name.endswith("contacts")}
    rows = df.select(F.col(x).cast("double").alias("__x"), *[value.alias(name) for name, value in c.items()])
    found = binned_trends(rows, "__x", list(c), edges or PANEL_EDGES[x], error, least)
    return found.withColumns({"panel": F.substring_index("series", "_", -1), "kind": F.substring_index("series", "_", 1)}).drop("series")


def shares(df: DataFrame, x: str, edges: list[float], series: tuple[str, ...] = ()) -> DataFrame:
    """Histogram by series, as counts and as shares of the series' rows in range."""
    found = df.select(*series, histogram_bin(edges, F.col(x)).alias("bin")).where("bin IS NOT NULL").groupBy(*series, "bin").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*series))))


def binned_trends(df: DataFrame, x: str, ys: list[str], edges: list[float], error: str = "sem", least: int = 1) -> DataFrame:
    """``binned_trend`` of several columns at once: they are stacked, so one scan and one aggregation serve all."""
    if error not in ("sem", "std"):
        raise ValueError(f"unknown error {error!r}")
    series = F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("y")) for y in ys]))
    rows = df.where(F.col(x).isNotNull()).select(clamped_bin(edges, F.col(x)).alias("bin"), series.alias("s")).select("bin", "s.*").where("y IS NOT NULL")
    found = rows.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std")).where(F.col("n") >= least)
    err = F.col("std") if error == "std" else F.col("std") / F.sqrt("n")
    return found.select("series", "bin", centre(edges, F.col("bin")).alias("centre"), "mean", err.alias("error"), "n")


def axon_profile(tagged: DataFrame, edges: list[float], of: list[int], own_edges: list[float] | None = None, average: str = "macro", dist: str = "dist",
                 inh_pref: bool = False, least: int = 0, level: float = 0.5) -> DataFrame:
    """The whole profile along axons: ``series, bin, centre, n, share, sd, sem, crossing``.

    The population (series ``all``) is binned by ``edges``: with ``macro`` the mean over neurons with its
    deviation, with ``micro`` the share of all synapses, either over bins with any.  Each neuron in ``of`` has its
    own shares in bins by ``own_edges`` (``edges`` unless given) with more than ``least`` synapses, and
    binomial errors.  ``crossing`` is where a series first exceeds ``level``: from its first bin on that
    is the bin's centre for the population and 0 for a neuron; infinite if never.
    """
    if average not in ("macro", "micro"):
        raise ValueError(f"unknown average {average!r}")
    own_edges = own_edges or edges
    pooled = macro_profile(tagged, edges, dist, inh_pref).withColumnRenamed("mean", "share") if average == "macro" else micro_profile(tagged, edges, dist, inh_pref)
    pooled = pooled.select(F.lit("all").alias("series"), "bin", "centre", "n", "share", "sd", "sem")
    own = by_neuron(tagged.where(F.col("pre_id").isin(*of)), own_edges, dist, inh_pref).where(F.col("n") > least)
    spread = F.sqrt(F.col("share") * (1 - F.col("share")))
    single = own.select(F.col("pre_id").cast("string").alias("series"), "bin", centre(own_edges, F.col("bin")).alias("centre"), "n", "share", spread.alias("sd"), (spread / F.sqrt("n")).alias("sem"))
    parts = [rows.join(crossings(rows, bins, "series", start, level), "series") for rows, bins, start in ((pooled, edges, "centre"), (single, own_edges, "zero"))]
    return parts[0].unionByName(parts[1])
