"""Degree-preserving null models: all replicates are one plan with a ``replica`` column.

Defined results: every replicate has the degrees of the graph but for the edges that go (self-loops); a repeated
edge is a stub each, edges that meet are counted in ``n_syn``; an edge with a missing end goes, one with a missing type
where types are kept; two edges alike in both ends take their places in either order, which gives the same graph; an empty
graph has empty replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wiring.functions.ranges import running
from wiring.functions.scratch import discard, parts_for, written
from wiring.operators import replicates
from wiring.operators.features import connectivity_features
from wiring.operators.graph import shared_input

MODES = ("configuration",)


def stub_table(edges: DataFrame, keep_types: bool) -> DataFrame:
    """One row per edge, its block and a key that does not hang on partitioning."""
    block = F.concat("pre_type", "post_type") if keep_types else F.lit("all")
    return edges.select("pre_id", "post_id", "pre_type", "post_type", block.alias("block"), F.concat_ws("-", "pre_id", "post_id").alias("edge"))


def shuffled(edges: DataFrame, replicas: int = 1, seed: int = 0, keep_types: bool = True, mode: str = "configuration", diagonal_of: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Configuration model: sources and targets are put in two seeded random orders and joined place by place.

    Orders are by md5 of seed, replicate, side and edge, so every engine and partitioning gives the
    same graph.  The first byte of the md5 parts a block into 256 ranges of like size; each is
    ordered by itself and begins where the ranges before it end, so no task sorts a block.  True
    self-loops go, repeated edges are counted.  With ``diagonal_of``, the neurons ``root_id, clf_type``, the
    edges that go are those whose ends have the same place, by id, among the neurons of their own type,
    as on the diagonal of a block cut out of a matrix: in blocks of two types these are no self-loops.

    The edges are written once, as only they are read again by every replicate.  Both sides of all replicates are
    dealt in one shuffle: 16 bytes of md5, an id and a number for the rest.  The result lies by replicate and
    source, as its readers count it.  More than ``size`` edges (``BATCH_ROWS``) are made and written in batches.
    """
    if mode not in MODES:
        raise ValueError(f"unknown shuffle mode {mode!r}")
    return _by_batches(_held(edges, keep_types, diagonal_of), replicas, seed, lambda graphs, first, n: graphs, size or BATCH_ROWS)


def _held(edges: DataFrame, keep_types: bool, diagonal_of: DataFrame | None = None) -> DataFrame:
    """The stubs without what follows from their ends; shuffles behind them are deleted as soon as they are written."""
    stubs = stub_table(edges, keep_types).where("block IS NOT NULL").select("pre_id", "post_id", "pre_type", "post_type", "block")
    with _shuffles_deleted(edges.sparkSession):
        found = written(stubs, "stubs")
        if diagonal_of is None or not keep_types:
            return found
        both = written(_with_spots(found.drop("block"), diagonal_of).withColumn("block", F.concat("pre_type", "post_type")), "stubs")
    discard(found)
    return both


def _replicates(held: DataFrame, first: int, replicas: int, seed: int) -> DataFrame:
    """The replicates ``first`` and so many of a table of stubs."""
    spark, diagonal = held.sparkSession, "pre_spot" in held.columns
    spots, rows = ["pre_spot", "post_spot"] if diagonal else [], held.count() * replicas
    pairs = _pairs(held)
    n_pairs, n_groups = (F.lit(max(n, 1)).cast("long") for n in pairs.agg(F.count(F.lit(1)), F.countDistinct("block")).first())
    coded = _coded(held, pairs, spots)

    # a lane is one side of one block of one replicate; even sides are sources, odd ones targets
    sides = F.explode(F.sequence(F.lit(2 * first).cast("long"), F.lit(2 * (first + replicas) - 1).cast("long")))
    every = coded.withColumn("k", sides)
    source = F.col("k").bitwiseAND(1) == 0
    order = F.unhex(F.md5(F.concat_ws("-", F.lit(str(seed)), F.shiftright("k", 1).cast("string"), F.when(source, "pre").otherwise("post"), "edge")))
    own = ["id", "spot"] if diagonal else ["id"]
    lane = F.col("k") * n_groups + F.col("group")
    dealt = every.select((lane * n_pairs + F.col("pair")).alias("slot"), *[F.when(source, F.col(f"pre_{c}")).otherwise(F.col(f"post_{c}")).alias(c) for c in own], order.alias("order"))
    lane, begin = _div(F.col("slot"), n_pairs), F.substring("order", 1, 1)
    graph = _div(lane, 2 * n_groups) * n_groups + lane % n_groups  # a block of a replicate
    sizes = dealt.select(lane.alias("lane"), begin.alias("range")).groupBy("lane", "range").agg(F.count(F.lit(1)).alias("n"))  # 256 rows at most for each lane
    before = Window.partitionBy("lane").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("lane", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    near = dealt.repartition(parts_for(spark, 2 * rows), graph, begin).select(lane.alias("lane"), begin.alias("range"), graph.alias("graph"), (F.col("slot") % n_pairs).alias("pair"), *own, "order")
    by_range = Window.partitionBy("graph", "range", "lane").orderBy("order")
    inside = near.withColumn("inside", F.row_number().over(by_range)).drop("order")
    placed = inside.join(F.broadcast(begins), ["lane", "range"]).withColumn("place", F.col("begin") + F.col("inside"))

    # the two ends of a place mostly lie in one range, so they become one row before it is sent
    side = _div(F.col("lane"), n_groups).bitwiseAND(1)
    ends = [F.max(F.when(side == k, F.col(c))).alias(f"{name}_{c}") for k, name in enumerate(("pre", "post")) for c in ("pair", *own)]
    joined = placed.groupBy("graph", "place").agg(*ends).where("pre_spot <> post_spot" if diagonal else "pre_id <> post_id")
    ids = ["replica", "pre_pair", "post_pair", "pre_id", "post_id"]
    return _counted(joined.select(_div(F.col("graph"), n_groups).alias("replica"), *ids[1:]), pairs, held, replicas)


def _counted(joined: DataFrame, pairs: DataFrame, held: DataFrame, replicas: int) -> DataFrame:
    """Edges that meet, as one with their number and types; they lie by replicate and source."""
    ids = ["replica", "pre_pair", "post_pair", "pre_id", "post_id"]
    parts = parts_for(held.sparkSession, held.count() * replicas)
    counted = joined.repartition(parts, "replica", "pre_id").groupBy(*ids).agg(F.count(F.lit(1)).alias("n_syn"))
    pre = pairs.select(F.col("pair").alias("pre_pair"), "block", "pre_type")
    post = pairs.select(F.col("pair").alias("post_pair"), "post_type")
    found = counted.join(F.broadcast(pre), "pre_pair").join(F.broadcast(post), "post_pair")
    ends = [F.col(c).cast(held.schema[c].dataType).alias(c) for c in ("pre_id", "post_id")]
    return found.select("replica", "block", *ends, "pre_type", "post_type", "n_syn")


def _pairs(held: DataFrame) -> DataFrame:
    """A row for each pair of types, with its number and that of its block; the driver learns how many there are."""
    pairs = held.select("block", "pre_type", "post_type").distinct()
    return pairs.withColumns({"pair": F.row_number().over(Window.orderBy("block", "pre_type", "post_type")) - 1, "group": F.dense_rank().over(Window.orderBy("block")) - 1})


def _coded(held: DataFrame, pairs: DataFrame, spots: list[str]) -> DataFrame:
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("pre_type", "post_type")]
    return held.alias("s").join(F.broadcast(pairs.alias("k")), same[0] & same[1]).select("s.pre_id", "s.post_id", F.concat_ws("-", "s.pre_id", "s.post_id").alias("edge"), *spots, "k.pair", "k.group")


def _div(a: Column, b: Column) -> Column:
    """Whole part of a quotient of whole numbers."""
    return F.call_function("div", a, b)


def _with_spots(stubs: DataFrame, neurons: DataFrame) -> DataFrame:
    """Edges with the places of their two ends among the neurons of their types, none for an end that is no such neuron."""
    ids = neurons.select("root_id", F.col("clf_type").alias("type"), F.lit(1).cast("long").alias("one")).distinct()
    places = running(ids, "root_id", "one", ("type",), "place_of")
    for end in ("pre", "post"):
        own = places.select(F.col("root_id").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"), F.col("place_of").alias(f"{end}_spot"))
        stubs = stubs.join(own, [f"{end}_id", f"{end}_type"], "left")
    return stubs


#: Shuffled edges of all replicates that are made at once.
BATCH_ROWS = 50_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def by_batches(edges: DataFrame, replicas: int, seed: int, each: Callable[[DataFrame, int, int], DataFrame], keep_types: bool = True, size: int = BATCH_ROWS) -> DataFrame:
    """``each(graphs, first, n)`` over the replicates in batches of about ``size`` edges.

    Where one batch does not hold them all, the results of each are written and its shuffles deleted before
    the next, so the disk holds those of one batch however many replicates there are.
    """
    return _by_batches(_held(edges, keep_types), replicas, seed, each, size)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Here what is written deletes its shuffles as soon as it is there."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _by_batches(held: DataFrame, replicas: int, seed: int, each: Callable[[DataFrame, int, int], DataFrame], size: int = BATCH_ROWS) -> DataFrame:
    n = min(replicas, max(1, size // max(1, held.count())))
    if n == replicas:
        return each(_replicates(held, 0, replicas, seed), 0, replicas)
    found, make = [], _joined_parts if _numbered(held) else _replicates
    with _shuffles_deleted(held.sparkSession):
        for first in range(0, replicas, n):
            m = min(n, replicas - first)
            found.append(written(each(make(held, first, m, seed), first, m), "replicates"))
    return reduce(DataFrame.unionByName, found)


def _numbered(held: DataFrame) -> bool:
    return all(isinstance(held.schema[c].dataType, IntegralType) for c in ("pre_id", "post_id"))


def _joined_parts(held: DataFrame, first: int, replicas: int, seed: int) -> DataFrame:
    """As ``_replicates``, with the two ends of a place joined where their stubs are dealt to."""
    pairs = _pairs(held)
    n_pairs, n_groups = pairs.agg(F.count(F.lit(1)), F.countDistinct("block")).first()
    if n_pairs > replicates.WHOLE_PAIRS:
        return _replicates(held, first, replicas, seed)
    spots = [c for c in held.columns if c.endswith("_spot")]
    joined = replicates.dealt(_coded(held, pairs, spots), n_groups, first, replicas, seed)
    return _counted(joined, pairs, held, replicas)


def _whole(edges: DataFrame, keep_types: bool) -> tuple[DataFrame, list | None]:
    """The stubs, and the pairs of types by number where a task can hold the graph whole."""
    held = _held(edges, keep_types)
    if not _numbered(held) or held.count() > replicates.WHOLE_EDGES:
        return held, None
    pairs = _pairs(held).orderBy("pair").limit(replicates.WHOLE_PAIRS + 1).collect()
    return held, pairs if len(pairs) <= replicates.WHOLE_PAIRS else None


def null_shared_input(edges: DataFrame, replicas: int, seed: int = 0, keep_types: bool = True, by_block: bool = False) -> DataFrame:
    """Shared input on every replicate, over the whole graph or within each pair of types.

    Replicates that a task can hold are made and counted there, larger ones are dealt by ranges, in batches.
    """
    keys = ("replica", "block") if by_block else ("replica",)

    def each(graphs: DataFrame, first: int, n: int) -> DataFrame:
        return shared_input(graphs.withColumn("block", F.concat("pre_type", "post_type")) if by_block else graphs, keys)

    held, pairs = _whole(edges, keep_types)
    if pairs is None:
        return _by_batches(held, replicas, seed, each)
    joined = [[None if None in (p.pre_type, q.post_type) else p.pre_type + q.post_type for q in pairs] for p in pairs]
    names = list(dict.fromkeys(b for row in joined for b in row))
    at = {b: k for k, b in enumerate(names)}
    numbers = np.array([[at[b] for b in row] for row in joined]) if by_block else None

    def count(stubs: replicates.Stubs, edges: tuple) -> dict[str, np.ndarray]:
        return replicates.shared(stubs, edges, numbers)

    found = replicates.each_replica(replicates.packed(_coded(held, _pairs(held), [])), replicas, seed, count, "block long, shared_input double")
    root_id = F.col("root_id").cast(held.schema["post_id"].dataType).alias("root_id")
    if not by_block:
        return found.select("replica", root_id, "shared_input")
    return found.select("replica", F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("block").cast("int")).alias("block"), root_id, "shared_input")


def replica_features(neurons: DataFrame, edges: DataFrame, replicas: int, seed: int = 0) -> DataFrame:
    """``connectivity_features`` of the neurons on every replicate, made as for ``null_shared_input``."""
    held, pairs = _whole(edges, True)
    if pairs is None:
        return _by_batches(held, replicas, seed, lambda graphs, first, n: connectivity_features(neurons, graphs, n, first))
    codes = {"E": 1, "I": 2}
    kinds = np.array([[codes.get(p.pre_type, 0), codes.get(p.post_type, 0)] for p in pairs]).reshape(-1, 2)

    def count(stubs: replicates.Stubs, edges: tuple) -> dict[str, np.ndarray]:
        return replicates.degrees(stubs, edges, kinds)

    found = replicates.each_replica(replicates.packed(_coded(held, _pairs(held), [])), replicas, seed, count, ", ".join(f"{c} long" for c in replicates.DEGREES))
    return connectivity_features(neurons, None, replicas, counted=found)
