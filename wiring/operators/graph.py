"""Graph operators on edge lists ``pre_id, post_id, n_syn`` with the types of both ends; never a matrix.

Defined results: an edge list has a row for each pair, and repeated rows count each unless a function says otherwise; self-loops
are edges; a type other than E and I counts among all and under neither; edges whose ends are not
neurons go where neurons are joined; empty edges give degrees of 0 and otherwise empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiring.functions.ranges import running


def typed(edges: DataFrame, neurons: DataFrame) -> DataFrame:
    """Edges whose two ends are neurons, with their types."""
    t = neurons.select("root_id", "clf_type")
    pre = t.select(F.col("root_id").alias("pre_id"), F.col("clf_type").alias("pre_type"))
    post = t.select(F.col("root_id").alias("post_id"), F.col("clf_type").alias("post_type"))
    return edges.select("pre_id", "post_id", "n_syn").join(pre, "pre_id").join(post, "post_id")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids.root_id``."""
    keep = ids.select("root_id").distinct()
    return edges.join(keep, edges["pre_id"] == keep["root_id"], "left_semi").join(keep, edges["post_id"] == keep["root_id"], "left_semi")


def require_some(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no neuron survives the filters")
    return df


def degrees(edges: DataFrame, neurons: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Twelve degrees (in, out; synapses, neurons; all, E, I) of every neuron, zero where it has no edge.

    With ``keys`` (a replicate) edges and ``neurons`` both have these columns and each graph is counted for itself.
    """

    def side(key: str, other: str, name: str) -> DataFrame:
        n, t = F.col("n_syn"), F.col(other)
        aggs = []
        for p, cond in (("", F.lit(True)), ("ex_", t == "E"), ("inh_", t == "I")):
            aggs += [F.sum(F.when(cond, n)).alias(f"{p}{name}_synapses"), F.count_if(cond).alias(f"{p}{name}_neurons")]
        return edges.groupBy(*keys, F.col(key).alias("root_id")).agg(*aggs)

    own = [*keys, "root_id"]
    both = neurons.join(side("post_id", "pre_type", "in"), own, "left").join(side("pre_id", "post_type", "out"), own, "left")
    new = [c for c in both.columns if c not in neurons.columns]
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in new})


def blocks(edges: DataFrame) -> DataFrame:
    """Edges with the pair of types that they join, presynaptic first."""
    return edges.withColumn("block", F.concat("pre_type", "post_type"))


def shared_input(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean number of targets of a neuron's inputs, within each of ``keys`` (block, replicate).

    Repeated edges count once.  Pairs lie by source, where they are made one and counted; a
    source's targets are at most the neurons, and its window spills.
    """
    own = edges.where("n_syn > 0").select(*keys, "pre_id", "post_id")
    pairs = own.distinct().withColumn("out_degree", F.count(F.lit(1)).over(Window.partitionBy(*keys, "pre_id")))
    return pairs.groupBy(*keys, F.col("post_id").alias("root_id")).agg(F.avg("out_degree").alias("shared_input"))


def partner_rows(edges: DataFrame, neurons: DataFrame, root_id: int, kind: str | None = None) -> DataFrame:
    """The neurons' own rows, whole, of those that send input to one neuron, of type ``kind`` if given, with ``n_syn``.

    A partner without a row has none here; self-loops count as edges do; without input the result is empty.
    """
    found = edges.where((F.col("post_id") == root_id) & (F.col("n_syn") > 0))
    if kind is not None:
        found = found.where(F.col("pre_type") == kind)
    weights = found.groupBy(F.col("pre_id").alias("__id")).agg(F.sum("n_syn").alias("n_syn"))
    return neurons.join(weights, F.col("root_id") == F.col("__id")).drop("__id")


def partners(edges: DataFrame, root_id: int) -> DataFrame:
    return edges.where(F.col("post_id") == root_id).select(F.col("pre_id").alias("root_id"), F.col("pre_type").alias("clf_type"), "n_syn")


def shared_partners(edges: DataFrame, a: int, b: int) -> DataFrame:
    """How many inputs two neurons share, by type."""
    pa, pb = (partners(edges, k).select("root_id", "clf_type").distinct() for k in (a, b))
    return pa.intersect(pb).groupBy("clf_type").agg(F.count(F.lit(1)).alias("n_shared"))


def nodes(edges: DataFrame) -> DataFrame:
    """Every id that an edge names, once."""
    return edges.select(F.col("pre_id").alias("root_id")).union(edges.select("post_id")).distinct()


def input_sets(edges: DataFrame) -> DataFrame:
    """Sorted ids of each neuron's inputs, by type; a hub's set is as long as its degree."""
    def one(t: str):
        return F.sort_array(F.collect_set(F.when(F.col("pre_type") == t, F.col("pre_id"))))

    return edges.groupBy(F.col("post_id").alias("root_id")).agg(one("E").alias("ex_inputs"), one("I").alias("inh_inputs"))


def matrix_index(neurons: DataFrame) -> DataFrame:
    """A dense index for display: places by id, counted by range so that no task sorts all ids; a repeated id has one place."""
    ids = neurons.select("root_id").where("root_id IS NOT NULL").distinct().withColumn("one", F.lit(1).cast("long"))
    return running(ids, "root_id", "one", name="matrix_idx").select("root_id", "matrix_idx")


def reindexed(cells: DataFrame, mapping: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A matrix cut down to some neurons: its cells ``row, col, n_syn`` and its mapping ``idx, root_id``, both numbered anew.

    The neurons of ``ids`` that the mapping knows keep the order of their old indices and get 0, 1, ...;
    cells stay where both ends do.  Old indices are ranked by range, so no task orders them all.  Raises
    ``ValueError`` if no neuron is left; ids that repeat or that the mapping lacks change nothing.
    """
    kept = require_some(mapping.join(ids.select("root_id").distinct(), "root_id", "left_semi").where("idx IS NOT NULL"))
    ranked = running(kept.select("idx", "root_id").withColumn("one", F.lit(1).cast("long")), "idx", "one", name="new").select("idx", "root_id", "new")
    row, col = (ranked.select(F.col("idx").alias(c), F.col("new").alias(f"new_{c}")) for c in ("row", "col"))
    left = cells.join(row, "row").join(col, "col").select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "n_syn")
    return left, ranked.select(F.col("new").alias("idx"), "root_id")
