"""Per-neuron feature marts: one aggregation per relation, joined to the neurons once.

Defined results: a neuron without rows in a relation has counts of 0 there and no ratio; a ratio over 0 or over a
missing number is NULL, unless its function says otherwise; rows without a key belong to no neuron; a missing
or unknown tag counts among all tags and under none of its own; repeated rows count each, repeated neurons have a row
each; ties in an order go to the least id; empty tables give neurons without anything, no neurons an empty
table.  Other columns of the neurons are carried along, those of the same name as a feature are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.functions.numeric import differs, ieee_ratio, ratio, ratio_or_zero

TAGS = ("spine", "shaft", "soma")


def tag_join(synapses: DataFrame, tags: DataFrame, id_col: str = "id_", target_col: str = "target_id") -> DataFrame:
    """Synapses with the tag of their target; those without one go.  A target tagged twice is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(target_col))
    sure = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("target tagged more than once: "), F.col(target_col).cast("string")))).otherwise(F.col("tag"))
    once = tags.select(target_col, "tag", n.alias("__n")).select(F.col(target_col).alias(id_col), sure.alias("tag"))
    return synapses.join(once, id_col)


def spine_ratio(tagged: DataFrame, ids: DataFrame, group_by: str = "pre_id", feature: str = "spine") -> DataFrame:
    """For every id the share of its synapses with the tag; missing tags count below the line, absent ids have none."""
    found = tagged.groupBy(group_by).agg(F.count(F.lit(1)).alias("n_syn"), F.count_if(F.col("tag") == feature).alias("k"))
    return ids.join(found, F.col("root_id") == F.col(group_by), "left").select(
        "root_id", ratio(F.col("k"), F.col("n_syn")).alias("ratio"), F.coalesce("n_syn", F.lit(0)).alias("n_syn"))


def typed_spine_ratio(tagged: DataFrame, ids: DataFrame, pre: str, post: str, feature: str = "spine") -> DataFrame:
    """As ``spine_ratio`` for one pair of types, with the number of distinct targets."""
    some = tagged.where((F.col("pre_clf_type") == pre) & (F.col("post_clf_type") == post))
    found = some.groupBy("pre_id").agg(F.count(F.lit(1)).alias("n_syn"), F.count_if(F.col("tag") == feature).alias("k"), F.countDistinct("post_id").alias("binary_degree"))
    return ids.join(found, F.col("root_id") == F.col("pre_id"), "left").select(
        "root_id", ratio(F.col("k"), F.col("n_syn")).alias("ratio"), F.coalesce("n_syn", F.lit(0)).alias("n_syn"), F.coalesce("binary_degree", F.lit(0)).alias("binary_degree"))


def _tag_counts(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("root_id")).agg(*[F.count_if(F.col("tag") == t).alias(f"{prefix}{t}") for t in TAGS], F.count(F.lit(1)).alias(f"{prefix}all"))


def spine_features(neurons: DataFrame, tagged: DataFrame, tags_in: DataFrame, tags_out: DataFrame, in_key: str = "post_pt_root_id", out_key: str = "pre_pt_root_id") -> DataFrame:
    """Counts, distinct inputs and shares by tag and type from local synapses, all incoming tags and all outgoing tags.

    Shares have all tagged rows below the line, other and missing tags included; a neuron without
    rows has counts of 0 and no share.  Names: ``spine``, ``ex_spine`` count synapses, ``spine_neurons``
    distinct inputs; ``ds_`` stands for all incoming tags, ``ds_out_`` for all outgoing ones.
    """
    tag, pre = F.col("tag"), F.col("pre_clf_type")
    types = (("E", "ex"), ("I", "inh"))
    # by pair of neurons first: a pair is one input, so distinct inputs are counted without expanding the rows
    sums = {t: tag == t for t in TAGS} | {f"{name}_{t}": (tag == t) & (pre == e) for e, name in types for t in TAGS} | {"all": F.lit(True)}
    pairs = tagged.groupBy(F.col("post_id").alias("root_id"), "pre_id").agg(*[F.count_if(when).alias(name) for name, when in sums.items()])
    inputs = [*TAGS, *[f"{name}_spine" for _, name in types]]
    local = pairs.groupBy("root_id").agg(*[F.sum(name).alias(name) for name in sums], *[F.count_if((F.col(t) > 0) & F.col("pre_id").isNotNull()).alias(f"{t}_neurons") for t in inputs])
    mart = neurons
    for part in (local, _tag_counts(tags_in, in_key, "ds_"), _tag_counts(tags_out, out_key, "ds_out_")):
        mart = mart.join(part, "root_id", "left")
    c = F.col
    counts = [x for x in mart.columns if x not in neurons.columns]
    mart = mart.withColumns({x: F.coalesce(c(x), F.lit(0)) for x in counts})
    shares = {f"{p}{t}_ratio": ratio(c(f"{p}{t}"), c(f"{p}all")) for p, t in (("", "spine"), ("ds_", "spine"), ("ds_", "shaft"), ("ds_out_", "spine"), ("ds_out_", "shaft"))}
    return mart.withColumns(shares | {
        "ex_spine_share": ratio(c("ex_spine"), c("spine")),
        "spine_to_shaft": share_of(c("spine"), c("shaft")), "ds_spine_to_shaft": share_of(c("ds_spine"), c("ds_shaft")),
        "spine_to_shaft_neurons": share_of(c("spine_neurons"), c("shaft_neurons")),
        "spine_per_contact": ratio(c("spine"), c("spine_neurons")), "shaft_per_contact": ratio(c("shaft"), c("shaft_neurons")),
        "spine_density": ratio(c("spine"), c("dendrite_length")), "shaft_density": ratio(c("shaft"), c("dendrite_length")),
        "ds_spine_density": ratio(c("ds_spine"), c("dendrite_length")), "ds_shaft_density": ratio(c("ds_shaft"), c("dendrite_length")),
        "ds_out_spine_density": ratio(c("ds_out_spine"), c("axon_length")), "ds_out_shaft_density": ratio(c("ds_out_shaft"), c("axon_length"))})


def share_of(a: Column, b: Column) -> Column:
    """``a`` out of both."""
    return ratio(a, a + b)


def tagged_ratio(mart: DataFrame) -> Column:
    """Share of incoming synapses with one of the three tags; infinite where there are tags but no count."""
    return ieee_ratio(F.col("ds_spine") + F.col("ds_shaft") + F.col("ds_soma"), F.col("ds_num_of_incoming_synapses"))


def valid_neurons(mart: DataFrame, least: float = 0.9) -> DataFrame:
    """Neurons with both lengths, a spine ratio and enough of their input tagged."""
    return mart.where((F.col("dendrite_length") > 0) & (F.col("axon_length") > 0)).where(F.col("ds_spine_ratio").isNotNull()).where(tagged_ratio(mart) > least)


def contact_features(deg: DataFrame) -> DataFrame:
    """Densities by dendrite length and synapses per contact for all, excitatory and inhibitory input."""
    c = F.col
    names = {"": "", "ex_": "ex_", "inh_": "inh_"}
    out = {}
    for p in names:
        out[f"{p}syn_density"] = ratio(c(f"{p}in_synapses"), c("dendrite_length"))
        out[f"{p}partner_density"] = ratio(c(f"{p}in_neurons"), c("dendrite_length"))
        out[f"{p}contacts"] = ratio_or_zero(c(f"{p}in_synapses"), c(f"{p}in_neurons"))
    return deg.withColumns(out)


def type_ratios(deg: DataFrame) -> DataFrame:
    """Excitatory over inhibitory input and its share, by synapses, weight and partners."""
    c = F.col
    return deg.withColumns({
        "ei_synapses": ratio(c("ex_in_synapses"), c("inh_in_synapses")), "ei_neurons": ratio(c("ex_in_neurons"), c("inh_in_neurons")),
        "ei_weight": ratio(c("ex_in_weight"), c("inh_in_weight")), "ex_share": share_of(c("ex_in_synapses"), c("inh_in_synapses")),
        "ex_weight_share": share_of(c("ex_in_weight"), c("inh_in_weight")), "ex_partner_share": share_of(c("ex_in_neurons"), c("inh_in_neurons"))})


def volume_features(deg: DataFrame) -> DataFrame:
    """What of a neuron's whole input lies in the volume, its whole input and output by length, and synapses per contact."""
    c = F.col
    return deg.withColumns({
        "in_volume_share": ratio(c("in_synapses"), c("ds_num_of_incoming_synapses")), "ds_in_density": ratio(c("ds_num_of_incoming_synapses"), c("dendrite_length")),
        "syn_per_contact": ratio(c("in_synapses"), c("in_neurons")), "ds_out_density": ratio(c("ds_num_of_outgoing_synapses"), c("axon_length"))})


def connectivity_features(neurons: DataFrame, edges: DataFrame | None, replicas: int | None = None, first: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """Degrees and contact features of ``neurons`` on a graph, real or shuffled; such columns that they had before are made anew.

    With ``replicas``, ``edges`` holds so many graphs, ``replica`` ``first`` and the numbers after it, and every neuron
    has a row for each of them, with degrees of 0 where the graph has no edge of it: one plan for all.  ``counted`` are
    the degrees by ``replica`` and ``root_id`` where they are known already.
    """
    from wiring.operators.graph import degrees

    names = [f"{p}{d}_{w}" for d in ("in", "out") for p in ("", "ex_", "inh_") for w in ("synapses", "neurons")]
    names += [f"{p}{n}" for p in ("", "ex_", "inh_") for n in ("syn_density", "partner_density", "contacts")]
    own = neurons.drop(*names)
    if replicas is None:
        return contact_features(degrees(edges, own))
    every = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + replicas - 1).cast("long")))
    own = own.drop("replica").withColumn("replica", every)
    if counted is None:
        return contact_features(degrees(edges, own, ("replica",)))
    both = own.join(counted, ["replica", "root_id"], "left")
    return contact_features(both.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted.columns if c not in own.columns}))


def valid_network(mart: DataFrame, edges: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The valid neurons with their features on the graph that they induce, and that graph.

    Raises ``ValueError`` where no neuron is left.  ``inconsistent`` tells whether the two agree.
    """
    from wiring.operators.graph import induced, require_some

    left = require_some(valid_neurons(mart, least))
    own = induced(edges, left)
    return connectivity_features(left, own), own


def inconsistent(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """Neurons whose degrees differ from the edges' sums, and ends of edges that are no neuron: empty if all agrees."""
    half = [edges.groupBy(F.col(key).alias("node")).agg(F.sum("n_syn").alias(f"{n}_s"), F.count(F.lit(1)).alias(f"{n}_n")) for key, n in (("post_id", "in"), ("pre_id", "out"))]
    sums = half[0].join(half[1], "node", "full")
    both = neurons.select("root_id", "in_synapses", "in_neurons", "out_synapses", "out_neurons").join(sums, F.col("root_id") == F.col("node"), "full")
    wrong = F.col("root_id").isNull()
    for have, want in (("in_synapses", "in_s"), ("in_neurons", "in_n"), ("out_synapses", "out_s"), ("out_neurons", "out_n")):
        wrong |= F.coalesce(F.col(have), F.lit(0)) != F.coalesce(F.col(want), F.lit(0))
    return both.where(wrong).select(F.coalesce("root_id", "node").alias("root_id"))


def placed(neurons: DataFrame, positions: DataFrame, key: str = "pt_root_id") -> DataFrame:
    """Neurons with the columns of their position, none where it is not known."""
    return neurons.join(positions.withColumnRenamed(key, "__key"), F.col("root_id") == F.col("__key"), "left").drop("__key")


def below(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Rows under a limit; missing values go."""
    return df.where(F.col(column) < limit)


def above(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(F.col(column) > limit)


def not_tagged(tagged: DataFrame, tag: str = "spine") -> DataFrame:
    """Synapses of any other tag, those without one included."""
    return tagged.where(differs(F.col("tag"), tag))


def routed(blocks: DataFrame, value: str, ids: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Results by block as columns of the neurons they are about: ``kinds`` names the column of each block.

    A row of a block goes to the neuron ``root_id``; neurons without one in a block have none there.
    """
    wide = blocks.groupBy("root_id").agg(*[F.max(F.when(F.col("block") == b, F.col(value))).alias(name) for b, name in kinds.items()])
    return ids.join(wide, "root_id", "left")


def summary(synapses: DataFrame) -> DataFrame:
    """One row: synapses, distinct neurons on each side and synapses by tag."""
    return synapses.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pre_id").alias("n_pre"), F.countDistinct("post_id").alias("n_post"),
                        *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in TAGS])


def only_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; every copy of a repeated key goes."""
    once = df.groupBy(key).count().where("count = 1").select(key)
    return df.join(once, key, "left_semi")


def min_max_scaled(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    """A column moved to the range ``low`` to ``high``; the bounds come from one row beside the scan."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return df.join(F.broadcast(bounds)).withColumn(name, ratio(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (high - low) + low).drop("__lo", "__hi")


def category_order(df: DataFrame, column: str, levels: list[str], tie: str) -> DataFrame:
    """Rows by the place of their category, those out of the list last."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0))
    return df.withColumn("place", place).orderBy(F.col("place").asc_nulls_last(), tie)


def ranked_by_category(df: DataFrame, column: str, levels: list[str], tie: str) -> DataFrame:
    """``category_order`` as a number of each row within its category."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0))
    return df.withColumns({"place": place, "rank": F.row_number().over(Window.partitionBy(column).orderBy(tie)).cast("long")})


def outgoing_type_share(deg: DataFrame) -> DataFrame:
    """Excitatory share of outgoing synapses normed by their total to both types."""
    total = F.col("ex_out_synapses") + F.col("inh_out_synapses")
    return deg.withColumns({"n_syn_to_both": total, "ex_out_share": ratio(F.col("ex_out_synapses"), total)})


def subnet_spine_ratio(edges: DataFrame, tagged: DataFrame, ids: DataFrame, pre: str, post: str, feature: str = "spine") -> DataFrame:
    """``typed_spine_ratio`` of the neurons in ``ids`` with their number of targets within the block, zero without any."""
    block = edges.where((F.col("pre_type") == pre) & (F.col("post_type") == post) & (F.col("n_syn") > 0))
    out = block.select("pre_id", "post_id").distinct().groupBy(F.col("pre_id").alias("root_id")).agg(F.count(F.lit(1)).alias("block_degree"))
    found = typed_spine_ratio(tagged.join(ids.select(F.col("root_id").alias("pre_id")), "pre_id", "left_semi"), ids.select("root_id"), pre, post, feature)
    return found.join(out, "root_id", "left").withColumn("block_degree", F.coalesce("block_degree", F.lit(0)))


def cleaned_types(types: DataFrame, ids: DataFrame, leave: tuple[str, ...], key: str = "pt_root_id", system: str = "classification_system") -> DataFrame:
    """Annotations of known neurons: systems in ``leave`` go, missing ones stay, key 0 and every repeated key go."""
    rows = types.where(F.col(key) != 0)
    for value in leave:
        rows = rows.where(differs(F.col(system), value))
    return only_unique(rows, key).join(ids.select(F.col("root_id").alias(key)), key, "left_semi")
