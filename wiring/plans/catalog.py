"""The query catalogue: each operator over the fixture, beside the same question in plain SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiring.functions.binning import uniform_edges
from wiring.functions.numeric import numbers_in
from wiring.functions.ranges import running
from wiring.functions.scratch import scratch_path, written
from wiring.operators import features as ft
from wiring.operators import fit, geometry, graph, nullmodel
from wiring.operators import profiles as pr
from wiring.operators import stats as st
from wiring.sources import arrays, readers
from wiring.sources.fixture import SQL, Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LEVELS = ["MACHINERY", "BUILDING", "HOUSEHOLD", "AUTOMOBILE"]
TOP, HALF = 0.8212, 124.1607  # fixed values of the saturating model


def query(sql: str | None = None, ctes: str = ""):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = f"WITH {SQL}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def edge_array(edges: list[float]) -> str:
    return "([" + ", ".join(map(repr, edges)) + "]::DOUBLE[])"


def hist(edges: list[float], x: str) -> str:
    """SQL of a histogram bin."""
    last = len(edges) - 1
    return f"CASE WHEN {x} = {edges[-1]!r} THEN {last - 1} WHEN {x} >= {edges[0]!r} AND {x} < {edges[-1]!r} THEN CAST(len(list_filter({edge_array(edges)}, lambda e: e <= {x})) - 1 AS INTEGER) END"


def clamp(edges: list[float], x: str) -> str:
    return f"CAST(greatest(0, least({len(edges) - 2}, len(list_filter({edge_array(edges)}, lambda e: e <= {x})) - 1)) AS INTEGER)"


def mid(edges: list[float], k: str) -> str:
    return f"({edge_array(edges)}[{k} + 1] + {edge_array(edges)}[{k} + 2]) / 2"


PROFILE = uniform_edges(0, 1200, 41)
FINE = uniform_edges(0, 1200, 160)
TREND = uniform_edges(0, 10000, 11)

# --- features ---------------------------------------------------------------------------------

A2 = "SELECT {k} AS k, count(*) AS n, count(*) FILTER (tag = 'spine') AS s FROM fx_tagged GROUP BY 1"


@query("SELECT root_id, round(s::DOUBLE / n, 6) AS ratio, coalesce(n, 0) AS n_syn FROM fx_neurons LEFT JOIN a ON root_id = k", "a AS (" + A2.format(k="pre_id") + ")")
def spine_ratio_by_neuron(fx):
    return ft.spine_ratio(fx.tagged, fx.neurons).select("root_id", *r6("ratio"), "n_syn")


@query("SELECT root_id, round(s::DOUBLE / n, 6) AS ratio, coalesce(n, 0) AS n_syn, coalesce(d, 0) AS binary_degree FROM fx_neurons LEFT JOIN a ON root_id = pre_id",
       "a AS (SELECT pre_id, count(*) AS n, count(*) FILTER (tag = 'spine') AS s, count(DISTINCT post_id) AS d FROM fx_tagged WHERE pre_clf_type = 'E' AND post_clf_type = 'E' GROUP BY 1)")
def typed_spine_ratio(fx):
    return ft.typed_spine_ratio(fx.tagged, fx.neurons, "E", "E").select("root_id", *r6("ratio"), "n_syn", "binary_degree")


def _mart(fx):
    got = fx.tags_in.groupBy(F.col("post_pt_root_id").alias("root_id")).agg((F.count(F.lit(1)) + F.pmod(F.col("root_id"), F.lit(3))).alias("ds_num_of_incoming_synapses"))
    sent = fx.tags.groupBy(F.col("pre_pt_root_id").alias("root_id")).agg((F.count(F.lit(1)) + F.pmod(F.col("root_id"), F.lit(2))).alias("ds_num_of_outgoing_synapses"))
    return ft.spine_features(fx.neurons.join(got, "root_id", "left").join(sent, "root_id", "left"), fx.tagged, fx.tags_in, fx.tags)


TAGS = ("spine", "shaft", "soma")
MART = f"""loc AS (SELECT post_id, count(*) AS n, {", ".join(f"count(*) FILTER (tag = '{t}') AS {t}, count(*) FILTER (tag = '{t}' AND pre_clf_type = 'E') AS ex_{t}, count(*) FILTER (tag = '{t}' AND pre_clf_type = 'I') AS inh_{t}, count(DISTINCT pre_id) FILTER (tag = '{t}') AS {t}_neurons" for t in TAGS)},
  count(DISTINCT pre_id) FILTER (tag = 'spine' AND pre_clf_type = 'E') AS ex_spine_neurons, count(DISTINCT pre_id) FILTER (tag = 'spine' AND pre_clf_type = 'I') AS inh_spine_neurons FROM fx_tagged GROUP BY 1),
tin AS (SELECT post_pt_root_id AS id, count(*) AS n, {", ".join(f"count(*) FILTER (tag = '{t}') AS {t}" for t in TAGS)} FROM fx_tags_in GROUP BY 1),
tout AS (SELECT pre_pt_root_id AS id, count(*) AS n, {", ".join(f"count(*) FILTER (tag = '{t}') AS {t}" for t in TAGS)} FROM fx_tags GROUP BY 1),
mart AS (SELECT root_id, dendrite_length AS dl, axon_length AS al, l.n AS n, i.n AS ds_n, o.n AS ds_out_n, i.n + root_id % 3 AS ds_in_all, o.n + root_id % 2 AS ds_out_all,
  {", ".join(f"coalesce(l.{c}, 0) AS {c}" for c in [*(p + t for t in TAGS for p in ("", "ex_", "inh_")), *(t + "_neurons" for t in TAGS), "ex_spine_neurons", "inh_spine_neurons"])},
  {", ".join(f"coalesce(i.{t}, 0) AS ds_{t}, coalesce(o.{t}, 0) AS ds_out_{t}" for t in TAGS)}
  FROM fx_neurons LEFT JOIN loc l ON root_id = post_id LEFT JOIN tin i ON root_id = i.id LEFT JOIN tout o ON root_id = o.id)"""
MART_COUNTS = [*(p + t for t in TAGS for p in ("", "ex_", "inh_")), *(t + "_neurons" for t in TAGS), "ex_spine_neurons", "inh_spine_neurons", *(p + t for t in TAGS for p in ("ds_", "ds_out_"))]
#: Each ratio of the mart with its numerator and denominator.
MART_RATIOS = {
    "spine_ratio": ("spine", "n"), "ex_spine_share": ("ex_spine", "spine"),
    "ds_spine_ratio": ("ds_spine", "ds_n"), "ds_shaft_ratio": ("ds_shaft", "ds_n"), "ds_out_spine_ratio": ("ds_out_spine", "ds_out_n"), "ds_out_shaft_ratio": ("ds_out_shaft", "ds_out_n"),
    "spine_to_shaft": ("spine", "shaft + spine"), "ds_spine_to_shaft": ("ds_spine", "ds_shaft + ds_spine"), "spine_to_shaft_neurons": ("spine_neurons", "shaft_neurons + spine_neurons"),
    "spine_per_contact": ("spine", "spine_neurons"), "shaft_per_contact": ("shaft", "shaft_neurons"), "spine_density": ("spine", "dl"), "shaft_density": ("shaft", "dl"),
    "ds_spine_density": ("ds_spine", "dl"), "ds_shaft_density": ("ds_shaft", "dl"), "ds_out_spine_density": ("ds_out_spine", "al"), "ds_out_shaft_density": ("ds_out_shaft", "al"),
}


@query(f"""SELECT root_id, {", ".join(MART_COUNTS)}, {", ".join(f"round({a}::DOUBLE / nullif({b}, 0), 6) + 0.0 AS {name}" for name, (a, b) in MART_RATIOS.items())} FROM mart""", MART)
def spine_feature_mart(fx):
    return _mart(fx).select("root_id", *MART_COUNTS, *r6(*MART_RATIOS))


VALID = "root_id IN (SELECT root_id FROM mart WHERE dl > 0 AND al > 0 AND ds_n > 0 AND (ds_spine + ds_shaft + ds_soma)::DOUBLE / ds_in_all > 0.75)"


@query(f"SELECT root_id FROM mart WHERE {VALID}", MART)
def valid_neurons(fx):
    return ft.valid_neurons(_mart(fx), 0.75).select("root_id")


def typed_sums(side: str) -> str:
    """SQL of the synapses and neurons of each type on one side of edges."""
    return ", ".join(f"coalesce(sum(n_syn) FILTER ({side} = '{k}'), 0)::BIGINT AS {p}s, count(*) FILTER ({side} = '{k}') AS {p}n" for k, p in (("E", "e"), ("I", "in")))


VALID_NET = f"""{MART}, own AS (SELECT * FROM fx_edges WHERE {VALID.replace("root_id IN", "pre_id IN", 1)} AND {VALID.replace("root_id IN", "post_id IN", 1)}),
vi AS (SELECT post_id AS id, {typed_sums("pre_type")} FROM own GROUP BY 1), vo AS (SELECT pre_id AS id, {typed_sums("post_type")} FROM own GROUP BY 1)"""


@query(f"""SELECT root_id, coalesce(a.es + a.ins, 0) AS in_synapses, coalesce(a.en + a.inn, 0) AS in_neurons, coalesce(b.es + b.ins, 0) AS out_synapses, coalesce(b.en + b.inn, 0) AS out_neurons,
  CASE WHEN coalesce(a.es, 0) = 0 THEN 0.0 ELSE round(a.es::DOUBLE / a.en, 6) END AS ex_contacts, round(coalesce(a.ins, 0)::DOUBLE / nullif(dl, 0), 6) + 0.0 AS inh_syn_density
  FROM mart LEFT JOIN vi a ON root_id = a.id LEFT JOIN vo b ON root_id = b.id WHERE {VALID}""", VALID_NET)
def valid_network(fx):
    neurons, own = ft.valid_network(_mart(fx), fx.edges, 0.75)
    return neurons.select("root_id", "in_synapses", "in_neurons", "out_synapses", "out_neurons", *r6("ex_contacts", "inh_syn_density"))


@query(f"""SELECT (SELECT count(*) FROM mart WHERE {VALID}) AS n, count(*) AS wrong FROM (SELECT id, sum(s) AS s, sum(n) AS n FROM (SELECT post_id AS id, sum(n_syn) AS s, count(*) AS n FROM own GROUP BY 1
  UNION ALL SELECT id, -(es + ins), -(en + inn) FROM vi) GROUP BY 1 UNION ALL SELECT id, sum(s), sum(n) FROM (SELECT pre_id AS id, sum(n_syn) AS s, count(*) AS n FROM own GROUP BY 1 UNION ALL SELECT id, -(es + ins), -(en + inn) FROM vo) GROUP BY 1)
  WHERE s <> 0 OR n <> 0 OR id NOT IN (SELECT root_id FROM mart WHERE {VALID})""", VALID_NET)
def valid_network_checked(fx):
    """The neurons of the valid network, and how many of them have degrees that differ from the edges' sums."""
    neurons, own = ft.valid_network(_mart(fx), fx.edges, 0.75)
    found = neurons.agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(ft.inconsistent(neurons, own).agg(F.count(F.lit(1)).alias("wrong"))))  # one row each


DEG = """pre AS (SELECT post_id AS id, sum(n_syn)::BIGINT AS s, count(*) AS n, coalesce(sum(n_syn) FILTER (pre_type = 'E'), 0)::BIGINT AS es, count(*) FILTER (pre_type = 'E') AS en,
  coalesce(sum(n_syn) FILTER (pre_type = 'I'), 0)::BIGINT AS ins, count(*) FILTER (pre_type = 'I') AS inn FROM fx_edges GROUP BY 1),
post AS (SELECT pre_id AS id, sum(n_syn)::BIGINT AS s, count(*) AS n, coalesce(sum(n_syn) FILTER (post_type = 'E'), 0)::BIGINT AS es, count(*) FILTER (post_type = 'E') AS en,
  coalesce(sum(n_syn) FILTER (post_type = 'I'), 0)::BIGINT AS ins, count(*) FILTER (post_type = 'I') AS inn FROM fx_edges GROUP BY 1)"""


NINE = ", ".join(
    f"round(coalesce(a.{s}, 0)::DOUBLE / nullif(dendrite_length, 0), 6) + 0.0 AS {p}syn_density, round(coalesce(a.{n}, 0)::DOUBLE / nullif(dendrite_length, 0), 6) + 0.0 AS {p}partner_density, CASE WHEN coalesce(a.{s}, 0) = 0 THEN 0.0 ELSE round(a.{s}::DOUBLE / a.{n}, 6) END AS {p}contacts"
    for s, n, p in (("s", "n", ""), ("es", "en", "ex_"), ("ins", "inn", "inh_")))


@query("""SELECT root_id, coalesce(a.s, 0) AS in_synapses, coalesce(a.n, 0) AS in_neurons, coalesce(a.es, 0) AS ex_in_synapses, coalesce(a.en, 0) AS ex_in_neurons, coalesce(a.ins, 0) AS inh_in_synapses,
  coalesce(a.inn, 0) AS inh_in_neurons, coalesce(b.s, 0) AS out_synapses, coalesce(b.n, 0) AS out_neurons, coalesce(b.es, 0) AS ex_out_synapses, coalesce(b.en, 0) AS ex_out_neurons,
  coalesce(b.ins, 0) AS inh_out_synapses, coalesce(b.inn, 0) AS inh_out_neurons, """ + NINE + """
  FROM fx_neurons LEFT JOIN pre a ON root_id = a.id LEFT JOIN post b ON root_id = b.id""", DEG)
def degree_features(fx):
    deg = ft.contact_features(graph.degrees(fx.edges, fx.neurons.select("root_id", "dendrite_length")))
    names = [f"{p}{d}_{w}" for d in ("in", "out") for p in ("", "ex_", "inh_") for w in ("synapses", "neurons")]
    return deg.select("root_id", *names, *r6(*[f"{p}{n}" for p in ("", "ex_", "inh_") for n in ("syn_density", "partner_density", "contacts")]))


@query("""SELECT root_id, round(coalesce(a.es, 0)::DOUBLE / nullif(a.ins, 0), 6) AS ei_synapses, round(a.en::DOUBLE / nullif(a.inn, 0), 6) AS ei_neurons,
  round(ew::DOUBLE / nullif(iw, 0), 6) AS ei_weight, round(a.es::DOUBLE / nullif(a.es + a.ins, 0), 6) AS ex_share, round(ew::DOUBLE / nullif(ew + iw, 0), 6) AS ex_weight_share,
  round(a.en::DOUBLE / nullif(a.en + a.inn, 0), 6) AS ex_partner_share, round(a.s::DOUBLE / nullif(ds_in_all, 0), 6) AS in_volume_share, round(ds_in_all::DOUBLE / nullif(dl, 0), 6) AS ds_in_density,
  round(a.s::DOUBLE / a.n, 6) AS syn_per_contact, round(ds_out_all::DOUBLE / nullif(al, 0), 6) AS ds_out_density FROM mart JOIN pre a ON root_id = a.id
  JOIN (SELECT post_id, coalesce(sum(size) FILTER (pre_clf_type = 'E'), 0) AS ew, coalesce(sum(size) FILTER (pre_clf_type = 'I'), 0) AS iw FROM fx_tagged GROUP BY 1) w ON root_id = w.post_id""", MART + ", " + DEG)
def ei_ratio_features(fx):
    t = F.col("pre_clf_type")
    weight = fx.tagged.groupBy(F.col("post_id").alias("root_id")).agg(*[F.coalesce(F.sum(F.when(t == k, F.col("size"))), F.lit(0.0)).alias(f"{n}_in_weight") for k, n in (("E", "ex"), ("I", "inh"))])
    ids = _mart(fx).select("root_id", "dendrite_length", "axon_length", "ds_num_of_incoming_synapses", "ds_num_of_outgoing_synapses")
    deg = ft.volume_features(graph.degrees(fx.edges, ids).where("in_synapses > 0").join(weight, "root_id"))
    return ft.type_ratios(deg).select("root_id", *r6("ei_synapses", "ei_neurons", "ei_weight", "ex_share", "ex_weight_share", "ex_partner_share", "in_volume_share", "ds_in_density", "syn_per_contact", "ds_out_density"))


# --- graph ------------------------------------------------------------------------------------


@query("SELECT pre_id, post_id, n_syn FROM fx_edges WHERE pre_id % 2 = 0 AND post_id % 2 = 0")
def induced_edges(fx):
    return graph.induced(fx.edges, fx.neurons.where("root_id % 2 = 0")).select("pre_id", "post_id", "n_syn")


@query("SELECT pre_type || post_type AS block, count(*) AS pairs, sum(n_syn)::BIGINT AS synapses FROM fx_edges GROUP BY 1")
def ei_blocks(fx):
    return graph.blocks(fx.edges).groupBy("block").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_syn").alias("synapses"))


@query("SELECT post_id AS root_id, round(avg(d), 6) AS shared_input FROM fx_edges JOIN (SELECT pre_id, count(*) AS d FROM fx_edges GROUP BY 1) USING (pre_id) GROUP BY 1")
def shared_input_full(fx):
    return graph.shared_input(fx.edges).select("root_id", *r6("shared_input"))


@query("SELECT e.pre_type || e.post_type AS block, post_id AS root_id, round(avg(d), 6) AS shared_input FROM fx_edges e JOIN (SELECT pre_id, pre_type || post_type AS block, count(*) AS d FROM fx_edges GROUP BY ALL) o ON e.pre_id = o.pre_id AND e.pre_type || e.post_type = o.block GROUP BY ALL")
def shared_input_block(fx):
    return graph.shared_input(graph.blocks(fx.edges), ("block",)).select("block", "root_id", *r6("shared_input"))


@query("SELECT pre_id AS root_id, pre_type AS clf_type, n_syn FROM fx_edges WHERE post_id = 10")
def partners(fx):
    return graph.partners(fx.edges, 10)


#: A block of the matrix: neurons whose inputs are pooled, so that any two share some at every scale.
@query("SELECT pre_type AS clf_type, count(*) AS n_shared FROM (SELECT pre_id, pre_type FROM pool WHERE post_id = 0 INTERSECT SELECT pre_id, pre_type FROM pool WHERE post_id = 1) GROUP BY 1",
       "pool AS (SELECT pre_id, pre_type, post_id % 10 AS post_id FROM fx_edges)")
def shared_partners(fx):
    return graph.shared_partners(fx.edges.withColumn("post_id", F.col("post_id") % 10), 0, 1)


@query("SELECT post_id AS root_id, count(*) FILTER (pre_type = 'E') AS n_ex, count(*) FILTER (pre_type = 'I') AS n_inh, min(pre_id) FILTER (pre_type = 'E') AS first_ex FROM fx_edges GROUP BY 1")
def input_sets(fx):
    s = graph.input_sets(fx.edges)
    return s.select("root_id", F.size("ex_inputs").cast("long").alias("n_ex"), F.size("inh_inputs").cast("long").alias("n_inh"), F.get("ex_inputs", F.lit(0)).alias("first_ex"))


@query("SELECT root_id, row_number() OVER (ORDER BY root_id) - 1 AS matrix_idx FROM fx_neurons WHERE dendrite_length > 0")
def matrix_index(fx):
    return graph.matrix_index(fx.neurons.where("dendrite_length > 0"))


# --- joins, filters, functions ----------------------------------------------------------------


@query("SELECT root_id, cell_type FROM fx_neurons WHERE root_id % 50 <> 0")
def dedup_all(fx):
    rows = fx.neurons.select("root_id", "cell_type")
    return ft.only_unique(rows.unionByName(rows.where("root_id % 50 = 0")), "root_id")


@query("SELECT root_id, clf_type FROM fx_neurons WHERE cell_type = 'BUILDING'")
def proofread_semi(fx):
    status = fx.neurons.select(F.col("root_id").alias("pt_root_id"), F.when(F.col("cell_type") == "BUILDING", "axon_fully_extended").when(F.col("cell_type") == "FURNITURE", "axon_partially_extended").alias("strategy_axon"))
    keep = status.where("strategy_axon = 'axon_fully_extended'")
    return fx.neurons.join(keep, F.col("root_id") == F.col("pt_root_id"), "left_semi").select("root_id", "clf_type")


@query("SELECT root_id, cell_type FROM fx_neurons WHERE cell_type IS NULL OR cell_type NOT IN ('MACHINERY', 'BUILDING')")
def exclude_types(fx):
    return fx.neurons.where(~F.coalesce(F.col("cell_type").isin("MACHINERY", "BUILDING"), F.lit(False))).select("root_id", "cell_type")


@query("SELECT root_id, round(x, 6) AS x, round(y, 6) AS y FROM fx_neurons WHERE x BETWEEN 3 AND 12 AND y BETWEEN 0 AND 500")
def box_filter(fx):
    return fx.neurons.where(geometry.in_box("x", "y", (3, 12), (0, 500))).select("root_id", *r6("x", "y"))


@query("SELECT event_id, len(regexp_extract_all(props, '(-?\\d+(?:\\.\\d+)?)', 1)) AS n, CAST(regexp_extract_all(props, '(-?\\d+(?:\\.\\d+)?)', 1)[1] AS DOUBLE) AS first FROM events")
def parse_position(fx):
    p = fx.table("events").select("event_id", numbers_in(F.col("props")).alias("p"))
    return p.select("event_id", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0)).alias("first"))


@query("SELECT root_id, round((dendrite_length - lo) / (hi - lo) * 90 + 10, 6) AS size FROM fx_neurons, (SELECT min(dendrite_length) AS lo, max(dendrite_length) AS hi FROM fx_neurons)")
def minmax_scale(fx):
    return ft.min_max_scaled(fx.neurons, "dendrite_length", 10, 100, "size").select("root_id", *r6("size"))


@query("SELECT root_id, nullif(coalesce(list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'AUTOMOBILE'], cell_type), 0), 0)::BIGINT AS place, row_number() OVER (PARTITION BY cell_type ORDER BY root_id) AS rank FROM fx_neurons")
def category_order(fx):
    return ft.ranked_by_category(fx.neurons, "cell_type", LEVELS, "root_id").select("root_id", F.col("place").cast("long").alias("place"), "rank")


# --- profiles ---------------------------------------------------------------------------------

E_TAGGED = "t AS (SELECT *, {b} AS bin FROM fx_tagged WHERE pre_clf_type = 'E')"


def _e(fx):
    return fx.tagged.where("pre_clf_type = 'E'")


@query(f"SELECT bin, round({mid(PROFILE, 'bin')}, 6) AS centre, n, round(p, 6) AS share, round(sqrt(p * (1 - p)), 6) AS sd, round(sqrt(p * (1 - p) / n), 6) AS sem FROM (SELECT bin, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS p FROM t WHERE bin IS NOT NULL GROUP BY 1)", E_TAGGED.format(b=hist(PROFILE, "dist")))
def micro_profile(fx):
    return pr.micro_profile(_e(fx), PROFILE).select("bin", *r6("centre"), "n", *r6("share", "sd", "sem"))


BYN = E_TAGGED.format(b=hist(PROFILE, "dist")) + ", m AS (SELECT pre_id, bin, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share FROM t WHERE bin IS NOT NULL GROUP BY ALL)"


@query(f"SELECT bin, round({mid(PROFILE, 'bin')}, 6) AS centre, count(*) AS n_neurons, sum(n)::BIGINT AS n, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS sd, round(stddev_pop(share) / sqrt(count(*)), 6) AS sem FROM m GROUP BY 1", BYN)
def macro_profile(fx):
    return pr.macro_profile(_e(fx), PROFILE).select("bin", *r6("centre"), "n_neurons", "n", *r6("mean", "sd", "sem"))


@query("SELECT bin, n, round(share, 6) AS share FROM m WHERE pre_id = 10 AND n > 1", BYN)
def single_profile(fx):
    return pr.micro_profile(_e(fx).where("pre_id = 10"), PROFILE, least=1).select("bin", "n", *r6("share"))


CROSS = BYN + f""", c AS (SELECT pre_id, bin, share, {mid(PROFILE, 'bin')} AS x, lag({mid(PROFILE, 'bin')}) OVER w AS x0, lag(share) OVER w AS y0 FROM m WINDOW w AS (PARTITION BY pre_id ORDER BY bin)),
f AS (SELECT pre_id, arg_min(CASE WHEN y0 IS NULL THEN 0.0 ELSE x0 + (0.5 - y0) / (share - y0 + 1e-9) * (x - x0) END, bin) FILTER (share > 0.5) AS v FROM c GROUP BY 1)"""


@query("SELECT pre_id AS root_id, round(v, 4) AS crossing, v IS NULL AS never FROM f", CROSS)
def crossing_by_neuron(fx):
    c = pr.crossings(pr.by_neuron(_e(fx), PROFILE), PROFILE, "pre_id", "zero")
    never = F.col("crossing") == float("inf")
    return c.select(F.col("pre_id").alias("root_id"), F.when(~never, F.round("crossing", 4)).alias("crossing"), never.alias("never"))


@query("SELECT count(*) AS n, round(count(*) FILTER (v = 0) / count(*), 6) AS at_zero, round(count(*) FILTER (v IS NULL) / count(*), 6) AS at_infinity FROM f", CROSS)
def zero_inf_share(fx):
    return st.end_shares(pr.crossings(pr.by_neuron(_e(fx), PROFILE), PROFILE, "pre_id", "zero"), "crossing").select("n", *r6("at_zero", "at_infinity"))


@query("SELECT series, round(coalesce(arg_min(CASE WHEN y0 IS NULL THEN x ELSE x0 + (0.3 - y0) / (y - y0 + 1e-9) * (x - x0) END, bin) FILTER (y > 0.3), -1), 4) AS crossing FROM p GROUP BY 1",
       f"q0 AS (SELECT pre_clf_type AS series, {hist(PROFILE, 'dist')} AS bin, tag FROM fx_tagged), q AS (SELECT series, bin, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS y FROM q0 GROUP BY ALL), p AS (SELECT series, bin, y, {mid(PROFILE, 'bin')} AS x, lag(y) OVER w AS y0, lag({mid(PROFILE, 'bin')}) OVER w AS x0 FROM q WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY bin))")
def crossing_population(fx):
    rows = pr.by_neuron(fx.tagged, PROFILE, key="pre_clf_type")
    c = pr.crossings(rows, PROFILE, "pre_clf_type", "centre", 0.3)
    return c.select(F.col("pre_clf_type").alias("series"), F.round(F.when(F.col("crossing") == float("inf"), -1.0).otherwise(F.col("crossing")), 4).alias("crossing"))


TR = f"d AS (SELECT dendrite_length AS x, {clamp(TREND, 'dendrite_length')} AS bin, a.s::DOUBLE AS y FROM fx_neurons JOIN pre a ON root_id = a.id)"


@query(f"SELECT bin, round({mid(TREND, 'bin')}, 6) AS centre, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y), 0) / sqrt(count(*)), 6) AS error, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2", DEG + ", " + TR)
def binned_trend(fx):
    deg = graph.degrees(fx.edges, fx.neurons.select("root_id", "dendrite_length")).where("in_synapses > 0")
    return pr.binned_trend(deg.withColumn("in_synapses", F.col("in_synapses").cast("double")), "dendrite_length", "in_synapses", TREND, "sem", 2).select("bin", *r6("centre", "mean", "error"), "n")


@query("SELECT series, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY series), 6) AS share FROM h", f"h0 AS (SELECT pre_clf_type || '-' || tag AS series, {hist(PROFILE, 'dist')} AS bin FROM fx_tagged), h AS (SELECT series, bin, count(*) AS n FROM h0 WHERE bin IS NOT NULL GROUP BY ALL)")
def tag_histogram(fx):
    return pr.shares(fx.tagged.withColumn("series", F.concat_ws("-", "pre_clf_type", "tag")), "dist", PROFILE, ("series",)).select("series", "bin", "n", *r6("share"))


# --- statistics -------------------------------------------------------------------------------

DEGREES = "g AS (SELECT root_id, clf_type, dendrite_length AS dl, coalesce(a.s, 0)::DOUBLE AS ins, coalesce(a.n, 0)::DOUBLE AS inn, coalesce(b.s, 0)::DOUBLE AS outs FROM fx_neurons LEFT JOIN pre a ON root_id = a.id LEFT JOIN post b ON root_id = b.id)"


def _g(fx):
    d = graph.degrees(fx.edges, fx.neurons.select("root_id", "clf_type", "dendrite_length"))
    return d.select("root_id", "clf_type", F.col("dendrite_length").alias("dl"), F.col("in_synapses").cast("double").alias("ins"), F.col("in_neurons").cast("double").alias("inn"), F.col("out_synapses").cast("double").alias("outs"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS r FROM g" for a, b in (("ins", "dl"), ("inn", "dl"), ("inn", "ins"), ("outs", "dl"), ("outs", "ins"), ("outs", "inn"))), DEG + ", " + DEGREES)
def corr_matrix(fx):
    return st.correlations(_g(fx), ["dl", "ins", "inn", "outs"]).select("first", "second", *r6("r"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature, round(corr({a}, dl), 6) AS r FROM g" for a in ("ins", "inn", "outs")), DEG + ", " + DEGREES)
def corr_with_target(fx):
    return st.correlations_with(_g(fx), "dl", ["ins", "inn", "outs"]).select("feature", *r6("r"))


@query("SELECT clf_type, count(*) AS n, round(corr(dl, ins), 6) AS r, round(regr_slope(ins, dl), 6) AS slope, round(regr_intercept(ins, dl), 6) AS intercept, round(regr_r2(ins, dl), 6) AS r2 FROM g GROUP BY 1", DEG + ", " + DEGREES)
def pearson_regression(fx):
    return st.regression(_g(fx), "dl", "ins", ("clf_type",)).select("clf_type", "n", *r6("r", "slope", "intercept", "r2"))


@query("SELECT clf_type, count(*) AS n, round(regr_slope(ins, ln(dl + 1)), 5) AS a, round(regr_intercept(ins, ln(dl + 1)), 5) AS b FROM g WHERE dl > 0 GROUP BY 1", DEG + ", " + DEGREES)
def log_curve(fx):
    return st.log_curve(_g(fx), "dl", "ins", ("clf_type",)).select("clf_type", "n", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@query("SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0 AS rx, rank() OVER (ORDER BY ins) + (count(*) OVER (PARTITION BY ins) - 1) / 2.0 AS ry FROM g)", DEG + ", " + DEGREES)
def spearman(fx):
    return st.spearman(_g(fx), "dl", "ins").select("n", *r6("rho"))


@query("SELECT clf_type, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(a), 6) AS mean, min(ins) FILTER (ins BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(ins) FILTER (ins BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (ins NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS beyond FROM g JOIN (SELECT clf_type, quantile_cont(ins, 0.25) AS q1, quantile_cont(ins, 0.5) AS m, quantile_cont(ins, 0.75) AS q3, avg(ins) AS a FROM g GROUP BY 1) USING (clf_type) GROUP BY 1", DEG + ", " + DEGREES)
def box_stats(fx):
    return st.box(_g(fx), "ins", "clf_type").select("clf_type", *r6("q1", "median", "q3", "mean"), "low", "high", "beyond")


GRID = [250.0 * k for k in range(41)]


@query(f"SELECT cell_type, x, round(sum(exp(-((x - v) / 400) * ((x - v) / 400) / 2)) / (count(*) * 400 * sqrt(2 * pi())), 8) AS density FROM (SELECT cell_type, dendrite_length AS v FROM fx_neurons), (SELECT unnest({edge_array(GRID)}) AS x) GROUP BY ALL")
def kde_by_type(fx):
    return st.density(fx.neurons, "dendrite_length", "cell_type", GRID, 400.0).select("cell_type", "x", F.round("density", 8).alias("density"))


@query(f"SELECT pre_id AS root_id, round(avg({TOP} * dist / (dist + {HALF})), 6) AS predicted FROM fx_synapses GROUP BY 1")
def predicted_ratio(fx):
    return st.saturating_mean(fx.synapses, "dist", "pre_id", TOP, HALF).select(F.col("pre_id").alias("root_id"), *r6("predicted"))


# --- null models ------------------------------------------------------------------------------

REPLICAS = 100  # shuffled graphs behind a control distribution
NULL = """rep AS (SELECT unnest(range(3)) AS replica), s AS (SELECT replica, pre_id, post_id, pre_type, post_type, pre_type || post_type AS block, pre_id || '-' || post_id AS edge FROM fx_edges, rep),
o AS (SELECT *, row_number() OVER (PARTITION BY replica, block ORDER BY md5('7-' || replica || '-pre-' || edge), edge) AS a, row_number() OVER (PARTITION BY replica, block ORDER BY md5('7-' || replica || '-post-' || edge), edge) AS b FROM s),
z AS (SELECT p.replica, p.block, p.pre_id, q.post_id, count(*) AS n_syn FROM o p JOIN o q ON p.replica = q.replica AND p.block = q.block AND p.a = q.b WHERE p.pre_id <> q.post_id GROUP BY ALL)"""


@query("SELECT replica, block, pre_id, post_id, n_syn FROM z", NULL)
def config_model(fx):
    return nullmodel.shuffled(fx.edges, 3, 7).select("replica", "block", "pre_id", "post_id", "n_syn")


NSH = NULL + ", u AS (SELECT DISTINCT replica, pre_id, post_id FROM z), v AS (SELECT replica, post_id AS root_id, avg(d) AS shared_input FROM u JOIN (SELECT replica, pre_id, count(*) AS d FROM u GROUP BY ALL) USING (replica, pre_id) GROUP BY ALL)"


@query("SELECT replica, root_id, round(shared_input, 6) AS shared_input FROM v", NSH)
def null_shared_input(fx):
    return nullmodel.null_shared_input(fx.edges, 3, 7).select("replica", "root_id", *r6("shared_input"))


SHARED = uniform_edges(0, 80, 17)


@query("SELECT series, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY series), 6) AS share FROM h", NSH.replace("range(3)", f"range({REPLICAS})") + f""", both_ AS (SELECT 'control' AS series, shared_input AS x FROM v UNION ALL
  SELECT 'data', avg(d) FROM fx_edges JOIN (SELECT pre_id, count(*) AS d FROM fx_edges GROUP BY 1) USING (pre_id) GROUP BY post_id), h0 AS (SELECT series, {hist(SHARED, 'x')} AS bin FROM both_), h AS (SELECT series, bin, count(*) AS n FROM h0 WHERE bin IS NOT NULL GROUP BY ALL)""")
def null_vs_data_hist(fx):
    control = nullmodel.null_shared_input(fx.edges, REPLICAS, 7).select(F.lit("control").alias("series"), "shared_input")
    data = graph.shared_input(fx.edges).select(F.lit("data").alias("series"), "shared_input")
    return pr.shares(control.unionByName(data), "shared_input", SHARED, ("series",)).select("series", "bin", "n", *r6("share"))


# --- geometry and sweeps ----------------------------------------------------------------------


def _chain(fx):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = fx.table("events").select("user_id", "event_id", "ts", "value", F.hour("ts").cast("double").alias("h"))
    return rows.select(F.col("user_id").alias("root_id"), (F.row_number().over(w) - 1).alias("vid"), (F.row_number().over(w) - 2).alias("parent"),
                       F.col("value").alias("x"), F.col("h").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"), F.lit(1.0).alias("radius"), (F.col("event_id") % 4 + 1).cast("int").alias("compartment"))


@query("SELECT root_id, round(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz))), 4) AS length FROM k WHERE px IS NOT NULL GROUP BY 1",
       "e AS (SELECT user_id AS root_id, ts, event_id, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events), k AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM e WINDOW w AS (PARTITION BY root_id ORDER BY ts, event_id))")
def path_length(fx):
    return geometry.path_length(_chain(fx)).select("root_id", F.round("length", 4).alias("length"))


@query("SELECT m.vec_id AS vid, arg_min(s.vec_id, (d, s.vec_id)) AS site_id FROM (SELECT a.vec_id, a.x, a.y, a.z FROM pt a WHERE vec_id % 2 = 0) m, LATERAL (SELECT b.vec_id, pow(m.x - b.x, 2) + pow(m.y - b.y, 2) + pow(m.z - b.z, 2) AS d FROM pt b WHERE b.vec_id % 2 = 1) s GROUP BY 1",
       "pt AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)")
def nearest_vertex(fx):
    e = fx.table("embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    mesh = e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "vid")
    return geometry.nearest(mesh, e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "site_id")).select("vid", "site_id")


@query(" UNION ALL ".join(f"SELECT {k} AS network, count(*) AS n, round(avg(v), 6) AS mean_shared FROM (SELECT post_id, avg(d) AS v FROM w{k} JOIN (SELECT pre_id, count(*) AS d FROM w{k} GROUP BY 1) USING (pre_id) GROUP BY 1)" for k in (1, 2, 4, 8, 16)),
       ", ".join(f"w{k} AS (SELECT * FROM fx_edges WHERE pre_id % {k} = 0 AND post_id % {k} = 0)" for k in (1, 2, 4, 8, 16)))
def subnetwork_sweep(fx):
    nets = fx.edges.withColumn("network", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16))))).where("pre_id % network = 0 AND post_id % network = 0")
    nets = nets.repartition(fx.parts, "network", "pre_id")  # counted where they lie, in as many tasks as the synapses
    return graph.shared_input(nets, ("network",)).groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("shared_input"), 6).alias("mean_shared"))


def fit_sql(rows: str, key: str) -> str:
    """SQL of saturating fits to ``rows`` (key, d, y, w): a grid over the logarithm of ``half``, twice refined around the best; ``top`` in closed form."""
    parts = [f"sr AS MATERIALIZED ({rows})", f"sb AS (SELECT {key}, count(*) AS n, ln(1e-5) AS lo, ln(greatest(10 * max(d), 1, 1000 * sum(w * d * d) / nullif(sum(w * d * y), 0))) AS hi FROM sr GROUP BY 1)"]
    for level, steps in enumerate((1200, 200, 200)):
        grid = f"SELECT {key}, lo, hi, lo + (hi - lo) * k / {steps} AS h FROM sb{level or ''}, (SELECT unnest(range({steps} + 1)) AS k)"
        sums = f"SELECT {key}, lo, hi, h, sum(w * y * y) AS yy, sum(w * y * d / (d + exp(h))) AS fy, sum(w * d * d / (d + exp(h)) / (d + exp(h))) AS ff FROM ({grid}) JOIN sr USING ({key}) GROUP BY ALL"
        best = f"SELECT {key}, lo, hi, arg_min(h, (loss, h)) AS h FROM (SELECT *, least(1, greatest(0, fy / ff)) AS top, yy - 2 * top * fy + top * top * ff AS loss FROM ({sums})) GROUP BY ALL"
        parts.append(f"sb{level + 1} AS MATERIALIZED (SELECT {key}, h, greatest(lo, h - (hi - lo) / {steps}) AS lo, least(hi, h + (hi - lo) / {steps}) AS hi FROM ({best}))")
    parts.append(f"st AS (SELECT {key}, exp(h) AS half, least(1, greatest(0, sum(w * y * d / (d + exp(h))) / sum(w * d * d / (d + exp(h)) / (d + exp(h))))) AS top, sum(w * y) / sum(w) AS mean FROM sb3 JOIN sr USING ({key}) GROUP BY {key}, h)")
    parts.append(f"fitted AS (SELECT {key}, top, half, avg(w * (y - top * d / (d + half)) * (y - top * d / (d + half))) AS w_mse, 1 - sum(w * (y - top * d / (d + half)) * (y - top * d / (d + half))) / nullif(sum(w * (y - mean) * (y - mean)), 0) AS r2, count(*) AS n FROM st JOIN sr USING ({key}) GROUP BY ALL)")
    return ", ".join(parts)


POPULATION = f"SELECT 'population' AS model, {mid(PROFILE, 'bin')} AS d, avg(share) AS y, sum(n)::DOUBLE AS w FROM (SELECT pre_id, bin, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share FROM (SELECT *, {hist(PROFILE, 'dist')} AS bin FROM fx_tagged) WHERE bin IS NOT NULL GROUP BY ALL) GROUP BY bin"


@query("SELECT model, round(top, 4) AS top, round(half, 2) AS half, round(w_mse, 6) AS w_mse, round(r2, 5) AS r2 FROM fitted", fit_sql(POPULATION, "model"))
def saturating_fit(fx):
    return fit.fit_population(fx.tagged, PROFILE).select("model", F.round("top", 4).alias("top"), F.round("half", 2).alias("half"), *r6("w_mse"), F.round("r2", 5).alias("r2"))


@query()
def biphasic_fit(fx):
    return fit.fit_population(fx.tagged, PROFILE, "biphasic")


@query("SELECT pre_id, n >= 2 AS fitted, round(CASE WHEN n >= 2 THEN w_mse END, 6) AS w_mse, round(CASE WHEN n >= 2 THEN top * 600 / (600 + half) END, 4) AS middle FROM fitted",
       BYN + ", " + fit_sql(f"SELECT pre_id, {mid(PROFILE, 'bin')} AS d, share AS y, n::DOUBLE AS w FROM m WHERE n > 1", "pre_id"))
def single_fits(fx):
    """A saturating fit for every neuron, over its bins with more than one synapse: its error and its share at 600."""
    rows = fit.fit_single(_e(fx), PROFILE, least=1)
    return rows.select("pre_id", F.col("top").isNotNull().alias("fitted"), *r6("w_mse"), F.round(F.col("top") * 600 / (600 + F.col("half")), 4).alias("middle"))


#: Parameters that neurons are given by their ids: some halve far beyond the greatest distance.
KNOWN_HALF = [0.5, 20.0, 150.0, 1000.0, 30000.0]


@query(f"SELECT pre_id, round(0.5 + pre_id % 5 / 10.0, 3) AS top, round(log10({edge_array(KNOWN_HALF)}[1 + pre_id // 5 % 5]), 3) AS log_half FROM m GROUP BY pre_id HAVING count(*) > 2", BYN)
def saturating_recovery(fx):
    """Fits to exact curves over the bins and weights of each neuron's synapses give back the curves' parameters."""
    from wiring.functions.binning import centre

    top = F.lit(0.5) + F.pmod(F.col("pre_id"), F.lit(5)) / 10
    half = F.get(F.array(*map(F.lit, KNOWN_HALF)), F.pmod(F.floor(F.col("pre_id") / 5), F.lit(5)).cast("int"))
    rows = pr.by_neuron(_e(fx), PROFILE).withColumn("centre", centre(PROFILE, F.col("bin")))
    rows = rows.withColumn("share", top * F.col("centre") / (F.col("centre") + half))
    found = fit.fits(rows, ["pre_id"], "centre", "share", "n").join(rows.groupBy("pre_id").agg(F.count(F.lit(1)).alias("bins")).where("bins > 2"), "pre_id")
    return found.select("pre_id", F.round("top", 3).alias("top"), F.round(F.log10("half"), 3).alias("log_half"))


#: The profile that the population fits take: the mean over neurons, with the synapses of all as weights.
@query("SELECT bin, n, round(mean, 6) AS mean FROM (SELECT bin, sum(n)::BIGINT AS n, avg(share) AS mean FROM (SELECT pre_id, bin, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share FROM fb WHERE bin IS NOT NULL GROUP BY ALL) GROUP BY 1)",
       f"fb AS (SELECT *, {hist(FINE, 'dist')} AS bin FROM fx_tagged)")
def population_profile(fx):
    return pr.macro_profile(fx.tagged, FINE).select("bin", "n", *r6("mean"))


def with_p(rows: str, r: str = "r") -> str:
    """SQL of ``rows`` with p and stars: the two-sided tail of r's density, (1 - r²)^((n - 4) / 2), by Simpson's rule over the angle whose sine is r."""
    steps = 20000
    term = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"""pq AS MATERIALIZED ({rows}),
pw AS (SELECT pq.*, asin(abs({r})) AS a, k FROM pq, (SELECT unnest(range({steps} + 1)) AS k)),
px AS (SELECT * EXCLUDE (k, a), any_value(pi() / 2 - a) * sum({term} * pow(cos(a + k * (pi() / 2 - a) / {steps}), n - 3)) / (pi() / 2 * sum({term} * pow(cos(k * pi() / 2 / {steps}), n - 3))) AS p FROM pw GROUP BY ALL),
withp AS (SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM px)"""


LINES = "SELECT clf_type, count(*) AS n, corr(dl, ins) AS r, regr_slope(ins, dl) AS slope, regr_intercept(ins, dl) AS intercept, regr_r2(ins, dl) AS r2, min(dl) AS x_min, max(dl) AS x_max FROM g GROUP BY 1"


@query("SELECT clf_type, n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, x_min, x_max, round(slope * x_min + intercept, 5) AS y_min, round(slope * x_max + intercept, 5) AS y_max, round(p, 6) AS p, stars FROM withp",
       DEG + ", " + DEGREES + ", " + with_p(LINES))
def regression_with_p(fx):
    rows = st.regression(_g(fx), "dl", "ins", ("clf_type",), with_p=True)
    return rows.select("clf_type", "n", *r6("r", "slope", "intercept", "r2"), "x_min", "x_max", F.round("y_min", 5).alias("y_min"), F.round("y_max", 5).alias("y_max"), *r6("p"), "stars")


@query("SELECT user_id AS root_id, 0::BIGINT AS line, array_to_string(range(count(*)), ',') AS vids FROM events GROUP BY 1 HAVING count(*) > 1")
def polylines(fx):
    """Skeletons without a branch are one line each; branches and cycles are in the tests."""
    return geometry.polylines(_chain(fx)).select("root_id", "line", F.array_join(F.col("vids").cast("array<string>"), ",").alias("vids"))


MESH = """me AS (SELECT user_id AS seg_id, row_number() OVER w - 1 AS vid, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, lag(value) OVER w AS x1, lag(hour(ts)::DOUBLE) OVER w AS y1, lag((event_id % 7)::DOUBLE) OVER w AS z1,
  lag(value, 2) OVER w AS x0, lag(hour(ts)::DOUBLE, 2) OVER w AS y0, lag((event_id % 7)::DOUBLE, 2) OVER w AS z0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
cr AS (SELECT seg_id, vid AS fid, (y1 - y0) * (z - z0) - (z1 - z0) * (y - y0) AS nx, (z1 - z0) * (x - x0) - (x1 - x0) * (z - z0) AS ny, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) AS nz FROM me WHERE vid >= 2)"""


@query("SELECT seg_id, fid, round(0.3 + 0.7 * CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN 0.0 ELSE greatest(0.0, (nx * 0.3 + ny * 0.5 + nz) / sqrt(0.3 * 0.3 + 0.5 * 0.5 + 1.0) / sqrt(nx * nx + ny * ny + nz * nz)) END, 6) AS shade FROM cr", MESH)
def mesh_shading(fx):
    v = _chain(fx).select(F.col("root_id").alias("seg_id"), "vid", "x", "y", "z")
    faces = v.where("vid >= 2").select("seg_id", F.col("vid").cast("long").alias("fid"), (F.col("vid") - 2).alias("v0"), (F.col("vid") - 1).alias("v1"), F.col("vid").alias("v2"))
    return geometry.shading(geometry.triangles(faces, v)).select("seg_id", "fid", *r6("shade"))


@query(" UNION ALL ".join(f"SELECT '{y}' AS series, bin, round(avg({y}), 6) AS mean, round(coalesce(stddev_samp({y}), 0), 6) AS error, count(*) AS n FROM gb GROUP BY bin" for y in ("ins", "inn", "outs")),
       DEG + ", " + DEGREES + f", gb AS (SELECT *, {clamp(TREND, 'dl')} AS bin FROM g)")
def binned_trends(fx):
    return pr.binned_trends(_g(fx), "dl", ["ins", "inn", "outs"], TREND, "std").select("series", "bin", *r6("mean", "error"), "n")


@query("SELECT root_id, coalesce(b.es, 0) + coalesce(b.ins, 0) AS n_syn_to_both, round(b.es::DOUBLE / nullif(b.es + b.ins, 0), 6) AS ex_out_share FROM fx_neurons LEFT JOIN post b ON root_id = b.id", DEG)
def outgoing_type_share(fx):
    return ft.outgoing_type_share(graph.degrees(fx.edges, fx.neurons.select("root_id"))).select("root_id", "n_syn_to_both", *r6("ex_out_share"))


@query("SELECT root_id, round(s::DOUBLE / n, 6) AS ratio, coalesce(n, 0) AS n_syn, coalesce(e.d, 0) AS block_degree FROM fx_neurons LEFT JOIN a ON root_id = a.pre_id LEFT JOIN e ON root_id = e.pre_id WHERE root_id % 2 = 0",
       "a AS (SELECT pre_id, count(*) AS n, count(*) FILTER (tag = 'shaft') AS s FROM fx_tagged WHERE pre_clf_type = 'E' AND post_clf_type = 'I' GROUP BY 1), e AS (SELECT pre_id, count(*) AS d FROM fx_edges WHERE pre_type = 'E' AND post_type = 'I' GROUP BY 1)")
def subnet_spine_ratio(fx):
    ids = fx.neurons.where("root_id % 2 = 0")
    return ft.subnet_spine_ratio(fx.edges, fx.tagged, ids, "E", "I", "shaft").select("root_id", *r6("ratio"), "n_syn", "block_degree")


@query("SELECT c_custkey AS pt_root_id, c_mktsegment AS cell_type FROM customer WHERE c_custkey <> 0 AND c_custkey % 50 <> 0 AND c_nationkey <> 3 AND c_custkey % 7 <> 0")
def cleaned_types(fx):
    c = fx.table("customer")
    types = c.select(F.col("c_custkey").alias("pt_root_id"), F.col("c_mktsegment").alias("cell_type"), F.when(F.col("c_nationkey") == 3, "nonneuron").when(F.col("c_nationkey") > 5, "neuron").alias("classification_system"))
    types = types.unionByName(types.where("pt_root_id % 50 = 0"))
    return ft.cleaned_types(types, fx.neurons.where("root_id % 7 <> 0"), ("nonneuron", "unclear")).select("pt_root_id", "cell_type")


@query("SELECT clf_type, printf('r = %.2f', r) AS r, CASE WHEN p < 0.001 THEN printf('p = %.1e', p) ELSE printf('p = %.3f', p) END AS p, stars FROM withp", DEG + ", " + DEGREES + ", " + with_p(LINES))
def figure_labels(fx):
    rows = st.regression(_g(fx), "dl", "ins", ("clf_type",), with_p=True)
    return rows.select("clf_type", F.format_string("r = %.2f", "r").alias("r"), st.p_label(F.col("p")).alias("p"), "stars")


# --- composites -------------------------------------------------------------------------------


@query("SELECT replica, block, root_id, round(avg(d), 6) AS shared_input FROM (SELECT DISTINCT replica, block, pre_id, post_id AS root_id FROM z) JOIN (SELECT replica, block, pre_id, count(DISTINCT post_id) AS d FROM z GROUP BY ALL) USING (replica, block, pre_id) GROUP BY ALL", NULL)
def null_shared_block(fx):
    return nullmodel.null_shared_input(fx.edges, 3, 7, by_block=True).select("replica", "block", "root_id", *r6("shared_input"))


@query("SELECT replica, pre_id, post_id, n_syn FROM z", NULL.replace("pre_type || post_type AS block", "'all' AS block"))
def config_model_untyped(fx):
    return nullmodel.shuffled(fx.edges, 3, 7, keep_types=False).groupBy("replica", "pre_id", "post_id").agg(F.sum("n_syn").alias("n_syn"))


@query("SELECT replica, block, z.pre_id, z.post_id, z.n_syn FROM z JOIN pl a ON z.pre_id = a.root_id JOIN pl b ON z.post_id = b.root_id WHERE a.place <> b.place",
       NULL.replace("p.a = q.b WHERE p.pre_id <> q.post_id GROUP", "p.a = q.b GROUP") + ", pl AS (SELECT root_id, row_number() OVER (PARTITION BY clf_type ORDER BY root_id) AS place FROM fx_neurons)")
def config_model_diagonal(fx):
    return nullmodel.shuffled(fx.edges, 3, 7, diagonal_of=fx.neurons).select("replica", "block", "pre_id", "post_id", "n_syn")


@query("SELECT replica, root_id, sum(n_syn)::BIGINT AS in_synapses, count(*) AS in_neurons, round(sum(n_syn)::DOUBLE / count(*), 6) AS contacts FROM (SELECT replica, post_id AS root_id, n_syn FROM z) GROUP BY ALL", NULL)
def shuffled_features(fx):
    """Degrees and contact features of the neurons on each shuffled graph."""
    rows = nullmodel.replica_features(fx.neurons, fx.edges, 3, 7).where("in_synapses > 0")
    return rows.select("replica", "root_id", "in_synapses", "in_neurons", *r6("contacts"))


@query("""SELECT e.replica, e.root_id, coalesce(a.s, 0) AS in_synapses, coalesce(a.n, 0) AS in_neurons, coalesce(a.es, 0) AS ex_in_synapses, coalesce(b.inn, 0) AS inh_out_neurons,
  CASE WHEN coalesce(a.s, 0) = 0 THEN 0.0 ELSE round(a.s::DOUBLE / a.n, 6) END AS contacts, round(coalesce(a.en, 0)::DOUBLE / nullif(dl, 0), 6) + 0.0 AS ex_partner_density
  FROM (SELECT root_id, dendrite_length AS dl, unnest(range(100)) AS replica FROM fx_neurons) e LEFT JOIN ri a USING (replica, root_id) LEFT JOIN ro b USING (replica, root_id)""",
       NULL.replace("range(3)", f"range({REPLICAS})") + """, zt AS (SELECT *, substr(block, 1, 1) AS pre_type, substr(block, 2, 1) AS post_type FROM z),
ri AS (SELECT replica, post_id AS root_id, sum(n_syn)::BIGINT AS s, count(*) AS n, coalesce(sum(n_syn) FILTER (pre_type = 'E'), 0)::BIGINT AS es, count(*) FILTER (pre_type = 'E') AS en FROM zt GROUP BY ALL),
ro AS (SELECT replica, pre_id AS root_id, count(*) FILTER (post_type = 'I') AS inn FROM zt GROUP BY ALL)""")
def replica_features(fx):
    """Every neuron on each of the shuffled graphs behind a control, with or without edges there: one plan."""
    rows = nullmodel.replica_features(fx.neurons, fx.edges, REPLICAS, 7)
    return rows.select("replica", "root_id", "in_synapses", "in_neurons", "ex_in_synapses", "inh_out_neurons", *r6("contacts", "ex_partner_density"))


@query("SELECT series, bin, round(avg(y), 6) AS mean, count(*) AS n, round(any_value(r), 6) AS r, round(any_value(slope), 6) AS slope FROM (SELECT *, CAST(least(7, greatest(0, floor((dl - lo) / ((hi - lo) / 8)))) AS INTEGER) AS bin FROM long, (SELECT min(dl) AS lo, max(dl) AS hi FROM g)) JOIN (SELECT series, corr(dl, y) AS r, regr_slope(y, dl) AS slope FROM long GROUP BY 1) USING (series) GROUP BY ALL",
       DEG + ", " + DEGREES + ", long AS (SELECT 'ins' AS series, dl, ins AS y FROM g UNION ALL SELECT 'outs', dl, outs FROM g)")
def labelled_trends(fx):
    """Eight bins of equal width, and each series' line."""
    return pr.labelled_trends(_g(fx), "dl", ["ins", "outs"], 8).select("series", "bin", *r6("mean"), "n", *r6("r", "slope"))


PANEL = ", ".join(f"({k!r}, {p!r}, {c})" for p, cs in (("synapses", ("es", "ins")), ("contacts", ("ec", "ic")), ("partners", ("en", "inn"))) for k, c in zip(("ex", "inh"), cs, strict=True))


@query(f"SELECT panel, kind, {clamp(pr.PANEL_EDGES['spine'], 'spine')} AS bin, round(avg(y), 6) AS mean, count(*) AS n FROM pd, LATERAL (VALUES {PANEL}) v(kind, panel, y) WHERE y IS NOT NULL GROUP BY ALL",
       f"{MART}, {DEG}, pd AS (SELECT spine, coalesce(a.es, 0)::DOUBLE AS es, coalesce(a.ins, 0)::DOUBLE AS ins, coalesce(a.en, 0)::DOUBLE AS en, coalesce(a.inn, 0)::DOUBLE AS inn, CASE WHEN coalesce(a.es, 0) = 0 THEN 0.0 ELSE a.es::DOUBLE / a.en END AS ec, CASE WHEN coalesce(a.ins, 0) = 0 THEN 0.0 ELSE a.ins::DOUBLE / a.inn END AS ic FROM mart LEFT JOIN pre a ON root_id = a.id)")
def panel_trends(fx):
    rows = ft.connectivity_features(_mart(fx), fx.edges)
    return pr.panel_trends(rows, "spine").select("panel", "kind", "bin", *r6("mean"), "n")


@query("SELECT root_id, max(CASE WHEN block = 'EE' THEN v WHEN block = 'EI' THEN v END) AS from_ex, max(CASE WHEN block = 'IE' THEN v WHEN block = 'II' THEN v END) AS from_inh FROM fx_neurons LEFT JOIN (SELECT e.pre_type || e.post_type AS block, post_id, round(avg(d), 6) AS v FROM fx_edges e JOIN (SELECT pre_id, pre_type || post_type AS block, count(*) AS d FROM fx_edges GROUP BY ALL) o ON e.pre_id = o.pre_id AND e.pre_type || e.post_type = o.block GROUP BY ALL) ON root_id = post_id GROUP BY 1")
def routed_blocks(fx):
    """Shared input by block, as two columns of the neurons that receive it."""
    found = graph.shared_input(graph.blocks(fx.edges), ("block",))
    found = found.withColumn("block", F.substring("block", 1, 1))
    return ft.routed(found, "shared_input", fx.neurons.select("root_id"), {"E": "from_ex", "I": "from_inh"}).select("root_id", *r6("from_ex", "from_inh"))


@query("SELECT root_id, round(x0 / 1000.0 * 2, 6) AS px, cell_type FROM fx_neurons LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS x0 FROM customer WHERE c_custkey % 3 = 0) ON root_id = k")
def placed_neurons(fx):
    """Neurons beside positions of some of them, scaled."""
    rows = fx.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pt_root_id"), (F.col("c_acctbal") / 1000.0 * 2).alias("px"))
    return ft.placed(fx.neurons, rows).select("root_id", *r6("px"), "cell_type")


@query("SELECT root_id, coalesce(n, 0) AS n FROM fx_neurons LEFT JOIN (SELECT post_id, count(*) AS n FROM fx_tagged WHERE tag IS NULL OR tag <> 'spine' GROUP BY 1) ON root_id = post_id WHERE dendrite_length < 5000")
def other_tags(fx):
    n = ft.not_tagged(fx.tagged).groupBy(F.col("post_id").alias("root_id")).agg(F.count(F.lit(1)).alias("n"))
    return ft.below(fx.neurons, "dendrite_length", 5000).join(n, "root_id", "left").select("root_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT root_id, round(s::DOUBLE / n, 6) AS ratio FROM fx_neurons JOIN (SELECT pre_id, count(*) AS n, count(*) FILTER (tag = 'spine') AS s FROM fx_tagged GROUP BY 1) ON root_id = pre_id WHERE s::DOUBLE / n > 0.3")
def ratio_above(fx):
    return ft.above(ft.spine_ratio(fx.tagged, fx.neurons), "ratio", 0.3).select("root_id", *r6("ratio"))


@query("SELECT count(*) AS n, count(DISTINCT pre_id) AS n_pre, count(DISTINCT post_id) AS n_post, count(*) FILTER (tag = 'spine') AS n_spine, count(*) FILTER (tag = 'shaft') AS n_shaft, count(*) FILTER (tag = 'soma') AS n_soma FROM fx_tagged")
def synapse_summary(fx):
    return ft.summary(fx.tagged)


@query("SELECT root_id, cell_type, round(v, 4) AS crossing FROM fx_neurons LEFT JOIN f ON root_id = pre_id", CROSS)
def neurons_with_crossing(fx):
    """Neurons beside the place where they come to prefer spines; none for those that never do or have no synapse."""
    c = pr.crossings(pr.by_neuron(_e(fx), PROFILE), PROFILE, "pre_id", "zero").where(F.col("crossing") < float("inf"))
    return fx.neurons.join(c, F.col("root_id") == F.col("pre_id"), "left").select("root_id", "cell_type", F.round("crossing", 4).alias("crossing"))


@query("SELECT root_id, round(sum(len) FILTER (comp IN (1, 2) AND pcomp IN (1, 2)), 4) AS axon, round(sum(len) FILTER (comp IN (1, 3, 4) AND pcomp IN (1, 3, 4)), 4) AS dendrite FROM (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) AS len FROM lk WHERE px IS NOT NULL AND x BETWEEN 20 AND 400 AND px BETWEEN 20 AND 400 AND z BETWEEN 1 AND 5 AND pz BETWEEN 1 AND 5) GROUP BY 1 HAVING axon IS NOT NULL OR dendrite IS NOT NULL",
       "le AS (SELECT user_id AS root_id, ts, event_id, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, event_id % 4 + 1 AS comp FROM events), lk AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(comp) OVER w AS pcomp FROM le WINDOW w AS (PARTITION BY root_id ORDER BY ts, event_id))")
def local_path_lengths(fx):
    """Axon and dendrite cable inside the box that the given neurons' positions span: here x 20 to 400 and z 1 to 5."""
    chain = _chain(fx)
    bounds = fx.spark.createDataFrame([(20.0, 1.0), (400.0, 5.0)], "x double, z double")
    neurons = chain.select("root_id").distinct().crossJoin(F.broadcast(bounds.agg(F.min("x").alias("x"), F.min("z").alias("z"))))  # one row
    neurons = neurons.unionByName(fx.spark.createDataFrame([(-1, 400.0, 5.0)], neurons.schema))
    out = geometry.local_path_length(chain, neurons)
    return out.where("axon_local_length > 0 OR dendrite_local_length > 0").select("root_id", *[F.round(F.nullif(f"{n}_local_length", F.lit(0.0)), 4).alias(n) for n in ("axon", "dendrite")])


RANKED = "SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0 AS rx, rank() OVER (ORDER BY inn) + (count(*) OVER (PARTITION BY inn) - 1) / 2.0 AS ry FROM g)"


@query("SELECT n, round(rho, 6) AS rho, round(p, 6) AS p, stars FROM withp", DEG + ", " + DEGREES + ", " + with_p(RANKED, "rho"))
def spearman_with_p(fx):
    return st.spearman(_g(fx), "dl", "inn", with_p=True).select("n", *r6("rho", "p"), "stars")


@query("SELECT feature, round(r, 2) AS r, n, round(p, 6) AS p, stars FROM withp", DEG + ", " + DEGREES + ", " + with_p(" UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, dl) AS r, count(*) FILTER ({a} IS NOT NULL AND dl IS NOT NULL) AS n FROM g" for a in ("ins", "inn", "outs"))))
def correlation_bars(fx):
    """Bars of correlations with a target, with p and stars."""
    return st.correlations_with(_g(fx), "dl", ["ins", "inn", "outs"], with_p=True).select("feature", F.round("r", 2).alias("r"), "n", *r6("p"), "stars")


@query("SELECT DISTINCT root_id FROM (SELECT pre_id AS root_id FROM fx_edges UNION ALL SELECT post_id FROM fx_edges)")
def graph_nodes(fx):
    return graph.nodes(fx.edges)


@query("SELECT pt_root_id AS root_id, list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'AUTOMOBILE'], t.cell_type)::BIGINT AS place, round(t.x * 2 + 1, 6) AS x, coalesce(a.s, 0) AS in_synapses FROM (SELECT root_id AS pt_root_id, CASE WHEN root_id % 50 <> 0 AND root_id % 7 <> 3 THEN cell_type END AS cell_type, CASE WHEN root_id % 50 <> 0 AND root_id % 7 <> 3 THEN root_id::DOUBLE END AS x FROM fx_neurons) t LEFT JOIN pre a ON pt_root_id = a.id",
       DEG)
def full_neurons(fx):
    """Neurons beside cleaned annotations, moved positions, degrees and the order of their types."""
    n = fx.neurons
    types = n.select(F.col("root_id").alias("pt_root_id"), "cell_type", F.when(F.col("root_id") % 7 == 3, "nonneuron").otherwise("neuron").alias("classification_system"),
                     F.format_string("[%d, 5, -2]", "root_id").alias("pt_position"))
    types = types.unionByName(types.where("pt_root_id % 50 = 0"))
    move = [[2.0, 0, 0, 1.0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    rows = readers.full_neurons(types, n.select("root_id", "dendrite_length"), fx.edges, LEVELS, ("nonneuron",), move)
    return rows.select("root_id", F.nullif("place", F.lit(0)).cast("long").alias("place"), F.round("x_t", 6).alias("x"), "in_synapses")


@query("SELECT event_id AS id_, round(CAST(regexp_extract_all(props, '(-?\\d+(?:\\.\\d+)?)', 1)[1] AS DOUBLE) * 3, 6) AS x_t FROM events")
def synapse_positions(fx):
    raw = fx.table("events").select(F.col("event_id").alias("id_"), F.concat("props", F.lit(" 1 2")).alias("center_position"))
    return readers.synapses(raw, [[3.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]).select("id_", *r6("x_t"))


@query("SELECT pre_id, post_id, n_syn, 1::BIGINT AS linked FROM fx_edges")
def both_matrices(fx):
    return readers.both_matrices(fx.edges).select("pre_id", "post_id", "n_syn", "linked")


COARSE = uniform_edges(0, 1200, 10)


def axon_sql(pooled: str, level: float) -> str:
    """SQL of a profile with a population in bins of ``PROFILE`` and single neurons in ``COARSE``; only the population crosses at a bin's centre."""
    return f"""ab AS (SELECT *, {hist(PROFILE, 'dist')} AS bin, {hist(COARSE, 'dist')} AS own FROM fx_tagged WHERE pre_clf_type = 'E'),
an AS (SELECT pre_id, bin, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share FROM ab WHERE bin IS NOT NULL GROUP BY ALL),
ap AS (SELECT 'all' AS series, bin, {mid(PROFILE, 'bin')} AS x, {pooled}),
ao AS (SELECT pre_id::VARCHAR AS series, own AS bin, {mid(COARSE, 'own')} AS x, count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share FROM ab WHERE own IS NOT NULL AND pre_id IN (10, 11, 13) GROUP BY ALL HAVING count(*) > 1),
am AS (SELECT series, bin, x, n, share, sd, sem FROM ap UNION ALL SELECT series, bin, x, n, share, sqrt(share * (1 - share)), sqrt(share * (1 - share) / n) FROM ao),
ac AS (SELECT *, lag(x) OVER w AS x0, lag(share) OVER w AS y0 FROM am WINDOW w AS (PARTITION BY series ORDER BY bin)),
af AS (SELECT series, arg_min(CASE WHEN y0 IS NOT NULL THEN x0 + ({level} - y0) / (share - y0 + 1e-9) * (x - x0) WHEN series = 'all' THEN x ELSE 0.0 END, bin) FILTER (share > {level}) AS v FROM ac GROUP BY 1)"""


AXON_ROWS = "SELECT series, bin, round(x, 6) AS centre, n, round(share, 6) AS share, round(sd, 6) AS sd, round(sem, 6) AS sem, round(coalesce(v, -1), 4) AS crossing FROM ac JOIN af USING (series)"
MACRO = "sum(n)::BIGINT AS n, avg(share) AS share, stddev_pop(share) AS sd, stddev_pop(share) / sqrt(count(*)) AS sem FROM an GROUP BY bin"
MICRO = "count(*) AS n, (count(*) FILTER (tag = 'spine'))::DOUBLE / count(*) AS share, sqrt(share * (1 - share)) AS sd, sqrt(share * (1 - share) / count(*)) AS sem FROM ab WHERE bin IS NOT NULL GROUP BY bin"


def _axon(fx, average: str, level: float) -> DataFrame:
    rows = pr.axon_profile(_e(fx), PROFILE, [10, 11, 13], COARSE, average, least=1, level=level)
    return rows.select("series", "bin", *r6("centre"), "n", *r6("share", "sd", "sem"), F.round(F.when(F.col("crossing") == float("inf"), -1.0).otherwise(F.col("crossing")), 4).alias("crossing"))


@query(AXON_ROWS, axon_sql(MACRO, 0.3))
def axon_profile(fx):
    return _axon(fx, "macro", 0.3)


@query(AXON_ROWS, axon_sql(MICRO, 0.5))
def axon_profile_pooled(fx):
    return _axon(fx, "micro", 0.5)


@query("SELECT pre_id, post_id, n_syn FROM fx_edges")
def reassembled_blocks(fx):
    """The four blocks of types put together again."""
    # one pass: a union of four filters holds what all four need in one task
    out = graph.blocks(fx.edges).where(F.col("block").isin("EE", "EI", "IE", "II"))
    return out.select("pre_id", "post_id", "n_syn")


@query("SELECT root_id, CASE cell_type WHEN 'MACHINERY' THEN '#1f77b4' WHEN 'BUILDING' THEN '#ff7f0e' END AS colour, CASE WHEN root_id = 10 THEN 1.5 ELSE round(x, 6) END AS x FROM fx_neurons")
def coloured(fx):
    """Colours by type, none for types without one, and one position set by hand."""
    palette = F.create_map(*map(F.lit, ("MACHINERY", "#1f77b4", "BUILDING", "#ff7f0e")))
    return fx.neurons.select("root_id", F.try_element_at(palette, F.col("cell_type")).alias("colour"), F.when(F.col("root_id") == 10, 1.5).otherwise(F.round("x", 6)).alias("x"))


@query("SELECT root_id, round(dendrite_length, 6) AS dendrite_length FROM fx_neurons ORDER BY dendrite_length DESC NULLS LAST, root_id LIMIT 3")
def longest_dendrites(fx):
    return fx.neurons.orderBy(F.col("dendrite_length").desc_nulls_last(), "root_id").limit(3).select("root_id", *r6("dendrite_length"))


@query("SELECT root_id, round(coalesce(a.s, 0)::DOUBLE / a.n / nullif(dendrite_length, 0), 9) AS contact_density FROM fx_neurons JOIN pre a ON root_id = a.id", DEG)
def contact_density(fx):
    deg = graph.degrees(fx.edges, fx.neurons.select("root_id", "dendrite_length")).where("in_synapses > 0")
    rows = ft.contact_features(deg)
    return rows.select("root_id", F.round(F.try_divide(F.col("contacts"), F.col("dendrite_length")), 9).alias("contact_density"))


@query("SELECT seg_id, fid, round(0.3 + 0.7 * CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN 0.0 ELSE greatest(0.0, (nx * 0.3 + ny * 0.5 + nz) / sqrt(0.3 * 0.3 + 0.5 * 0.5 + 1.0) / sqrt(nx * nx + ny * ny + nz * nz)) END, 6) AS shade FROM cr JOIN me USING (seg_id) WHERE fid = vid AND (x BETWEEN 10 AND 30 AND y BETWEEN 3 AND 9 OR x1 BETWEEN 10 AND 30 AND y1 BETWEEN 3 AND 9 OR x0 BETWEEN 10 AND 30 AND y0 BETWEEN 3 AND 9)", MESH)
def branch_view(fx):
    v = _chain(fx).select(F.col("root_id").alias("seg_id"), "vid", "x", "y", "z")
    faces = v.where("vid >= 2").select("seg_id", F.col("vid").cast("long").alias("fid"), (F.col("vid") - 2).alias("v0"), (F.col("vid") - 1).alias("v1"), F.col("vid").alias("v2"))
    return geometry.branch_view(faces, v, (10, 30), (3, 9)).select("seg_id", "fid", *r6("shade"))


@query("SELECT user_id AS root_id, CASE event_id % 4 + 1 WHEN 2 THEN 'axon' ELSE 'dendrite' END AS layer, round(value, 6) AS x, hour(ts)::DOUBLE AS y, NULL::VARCHAR AS colour FROM events WHERE event_id % 4 + 1 IN (2, 3, 4) UNION ALL SELECT post_id, 'synapse', round(dist, 6), size, CASE tag WHEN 'spine' THEN 'red' WHEN 'shaft' THEN 'blue' END FROM fx_tagged WHERE post_id <= 150 AND tag IN ('spine', 'shaft')")
def neuron_overlay(fx):
    dots = fx.tagged.where("post_id <= 150").select(F.col("post_id").alias("root_id"), F.col("dist").alias("x"), F.col("size").alias("y"), "tag")
    return geometry.overlay(_chain(fx), dots, {"spine": "red", "shaft": "blue"}).select("root_id", "layer", *r6("x"), "y", "colour")


# --- results beside the main ones ---------------------------------------------------------------


@query("SELECT pre_id AS root_id, round(v, 4) AS crossing, v IS NULL AS never FROM f", CROSS.replace(edge_array(PROFILE), edge_array(FINE)).replace(hist(PROFILE, "dist"), hist(FINE, "dist")))
def crossing_fine(fx):
    """Crossings over the 159 bins of the figures."""
    c = pr.crossings(pr.by_neuron(_e(fx), FINE), FINE, "pre_id", "zero")
    never = F.col("crossing") == float("inf")
    return c.select(F.col("pre_id").alias("root_id"), F.when(~never, F.round("crossing", 4)).alias("crossing"), never.alias("never"))


BOX = "bx AS (SELECT clf_type, quantile_cont(ins, 0.25) AS q1, quantile_cont(ins, 0.75) AS q3 FROM g GROUP BY 1)"


@query("SELECT clf_type, ins, count(*) AS n FROM g JOIN bx USING (clf_type) WHERE ins NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL", DEG + ", " + DEGREES + ", " + BOX)
def box_fliers(fx):
    """The values beyond the whiskers of ``box_stats``, and how often each occurs."""
    return st.fliers(_g(fx), "ins", "clf_type")


@query(f"SELECT cell_type, x, round(sum(exp(-((x - v) / bw) * ((x - v) / bw) / 2)) / (count(*) * sqrt(2 * pi())), 5) AS scaled FROM (SELECT cell_type, dendrite_length AS v FROM fx_neurons WHERE dendrite_length IS NOT NULL) JOIN (SELECT cell_type, stddev_samp(dendrite_length) * pow(count(dendrite_length), -0.2) AS bw FROM fx_neurons GROUP BY 1) USING (cell_type), (SELECT unnest({edge_array(GRID)}) AS x) GROUP BY cell_type, x, bw")
def density_by_group(fx):
    """Densities with a bandwidth for each type by Scott's rule, times that bandwidth."""
    rows = st.density(fx.neurons, "dendrite_length", "cell_type", GRID)
    spread = fx.neurons.groupBy("cell_type").agg((F.stddev_samp("dendrite_length") * F.count("dendrite_length") ** -0.2).alias("bw"))
    return rows.join(spread, "cell_type").select("cell_type", "x", F.round(F.col("density") * F.col("bw"), 5).alias("scaled"))


@query("SELECT n.*, e.n_syn FROM (SELECT root_id, clf_type, cell_type, round(dendrite_length, 6) AS dendrite_length FROM fx_neurons) n JOIN fx_edges e ON n.root_id = e.pre_id WHERE e.post_id = 10 AND e.pre_type = 'E'")
def partner_rows(fx):
    """The whole rows of one neuron's excitatory partners."""
    return graph.partner_rows(fx.edges, fx.neurons, 10, "E").select("root_id", "clf_type", "cell_type", *r6("dendrite_length"), "n_syn")


INDEXED = """mp AS (SELECT root_id, root_id * 7919 % 1000003 AS idx FROM fx_neurons), cl AS (SELECT a.idx AS row, b.idx AS col, n_syn FROM fx_edges JOIN mp a ON a.root_id = pre_id JOIN mp b ON b.root_id = post_id),
nw AS (SELECT idx AS was, root_id, row_number() OVER (ORDER BY idx) - 1 AS idx FROM mp JOIN fx_neurons USING (root_id) WHERE root_id % 3 = 0 AND dendrite_length > 0)"""


def _reindexed(fx):
    mapping = fx.neurons.select("root_id", (F.col("root_id") * 7919 % 1000003).alias("idx"))
    row, col = (mapping.select(F.col("root_id").alias(end), F.col("idx").alias(name)) for end, name in (("pre_id", "row"), ("post_id", "col")))
    cells = fx.edges.join(row, "pre_id").join(col, "post_id").select("row", "col", "n_syn")
    return graph.reindexed(cells, mapping, fx.neurons.where("root_id % 3 = 0 AND dendrite_length > 0"))


@query("SELECT a.idx AS row, b.idx AS col, n_syn FROM cl JOIN nw a ON a.was = row JOIN nw b ON b.was = col", INDEXED)
def reindexed_cells(fx):
    """A matrix cut down to some neurons, in the old order."""
    return _reindexed(fx)[0]


@query("SELECT idx, root_id FROM nw", INDEXED)
def reindexed_mapping(fx):
    return _reindexed(fx)[1]


@query("SELECT pre_id AS row, sum(n_syn)::DOUBLE AS value, count(*) AS cells, min(post_id) AS first_col FROM fx_edges GROUP BY 1")
def matrix_file_sums(fx):
    """The edges written as matrix files and read again in ranges: the sums of its rows."""
    path = scratch_path(fx.spark, "matrix")
    readers.write_matrix(fx.edges.select(F.col("pre_id").alias("row"), F.col("post_id").alias("col"), F.col("n_syn").alias("value")), path)
    cells = readers.matrix_cells(fx.spark, path, 5000)
    return cells.groupBy("row").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("cells"), F.min("col").alias("first_col"))


DENDRITE = """ev AS (SELECT user_id AS seg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vid, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, event_id % 4 + 1 AS comp FROM events),
nv AS (SELECT v.seg_id, v.vid, arg_min(s.comp, (pow(v.x - (s.x + 0.5), 2) + pow(v.y - s.y, 2) + pow(v.z - s.z, 2), s.vid)) AS comp FROM ev v JOIN ev s ON v.seg_id = s.seg_id AND s.vid % 4 = 0 GROUP BY ALL),
kv AS (SELECT seg_id, vid AS old_vid, row_number() OVER (PARTITION BY seg_id ORDER BY vid) - 1 AS vid FROM nv WHERE comp <> 2)"""


def _dendrite(fx):
    chain = _chain(fx)
    v = chain.select(F.col("root_id").alias("seg_id"), F.col("vid").cast("long").alias("vid"), "x", "y", "z")
    faces = v.where("vid >= 2").select("seg_id", F.col("vid").alias("fid"), (F.col("vid") - 2).alias("v0"), (F.col("vid") - 1).alias("v1"), F.col("vid").alias("v2"))
    bones = chain.where("vid % 4 = 0").withColumn("x", F.col("x") + 0.5)
    return geometry.dendrite_mesh(v, faces, bones)


@query("SELECT seg_id, old_vid, vid FROM kv", DENDRITE)
def dendrite_vertices(fx):
    """Mesh vertices whose nearest skeleton vertex is no axon, numbered anew."""
    return _dendrite(fx)[0].select("seg_id", "old_vid", F.col("vid").cast("long").alias("vid"))


@query("SELECT a.seg_id, c.old_vid AS old_fid, row_number() OVER (PARTITION BY a.seg_id ORDER BY c.old_vid) - 1 AS fid, a.vid AS v0, b.vid AS v1, c.vid AS v2 FROM kv a JOIN kv b ON a.seg_id = b.seg_id AND b.old_vid = a.old_vid + 1 JOIN kv c ON a.seg_id = c.seg_id AND c.old_vid = a.old_vid + 2", DENDRITE)
def dendrite_faces(fx):
    """The faces with three such corners, by the new numbers."""
    return _dendrite(fx)[1].select("seg_id", "old_fid", *[F.col(c).cast("long").alias(c) for c in ("fid", "v0", "v1", "v2")])


RIBBON = """rv AS (SELECT user_id AS root_id, row_number() OVER w - 1 AS vid, count(*) OVER (PARTITION BY user_id) AS n, value AS x, (event_id % 7)::DOUBLE AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rs AS (SELECT *, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS byy, lead(x) OVER w - x AS ax, lead(y) OVER w - y AS ay FROM rv WHERE vid > 0 AND n > 2 WINDOW w AS (PARTITION BY root_id ORDER BY vid)),
rn AS (SELECT *, coalesce(-byy / greatest(sqrt(bx * bx + byy * byy), 1e-12), 0) + coalesce(-ay / greatest(sqrt(ax * ax + ay * ay), 1e-12), 0) AS nx, coalesce(bx / greatest(sqrt(bx * bx + byy * byy), 1e-12), 0) + coalesce(ax / greatest(sqrt(ax * ax + ay * ay), 1e-12), 0) AS ny FROM rs),
ru AS (SELECT *, 2 * nx / greatest(sqrt(nx * nx + ny * ny), 1e-12) AS ux, 2 * ny / greatest(sqrt(nx * nx + ny * ny), 1e-12) AS uy FROM rn)"""


@query("SELECT root_id, 0::BIGINT AS line, vid AS place, round(x + ux / 2, 6) AS x, round(y + uy / 2, 6) AS y FROM ru UNION ALL SELECT root_id, 0, 2 * n - 1 - vid, round(x - ux / 2, 6), round(y - uy / 2, 6) FROM ru",
       RIBBON.replace("(event_id % 7)::DOUBLE AS y", "hour(ts)::DOUBLE AS y").replace("WHERE vid > 0 AND n > 2", "WHERE n > 1"))
def ribbons(fx):
    return geometry.ribbons(geometry.polylines(_chain(fx)), _chain(fx)).select("root_id", "line", "place", *r6("x", "y"))


@query("SELECT root_id, 0::BIGINT AS line, vid - 1 AS place, vid, round(x + ux, 6) AS x, round(y + uy, 6) AS y FROM ru UNION ALL SELECT root_id, 0, 2 * (n - 1) - vid, vid, round(x - ux, 6), round(y - uy, 6) FROM ru", RIBBON)
def skeleton_drawing(fx):
    """The polygons of unbranched skeletons without their first vertex, on the x and z axes, twice as wide."""
    rows = geometry.drawing(_chain(fx), ("x", "z"), 2.0)
    return rows.select("root_id", "line", "place", F.col("vid").cast("long").alias("vid"), *r6("x", "y"))


@query("SELECT root_id, coalesce(n, 0) AS n, n IS NOT NULL AS found FROM fx_neurons LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON root_id = user_id")
def wanted_skeletons(fx):
    """A row for each neuron asked for, whether it has a skeleton or not."""
    rows = readers.wanted(fx.neurons, _chain(fx))
    return rows.groupBy("root_id").agg(F.count("vid").alias("n"), F.bool_and("found").alias("found"))


@query("SELECT root_id, round(sum(sqrt(pow(0.5 * dx + 2 * dy, 2) + pow(dy, 2) + pow(3 * dz, 2))), 4) AS length FROM (SELECT root_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM (SELECT user_id AS root_id, ts, event_id, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events) WINDOW w AS (PARTITION BY root_id ORDER BY ts, event_id)) WHERE dx IS NOT NULL GROUP BY 1")
def moved_skeletons(fx):
    """Cable lengths of skeletons sent through a 3 x 4 map."""
    moved = geometry.affine(_chain(fx), ["x", "y", "z"], [[0.5, 2, 0, 7], [0, 1, 0, -1], [0, 0, 3, 0]])
    return geometry.path_length(moved).select("root_id", F.round("length", 4).alias("length"))


DENSE = ", ".join(f"({k!r}, {p!r}, {c})" for p, cs in (("synapses", ("es / dl", "ins / dl")), ("contacts", ("ec / dl", "ic / dl")), ("partners", ("en / dl", "inn / dl"))) for k, c in zip(("ex", "inh"), cs, strict=True))


def dense_panels(x: str) -> tuple[str, str]:
    return (f"SELECT panel, kind, {clamp(pr.PANEL_EDGES[x], 'x')} AS bin, round(avg(y), 9) AS mean, count(*) AS n FROM (SELECT * FROM pd WHERE x IS NOT NULL), LATERAL (VALUES {DENSE}) v(kind, panel, y) WHERE y IS NOT NULL GROUP BY ALL",
            f"{MART}, {DEG}, pd AS (SELECT nullif(dl, 0) AS dl, {MART_RATIOS[x][0]}::DOUBLE / nullif(dl, 0) AS x, coalesce(a.es, 0)::DOUBLE AS es, coalesce(a.ins, 0)::DOUBLE AS ins, coalesce(a.en, 0)::DOUBLE AS en, coalesce(a.inn, 0)::DOUBLE AS inn, CASE WHEN coalesce(a.es, 0) = 0 THEN 0.0 ELSE a.es::DOUBLE / a.en END AS ec, CASE WHEN coalesce(a.ins, 0) = 0 THEN 0.0 ELSE a.ins::DOUBLE / a.inn END AS ic FROM mart LEFT JOIN pre a ON root_id = a.id)")


def _dense_panel(fx, x: str) -> DataFrame:
    rows = pr.panel_trends(ft.connectivity_features(_mart(fx), fx.edges), x, density=True)
    return rows.select("panel", "kind", "bin", F.round("mean", 9).alias("mean"), "n")


@query(*dense_panels("spine_density"))
def panel_by_spine_density(fx):
    """Input by dendrite length in panels over spine density."""
    return _dense_panel(fx, "spine_density")


@query(*dense_panels("ds_spine_density"))
def panel_by_all_spine_density(fx):
    return _dense_panel(fx, "ds_spine_density")


# --- files ------------------------------------------------------------------------------------
# written from the tables into the scratch folder, read with the library's readers


def _written(fx, name: str) -> str:
    return scratch_path(fx.spark, name)


@query("SELECT root_id, cell_type, (root_id * 2 + 1)::DOUBLE AS x_t, round(5 - dendrite_length / 100.0, 4) AS y_t FROM fx_neurons")
def csv_neurons(fx):
    """A table of neurons from CSV files with an index column, its position strings parsed and moved."""
    path = _written(fx, "csv")
    place = F.concat(F.lit("["), F.col("root_id").cast("string"), F.lit(", "), F.col("dendrite_length").cast("decimal(18,2)").cast("string"), F.lit(", -2]"))
    fx.neurons.select(F.monotonically_increasing_id().alias("_c0"), "root_id", "cell_type", place.alias("pt_position")).write.option("header", True).csv(path)
    rows = readers.csv(fx.spark, path, "root_id long, cell_type string, pt_position string", index_column=True)
    rows = readers.positions(rows, "pt_position", affine=[[2.0, 0, 0, 1.0], [0, -0.01, 0, 5.0], [0, 0, 1.0, 0]])
    return rows.select("root_id", "cell_type", F.round("x_t", 6).alias("x_t"), F.round("y_t", 4).alias("y_t"))


@query("SELECT target_id, tag FROM fx_tags")
def csv_tags(fx):
    """A table with a plain header."""
    path = _written(fx, "csv")
    fx.tags.select("target_id", "tag").write.option("header", True).csv(path)
    return readers.csv(fx.spark, path, "target_id long, tag string")


@query("SELECT user_id AS root_id, row_number() OVER w - 1 AS vid, row_number() OVER w - 2 AS parent, round(value, 6) AS x, event_id % 4 + 1 AS compartment FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def swc_skeletons(fx):
    """Skeleton files whose raw ids have gaps, read with dense ones."""
    path = _written(fx, "swc")
    chain = _chain(fx)
    raw = chain.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent") * 10 + 3).otherwise(-1)).withColumn("vid", F.col("vid") * 10 + 3)
    readers.write_swc(raw, path).write.format("noop").mode("overwrite").save()
    rows = readers.swc(fx.spark, path)
    return rows.select("root_id", F.col("vid").cast("long").alias("vid"), F.col("parent").cast("long").alias("parent"), *r6("x"), F.col("compartment").cast("long").alias("compartment"))


@query("SELECT post_id AS root_id, id_, pre_id, size::BIGINT AS size, round(dist * 4 / 1000, 6) AS x, round(size * 40 / 1000, 6) AS z, 'Unk' AS cell_type FROM fx_synapses")
def nested_synapses(fx):
    """Nested records of neurons with their incoming synapses, opened."""
    one = F.struct("id_", F.col("pre_id").alias("pre_pt_root_id"), F.col("post_id").alias("post_pt_root_id"), F.col("size").cast("long").alias("size"), F.array("dist", F.lit(0.0), "size").alias("center_position"))
    path = _written(fx, "objects")
    fx.synapses.groupBy(F.col("post_id").alias("root_id")).agg(F.collect_list(one).alias("pre_synapses")).write.parquet(path)
    rows = readers.incoming_synapses(fx.spark.read.parquet(path))
    return rows.select("root_id", "id_", F.col("pre_pt_root_id").alias("pre_id"), "size", *r6("x", "z"), "cell_type")


@query("SELECT clf_type, round(median, 6) AS median FROM (SELECT clf_type, quantile_cont(ins, 0.5) AS median FROM g GROUP BY 1)", DEG + ", " + DEGREES)
def figure_rows(fx):
    """The rows behind a figure, written and read again."""
    path = _written(fx, "figure")
    readers.write_figure_data(st.box(_g(fx), "ins", "clf_type"), path)
    return fx.spark.read.parquet(path).select("clf_type", *r6("median"))


@query("SELECT row_number() OVER (ORDER BY bin) - 1 AS row, round(avg(y), 6) AS mean FROM d GROUP BY bin HAVING count(*) >= 2", DEG + ", " + TR)
def array_column(fx):
    """A curve written as an array file and read again in ranges of three."""
    path = _written(fx, "array")
    deg = graph.degrees(fx.edges, fx.neurons.select("root_id", "dendrite_length")).where("in_synapses > 0")
    found = pr.binned_trend(deg.withColumn("in_synapses", F.col("in_synapses").cast("double")), "dendrite_length", "in_synapses", TREND, "sem", 2)
    file = arrays.mounted(path) + ".npy"
    os.makedirs(os.path.dirname(file), exist_ok=True)
    readers.write_array(found, "mean", "bin", file)
    return readers.array_rows(fx.spark, file, {"mean": "double"}, split=3).select("row", *r6("mean"))


@query("SELECT 'vertex' AS kind, 7::BIGINT AS seg_id, (row_number() OVER (ORDER BY event_id) - 1)::INTEGER AS id, round(value, 6) AS a, hour(ts)::DOUBLE AS b, (event_id % 7)::DOUBLE AS c FROM events UNION ALL SELECT 'face', 7, k::INTEGER, k, k + 1, k + 2 FROM (SELECT unnest(range(count(*) - 2)) AS k FROM events)")
def mesh_files(fx):
    """A mesh from two array files, read in ranges into the tables of meshes and from there."""
    path = _written(fx, "mesh")
    folder = arrays.mounted(path)
    os.makedirs(folder, exist_ok=True)
    v = fx.table("events").select("event_id", F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"), F.lit(1).cast("long").alias("one"))
    v = written(running(v, "event_id", "one", name="k"), "vertices")
    n = v.count()
    faces = v.where(F.col("k") < n - 2).select("k", F.col("k").alias("v0"), (F.col("k") + 1).alias("v1"), (F.col("k") + 2).alias("v2"))
    readers.write_rows(v, ["x", "y", "z"], "k", n, f"{folder}/v.npy")
    readers.write_rows(faces, ["v0", "v1", "v2"], "k", max(0, n - 2), f"{folder}/f.npy")
    # ranges of 1,000 rows, longer ones where these would be more than 1,000 tasks
    readers.ingest_mesh(fx.spark, f"{path}/tables", 7, f"{folder}/v.npy", f"{folder}/f.npy", split=max(1000, n // 1000))
    vertices, triangles = readers.mesh(fx.spark, f"{path}/tables", 7)
    rows = vertices.select(F.lit("vertex").alias("kind"), "seg_id", F.col("vid").alias("id"), F.round("x", 6).alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))
    return rows.unionByName(triangles.select(F.lit("face").alias("kind"), "seg_id", F.col("fid").alias("id"), *[F.col(f"v{k}").cast("double").alias(n) for k, n in enumerate("abc")]))


# --- more of the inventory ----------------------------------------------------------------------


@query("SELECT s.id_, s.pre_id, s.post_id, t.tag FROM fx_synapses s JOIN fx_tags t ON s.id_ = t.target_id")
def tagged_checked(fx):
    """Synapses with their tags, where no target may have two."""
    return ft.tag_join(fx.synapses, fx.tags).select("id_", "pre_id", "post_id", "tag")


@query(f"SELECT bin, n, round(p, 6) AS share, round(sqrt(p * (1 - p) / n), 6) AS sem FROM (SELECT bin, count(*) AS n, (count(*) FILTER (post_clf_type = 'E'))::DOUBLE / count(*) AS p FROM t WHERE bin IS NOT NULL GROUP BY 1)", E_TAGGED.format(b=hist(PROFILE, "dist")))
def preference_for_excitatory(fx):
    """The profile of the share of excitatory targets instead of spines."""
    return pr.micro_profile(_e(fx), PROFILE, inh_pref=True).select("bin", "n", *r6("share", "sem"))


BONES = """bo AS (SELECT user_id AS root_id, row_number() OVER w AS k, value AS x, hour(ts)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, event_id % 4 + 1 AS comp, first_value(value) OVER w AS rx, first_value(hour(ts)::DOUBLE) OVER w AS ry, first_value((event_id % 7)::DOUBLE) OVER w AS rz FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bm AS (SELECT root_id, k, comp, CASE comp WHEN 2 THEN rx ELSE x END AS cx, CASE comp WHEN 2 THEN ry ELSE y END AS cy, CASE comp WHEN 2 THEN rz ELSE z END AS cz, x, y, z FROM bo),
bl AS (SELECT *, lag(comp) OVER w AS pc, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz, lag(x) OVER w AS ox, lag(y) OVER w AS oy, lag(z) OVER w AS oz FROM bm WINDOW w AS (PARTITION BY root_id ORDER BY k))"""


@query("SELECT root_id, round(sum(sqrt(pow(cx - px, 2) + pow(cy - py, 2) + pow(cz - pz, 2))), 4) AS length FROM bl WHERE px IS NOT NULL GROUP BY 1", BONES)
def collapsed_lengths(fx):
    """Cable with the axon drawn together on the root."""
    return geometry.path_length(geometry.collapsed(_chain(fx), geometry.AXON)).select("root_id", F.round("length", 4).alias("length"))


@query("SELECT root_id, count(*) AS n, count(*) FILTER (pc IS NULL OR pc = 2) AS roots, round(coalesce(sum(sqrt(pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2))) FILTER (pc <> 2), 0), 4) AS length FROM bl WHERE comp <> 2 GROUP BY 1", BONES)
def masked_lengths(fx):
    """Skeletons without their axons: vertices left, roots among them and cable."""
    left = geometry.masked(_chain(fx), ~F.col("compartment").isin(*geometry.AXON))
    sums = left.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent") == -1).alias("roots"))
    return sums.join(geometry.path_length(left), "root_id", "left").select("root_id", "n", "roots", F.round(F.coalesce("length", F.lit(0.0)), 4).alias("length"))


@query("SELECT m.vec_id AS vid, arg_min(s.label, (d, s.vec_id)) AS label FROM (SELECT * FROM pt WHERE vec_id % 2 = 0) m, LATERAL (SELECT b.vec_id, b.label, pow(m.x - b.x, 2) + pow(m.y - b.y, 2) + pow(m.z - b.z, 2) AS d FROM pt b WHERE b.vec_id % 2 = 1) s GROUP BY 1",
       "pt AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)")
def copied_labels(fx):
    """Points with the label of their nearest site."""
    e = fx.table("embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    points = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("vid"), "x", "y", "z")
    return geometry.copied_flag(points, e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "site_id"), "label").select("vid", "label")


@query("SELECT id_, post_id, tag, round(10 + 90 * (size - lo) / (hi - lo), 6) AS area FROM fx_tagged, (SELECT min(size) AS lo, max(size) AS hi FROM fx_tagged)")
def synapse_dots(fx):
    """Synapses as dots on a skeleton, their areas by their sizes."""
    return ft.min_max_scaled(fx.tagged, "size", 10, 100, "area").select("id_", "post_id", "tag", *r6("area"))


#: Curves by the place of a neuron, each well inside the bounds.
BUMPS = {"base": (0.1, 0.02), "top": (0.7, 0.03), "half": (100.0, 30.0), "bump": (0.2, 0.03), "centre": (40.0, 10.0), "width": (20.0, 4.0)}


@query("SELECT place, " + ", ".join(f"round(({low} + {step} * (place % 5))::DOUBLE, 2) AS {name}" for name, (low, step) in BUMPS.items()) + " FROM (SELECT DISTINCT CAST(x AS BIGINT) AS place FROM fx_neurons JOIN (SELECT DISTINCT pre_id FROM fx_synapses) ON root_id = pre_id)")
def biphasic_recovery(fx):
    """Fits to exact curves over the fine bins, with the synapses of the neurons of each place as weights, give back the curves' parameters."""
    from wiring.functions.binning import centre

    places = fx.neurons.select(F.col("root_id").alias("pre_id"), F.col("x").cast("long").alias("place"))
    sums = pr.by_neuron(fx.synapses.withColumns({"tag": F.lit("spine")}).join(places, "pre_id"), FINE, key="place")
    p = {name: F.lit(low) + F.lit(step) * (F.col("place") % 5) for name, (low, step) in BUMPS.items()}
    d = centre(FINE, F.col("bin"))
    share = p["base"] + (p["top"] - p["base"]) * d / (d + p["half"]) + p["bump"] * F.exp(-((d - p["centre"]) ** 2) / (2 * p["width"] ** 2))
    rows = sums.select("place", "n", d.alias("centre"), share.alias("share"))
    found = fit.fits(rows.withColumnRenamed("centre", "d"), ["place"], "d", "share", "n", "biphasic")
    return found.select("place", *[F.round(name, 2).alias(name) for name in BUMPS])
