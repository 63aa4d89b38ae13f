"""Operators on hand-sized tables with known answers, and against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiring.functions import binning, numeric
from wiring.operators import features, fit, geometry, graph, nearest, nullmodel, profiles, stats
from wiring.sources import readers
from wiring.streaming import incremental

EDGES = [(1, 2, 2), (1, 3, 1), (2, 1, 1), (2, 5, 1), (3, 1, 3), (3, 2, 1), (4, 3, 1), (5, 2, 1), (5, 5, 1)]
TYPES = {1: "E", 2: "E", 3: "I", 4: "I", 5: "E"}


@pytest.fixture(scope="module")
def g5(spark):
    neurons = spark.createDataFrame(list(TYPES.items()), "root_id long, clf_type string")
    return neurons, graph.typed(spark.createDataFrame(EDGES, "pre_id long, post_id long, n_syn long"), neurons)


def test_degrees_and_shared_input(g5):
    neurons, edges = g5
    d = {r.root_id: (r.in_synapses, r.in_neurons, r.out_synapses, r.out_neurons) for r in graph.degrees(edges, neurons).collect()}
    assert d == {1: (4, 2, 3, 2), 2: (4, 3, 2, 2), 3: (2, 2, 4, 2), 4: (0, 0, 1, 1), 5: (2, 2, 2, 2)}
    assert {r.root_id: r.shared_input for r in graph.shared_input(edges).collect()} == {1: 2.0, 2: 2.0, 3: 1.5, 5: 2.0}
    blocks = {(r.block, r.root_id): r.shared_input for r in graph.shared_input(graph.blocks(edges), ("block",)).collect()}
    assert blocks[("EE", 1)] == 2.0 and blocks[("EE", 2)] == 1.5 and blocks[("EI", 3)] == 1.0 and blocks[("II", 3)] == 1.0


def test_induced_graph_is_idempotent_and_empty_survivors_raise(g5):
    neurons, edges = g5
    some = neurons.where("root_id in (1, 2, 5)")
    once = graph.induced(edges, some)
    assert sorted(graph.induced(once, some).collect()) == sorted(once.collect()) and once.count() == 5
    assert graph.shared_partners(edges, 1, 2).collect() == [("I", 1)]
    with pytest.raises(ValueError):
        graph.require_some(graph.induced(edges, neurons.where("root_id > 9")))


def test_shuffles_keep_stubs_and_have_no_loops(g5):
    _, edges = g5
    a = nullmodel.shuffled(edges, 4, 3)
    assert a.where("pre_id = post_id").count() == 0
    assert sorted(a.collect()) == sorted(nullmodel.shuffled(edges.repartition(5), 4, 3).collect())
    out = {(r.replica, r.block, r.pre_id): r.n for r in a.groupBy("replica", "block", "pre_id").agg(F.sum("n_syn").alias("n")).collect()}
    real = {(r.block, r.pre_id): r.n for r in graph.blocks(edges).groupBy("block", "pre_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n <= real[b, i] for (_, b, i), n in out.items())
    with pytest.raises(ValueError):
        nullmodel.shuffled(edges, 1, 0, mode="other")


def test_profile_and_crossing(spark):
    dist, hit = [0, 5, 10, 12, 15, 25, 28, 39, 40, 41, -1], [0, 0, 1, 0, 0, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(1, float(d), "spine" if h else "shaft", "E") for d, h in zip(dist, hit)], "pre_id long, dist double, tag string, post_clf_type string")
    edges = [0.0, 10, 20, 30, 40]
    rows = {r.bin: (r.n, r.share) for r in profiles.micro_profile(df, edges).collect()}
    assert rows == {0: (2, 0.0), 1: (3, 1 / 3), 2: (2, 1.0), 3: (2, 1.0)}
    one = profiles.crossings(profiles.by_neuron(df, edges), edges, "pre_id", "zero").first()
    assert one.crossing == pytest.approx(17.49999999625)
    up = df.where("dist >= 25")
    assert profiles.crossings(profiles.by_neuron(up, edges), edges, "pre_id", "zero").first().crossing == 0.0
    assert profiles.crossings(profiles.by_neuron(up, edges), edges, "pre_id", "centre").first().crossing == 25.0
    assert profiles.crossings(profiles.by_neuron(df.where("dist < 10"), edges), edges, "pre_id", "zero").first().crossing == math.inf


def test_binned_trend(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip([-1, 0, 1, 2, 3, 4, 5, 9], range(1, 9))], "x double, y double")
    rows = {r.bin: r for r in profiles.binned_trend(df, "x", "y", [0.0, 2, 4]).collect()}
    assert (rows[0].n, rows[0]["mean"], rows[1].n, rows[1]["mean"]) == (3, 2.0, 5, 6.0)
    assert rows[0].error == pytest.approx(0.577350, abs=1e-6) and rows[1].error == pytest.approx(0.707107, abs=1e-6)
    assert profiles.binned_trend(df.limit(1), "x", "y", [0.0, 2, 4]).first().error == 0.0
    with pytest.raises(ValueError):
        profiles.binned_trend(df, "x", "y", [0.0, 1], "range")


def test_bins_are_those_of_numpy(spark):
    edges = binning.uniform_edges(0, 1200, 100)
    rng = np.random.default_rng(1)
    xs = [*edges, *np.nextafter(edges, -1), *rng.uniform(-50, 1300, 500), math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [0] * 99
    for r in df.select(binning.histogram_bin(edges, F.col("x")).alias("b")).where("b is not null").groupBy("b").count().collect():
        got[r.b] = r["count"]
    assert got == np.histogram([x for x in xs if math.isfinite(x)], edges)[0].tolist()
    clamped = [r.b for r in df.select(binning.clamped_bin(edges, F.col("x")).alias("b")).collect()]
    assert clamped == np.clip(np.digitize(xs, edges) - 1, 0, 98).tolist()


def test_number_policy(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "n double, d double")
    n, d = F.col("n"), F.col("d")
    assert [r[0] for r in df.select(numeric.ratio(n, d)).collect()] == [None, None, None, 1.5, None]
    ieee = [r[0] for r in df.select(numeric.ieee_ratio(n, d)).collect()]
    assert ieee[:2] == [math.inf, -math.inf] and math.isnan(ieee[2]) and ieee[3] == 1.5
    assert [r[0] for r in df.select(numeric.ratio_or_zero(n, d)).collect()] == [None, None, 0.0, 1.5, None]
    assert df.select(numeric.correlation(F.lit(1.0), d)).first()[0] is None
    s = spark.createDataFrame([("[1, -2.5, 3e4]",), (None,)], "s string")
    assert [r[0] for r in s.select(numeric.numbers_in(F.col("s"))).collect()] == [[1.0, -2.5, 3.0, 4.0], None]


def test_features_with_absent_ids_and_odd_tags(spark):
    syn = spark.createDataFrame([(1, 7, 1, "E"), (2, 7, 1, "E"), (3, 8, 1, "I"), (4, 7, 2, "E"), (5, 7, 2, None)], "id_ long, pre_id long, post_id long, pre_clf_type string").withColumn("post_clf_type", F.lit("E"))
    tags = spark.createDataFrame([(1, "spine"), (2, "odd"), (3, "shaft"), (4, None), (9, "spine")], "target_id long, tag string")
    tagged = features.tag_join(syn, tags)
    ids = spark.createDataFrame([(7,), (8,), (99,)], "root_id long")
    assert {r.root_id: (r.ratio, r.n_syn) for r in features.spine_ratio(tagged, ids).collect()} == {7: (1 / 3, 3), 8: (0.0, 1), 99: (None, 0)}
    with pytest.raises(Exception, match="more than once"):
        features.tag_join(syn, tags.union(tags)).collect()
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert features.only_unique(twice, "k").collect() == [(2, "c")]


def test_fits_recover_their_parameters(spark):
    d = np.linspace(5, 900, 80)
    rows = [("a", float(x), float(fit.saturating(x, 0.82, 124.0)), 50) for x in d] + [("b", 1.0, 0.5, 3)]
    df = spark.createDataFrame(rows, "k string, x double, y double, n long")
    got = {r.k: r for r in fit.fits(df, ["k"], "x", "y", "n").collect()}
    assert got["a"].top == pytest.approx(0.82, abs=1e-4) and got["a"].half == pytest.approx(124, abs=0.1) and got["a"].r2 > 0.9999
    assert got["b"].top is None
    for true in ((0.1, 0.7, 160.0, 0.2, 80.0, 40.0), (0.3, 0.9, 110.0, 0.1, 60.0, 25.0), (0.05, 0.75, 250.0, 0.3, 45.0, 15.0)):
        bi = [("a", float(x), float(fit.biphasic(x, *true)), 50) for x in np.linspace(3, 1190, 200)]
        two = fit.fits(spark.createDataFrame(bi, df.schema), ["k"], "x", "y", "n", "biphasic").first()
        assert [two[name] for name, *_ in fit.BIPHASIC] == pytest.approx(true, rel=0.02, abs=0.005) and two.r2 > 0.9999
    with pytest.raises(ValueError):
        fit.fits(df, ["k"], "x", "y", "n", "cubic")


def test_p_values_are_those_of_the_t_table(spark):
    table = [(2.228, 10, 0.05), (3.169, 10, 0.01), (1.984, 100, 0.05), (12.706, 1, 0.05), (1.0, 2, 0.42264973), (4.0, 998, 6.8019510e-05), (2.0, 10**9 - 2, 0.0455002)]
    rows = [(t / math.sqrt(df + t * t), df + 2, p) for t, df, p in table] + [(0.0, 20, 1.0), (1.0, 9, 0.0), (-1.0000000001, 9, 0.0), (0.5, 2, None), (None, 9, None), (math.nan, 9, None)]
    rows += [(-r, n, p) for r, n, p in rows[:7]]
    df = spark.createDataFrame(rows, "r double, n long, want double").select("want", stats.p_value(F.col("r"), F.col("n")).alias("p"))
    for r in df.collect():
        assert r.p == (r.want if r.want is None else pytest.approx(r.want, rel=2e-3, abs=1e-12))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_spearman_with_ties_and_missing(spark):
    random.seed(1)
    rows = [(float(random.randint(0, 9)), random.choice([None, 1.0, 2.0, 5.0])) for _ in range(200)]
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["x", "y"]).dropna()
    got = stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert got.n == len(pdf) and got.rho == pytest.approx(pdf.rank().corr().iloc[0, 1])


def test_geometry(spark, tmp_path):
    (tmp_path / "11.swc").write_text("# id\n10 1 0 0 0 1 -1\n20 2 3 4 0 1 10\n35 3 3 4 12 1 20\n40 3 0 0 5 1 10\n")
    v = readers.swc(spark, str(tmp_path))
    assert sorted((r.vid, r.parent) for r in v.collect()) == [(0, -1), (1, 0), (2, 1), (3, 0)]
    assert geometry.path_length(v).first().length == pytest.approx(22.0)
    assert geometry.path_length(v, compartments=(1, 3)).first().length == pytest.approx(5.0)
    assert geometry.path_length(geometry.collapsed(v, (2,))).first().length == pytest.approx(0 + 13 + 5.0)
    assert {(r.vid, r.parent) for r in geometry.masked(v, F.col("compartment") != 2).collect()} == {(0, -1), (2, -1), (3, 0)}
    lines = sorted(r.vids for r in geometry.polylines(v).collect())
    assert sorted(map(len, lines)) == [4]
    ring = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1)], "root_id long, vid int, parent int")
    assert [len(r.vids) for r in geometry.polylines(ring).collect()] == [4]
    assert geometry.ribbons(geometry.polylines(v), v).count() == 8
    mesh = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0)], "seg_id long, vid int, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 0, 1)], "seg_id long, fid int, v0 int, v1 int, v2 int")
    tri = geometry.triangles(faces, mesh)
    assert {r.fid: r.shade for r in geometry.shading(tri, (0.0, 0.0, 1.0)).collect()} == {0: pytest.approx(1.0), 1: pytest.approx(0.3)}
    assert {r.fid: r.shade for r in geometry.shading(tri, (0.0, 0.0, -1.0)).collect()} == {0: pytest.approx(0.3), 1: pytest.approx(0.3)}  # turned away
    assert {r.fid: r.shade for r in geometry.shading(tri).collect()}[0] == pytest.approx(0.3 + 0.7 / math.sqrt(0.3**2 + 0.5**2 + 1))
    assert geometry.cropped(tri, (0.5, 2), (-1, 0.5)).count() == 2 and geometry.cropped(tri, (5, 6), (5, 6)).count() == 0


@pytest.mark.parametrize("region", [3, 10, 200_000])
def test_nearest_is_that_of_all_pairs(spark, region):
    rng = np.random.default_rng(2)
    p, s = rng.uniform(0, 10, (60, 3)), rng.uniform(0, 10, (25, 3))
    p[0] = [30, 30, 30]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "vid long, x double, y double, z double")
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "site_id long, x double, y double, z double")
    got = {r.vid: r.site_id for r in geometry.nearest(points, sites, region=region).collect()}
    assert got == {i: int(((s - x) ** 2).sum(1).argmin()) for i, x in enumerate(p)}


def test_nearest_with_odd_rows_and_dense_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE", 12)
    rng = np.random.default_rng(4)
    p, s = rng.normal(0, 0.01, (60, 3)), rng.normal(0, 0.01, (50, 3))
    p[:3] = [[5, 5, 5], [-2, 0, 3], [0, 0, 0]]
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(5, *map(float, p[5])), (100, None, 1.0, 1.0), (101, math.nan, 1.0, 1.0), (102, 1.0, math.inf, 1.0)]
    points = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)] + [(77, None, 0.0, 0.0), (78, math.nan, 0.0, 0.0)], "site_id long, x double, y double, z double")
    got = sorted((r.vid, -1 if r.site_id is None else r.site_id) for r in geometry.nearest(points, sites, region=7).collect())
    want = [(i, int(((s - x) ** 2).sum(1).argmin())) for i, x in enumerate(p)]
    assert got == sorted([*want, want[5], (100, -1), (101, -1), (102, -1)])
    assert {r.site_id for r in geometry.nearest(points, sites.limit(0)).collect()} == {None}
    assert geometry.nearest(points.limit(0), sites).count() == 0


def test_places_do_not_hang_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(6)
    values = [None if rng.random() < 0.05 else float(rng.integers(0, 300)) for _ in range(3000)]
    df = spark.createDataFrame([(k, v, int(rng.integers(0, 4))) for k, v in enumerate(values)], "root_id long, v double, k int")
    import pandas as pd

    known = pd.Series([v for v in values if v is not None])
    box = {}
    for parts, shuffle in ((1, "3"), (17, "5"), (4, "64")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            some = df.repartition(parts)
            assert {r.root_id: r.matrix_idx for r in graph.matrix_index(some).collect()} == {k: k for k in range(3000)}
            ranked = {r.v: r.rk for r in stats.ranks(some.where("v IS NOT NULL"), "v", "rk").select("v", "rk").collect()}
            assert ranked == dict(zip(known, known.rank(), strict=True))
            box[parts] = sorted(map(tuple, stats.box(some, "v", "k").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({repr([[round(x, 9) for x in r] for r in rows]) for rows in box.values()}) == 1


def test_valid_network_of_hand_sized_rows(spark):
    neurons = spark.createDataFrame([(1, "E", 10.0, 5.0, 4, 0.5, 2, 1, 1, 99), (2, "I", 10.0, 5.0, 4, 0.5, 4, 0, 0, 99), (3, "E", 0.0, 5.0, 4, 0.5, 4, 0, 0, 99), (4, "E", 1.0, 1.0, 4, None, 4, 0, 0, 99)],
                                    "root_id long, clf_type string, dendrite_length double, axon_length double, ds_num_of_incoming_synapses long, ds_spine_ratio double, ds_spine long, ds_shaft long, ds_soma long, in_synapses long")
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (1, 3, 7), (1, 1, 1)], "pre_id long, post_id long, n_syn long")
    typed = graph.typed(edges, neurons)
    valid, own = features.valid_network(neurons, typed)
    assert {r.root_id: (r.in_synapses, r.in_neurons, r.ex_in_synapses, r.out_synapses, r.contacts) for r in valid.collect()} == {1: (3, 2, 1, 4, 1.5), 2: (3, 1, 3, 2, 3.0)}
    assert own.count() == 3 and features.inconsistent(valid, own).count() == 0
    assert {r.root_id for r in features.inconsistent(valid, typed).collect()} == {1, 3}
    with pytest.raises(ValueError):
        features.valid_network(neurons, typed, 2.0)


def test_equal_width_bins_labels_and_errors(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1, None if k % 2 else 5.0) for k in range(16)], "x double, y double, z double")
    rows = {(r.series, r.bin): r for r in profiles.labelled_trends(df, "x", ["y", "z"], 4).collect()}
    assert len(rows) == 8 and rows["y", 0].n == 4 and rows["y", 3].n == 4 and rows["z", 0].n == 2
    assert rows["y", 1].r == pytest.approx(1.0) and rows["y", 1].slope == pytest.approx(2.0) and rows["z", 1].r is None
    with pytest.raises(ValueError):
        profiles.equal_edges(df.limit(0), "x", 4)


def test_spearman_p(spark):
    df = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate([1, 3, 2, 5, 4, 7, 6, 9, 8, 10])], "x double, y double")
    r = stats.spearman(df, "x", "y", with_p=True).first()
    rho = 1 - 6 * 8 / (10 * 99)
    t = rho * math.sqrt(8 / (1 - rho * rho))
    assert r.rho == pytest.approx(rho) and r.stars == "***" and r.p == pytest.approx(2.28e-5, rel=0.01) and t > 8


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "n.csv").write_text(",root_id,center_position\n0,864691135000000001,\"[1, 2, -3.5]\"\n")
    df = readers.positions(readers.csv(spark, str(tmp_path / "n.csv"), "root_id long, center_position string", index_column=True))
    r = df.first()
    assert (r.root_id, r.x_t, r.y_t, r.z_t) == (864691135000000001, 1.0, 2.0, -3.5)
    np.savez(tmp_path / "m.npz", indptr=np.array([0, 1, 2]), indices=np.array([1, 0]), data=np.array([3, 0]), format=np.array(b"csr"), shape=np.array([2, 2]))
    assert readers.sparse_matrix(spark, str(tmp_path / "m.npz"), {0: 100, 1: 200}).collect() == [(200, 100, 3)]
    spark.createDataFrame([(1, 2.0), (1, 3.0), (4, 1.0)], "post_id long, size double").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("post_id long, size double").parquet(str(tmp_path / "s"))
    q = incremental.running_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("select * from deg").collect()) == [(1, 2, 5.0), (4, 1, 1.0)]


def test_meshes_and_arrays(spark, tmp_path):
    vertices, faces = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0.5]]), np.array([[0, 1, 2]])
    np.save(tmp_path / "v.npy", vertices)
    np.save(tmp_path / "f.npy", faces)
    readers.ingest_mesh(spark, str(tmp_path / "m"), 7, str(tmp_path / "v.npy"), str(tmp_path / "f.npy"), split=2)
    v, f = readers.mesh(spark, str(tmp_path / "m"), 7)
    assert [tuple(r) for r in v.orderBy("vid").collect()] == [(7, k, *map(float, x)) for k, x in enumerate(vertices)] and f.collect() == [(7, 0, 0, 1, 2)]
    with pytest.raises(FileNotFoundError):
        readers.mesh(spark, str(tmp_path / "m"), 8)
    readers.write_array(v, "x", "vid", str(tmp_path / "x.npy"))
    assert np.load(tmp_path / "x.npy").tolist() == [0.0, 1.0, 0.0]


def test_incoming_synapses_of_nested_records_and_images(spark, tmp_path):
    rows = [(1, [(10, 2, 1, 5, [4.0, 8.0, 2.0])]), (2, []), (3, None)]
    objects = spark.createDataFrame(rows, "root_id long, pre_synapses array<struct<id_:long,pre_pt_root_id:long,post_pt_root_id:long,size:long,center_position:array<double>>>")
    got = readers.incoming_synapses(objects).collect()
    assert [(r.root_id, r.id_, r.pre_pt_root_id, r.size, r.cell_type) for r in got] == [(1, 10, 2, 5, "Unk")]
    assert (got[0].x, got[0].y, got[0].z) == pytest.approx((0.016, 0.032, 0.08))
    (tmp_path / "b.png").write_bytes(b"two")
    (tmp_path / "a.png").write_bytes(b"one")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert [bytes(r.content) for r in readers.images(spark, str(tmp_path)).collect()] == [b"one", b"two"]
