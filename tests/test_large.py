"""Operators that replace all pairs, whole arrays and exploded grids: the same answers as those, on more rows."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiring.functions import md5
from wiring.operators import features, fit, geometry, graph, nullmodel, profiles, stats
from wiring.operators.nearest import KdTree, nearest_within
from wiring.sources import readers

POINT = "vid long, x double, y double, z double"
SITE = "site_id long, x double, y double, z double"


def all_pairs(p, s, ids):
    d2 = sum((p[:, None, c] - s[None, :, c]) ** 2 for c in range(3))
    return np.array([ids[row == row.min()].min() for row in d2])


@pytest.mark.parametrize("kind", ["spread", "grid", "one place", "line"])
def test_tree_is_that_of_all_pairs_ties_included(kind):
    rng = np.random.default_rng(1)
    s, p = rng.random((2000, 3)), rng.random((1500, 3)) * 1.4 - 0.2
    if kind == "grid":
        s, p = rng.integers(0, 5, s.shape) / 1.0, rng.integers(0, 9, p.shape) / 2.0
    elif kind == "one place":
        s = np.zeros_like(s)
    elif kind == "line":
        s[:, 1:] = 0
    ids = rng.permutation(len(s)).astype(np.int64)
    assert (KdTree(s, ids).nearest(p)[0] == all_pairs(p, s, ids)).all()


def test_tree_takes_linear_log_time_in_one_crowded_cell():
    rng = np.random.default_rng(2)
    took = []
    for n in (50_000, 200_000):
        s, p = rng.normal(0, 1e-6, (n, 3)), rng.normal(0, 1e-6, (n, 3))
        began = time.time()
        ids, d2 = KdTree(s, np.arange(n)).nearest(p)
        took.append(time.time() - began)
        some = rng.integers(0, n, 50)
        assert (ids[some] == all_pairs(p[some], s, np.arange(n))).all()
    assert took[1] < 10 * took[0]  # all pairs would take 16 times as long


def test_nearest_over_many_regions_with_copies_of_points_and_sites(spark):
    rng = np.random.default_rng(3)
    s, p = rng.normal(0, 1, (4000, 3)), rng.normal(0, 1.5, (3000, 3))
    s[2000:3500], p[1000:2000] = s[0], p[0]  # a third of all rows at one place
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], SITE)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], POINT)
    got = {r.vid: r.site_id for r in geometry.nearest(points, sites, region=100).collect()}
    assert [got[i] for i in range(len(p))] == all_pairs(p, s, np.arange(len(s))).tolist()


def test_nearest_within_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, *map(float, rng.random(3))) for g in range(4) for i in range(40)] + [(9, 0, 1.0, 1.0, 1.0), (0, 100, None, 1.0, 1.0)]
    sites = [(g, i, *map(float, rng.random(3))) for g in range(4) for i in range(g + 1)] + [(1, 7, math.nan, 0.0, 0.0)]
    got = {(r.seg, r.vid): r.site_id for r in nearest_within(spark.createDataFrame(rows, "seg long, " + POINT), spark.createDataFrame(sites, "seg long, " + SITE), "seg", block=15).collect()}
    want = {}
    for g, i, *p in rows:
        near = [(sum((a - b) ** 2 for a, b in zip(p, s, strict=True)), k) for h, k, *s in sites if h == g and not math.isnan(s[0])] if None not in p else []
        want[g, i] = min(near)[1] if near else None
    assert got == want


def test_nearest_within_many_groups_across_batches(spark):
    rng = np.random.default_rng(8)
    sizes = [(1, 3), (5, 0), (0, 4), (30, 70), (4, 2), (9, 2), (1, 1)] * 3  # points and sites; 70 are searched with a tree
    rows = [(f"n{g}", i, *map(float, rng.integers(0, 4, 3))) for g, (n, _) in enumerate(sizes) for i in range(n)]
    sites = [(f"n{g}", int(i), *map(float, rng.integers(0, 4, 3))) for g, (_, n) in enumerate(sizes) for i in rng.permutation(n)]
    want = {}
    for g, i, *p in rows:
        near = [(sum((a - b) ** 2 for a, b in zip(p, s, strict=True)), k) for h, k, *s in sites if h == g]
        want[g, i] = min(near) if near else (None, None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = nearest_within(spark.createDataFrame(rows, "seg string, " + POINT), spark.createDataFrame(sites, "seg string, " + SITE), "seg").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(rows) and {(r.seg, r.vid): (r.d2, r.site_id) for r in found} == want


def test_nearest_within_takes_no_longer_for_many_small_groups(spark):
    def took(groups: int) -> float:
        points, sites = (spark.range(32_000).selectExpr(f"id % {groups} AS seg", f"id AS {name}", "rand(1) AS x", "rand(2) AS y", "rand(3) AS z") for name in ("vid", "site_id"))
        found = nearest_within(points, sites, "seg")
        began = time.time()
        assert found.count() == 32_000
        return time.time() - began

    took(4)
    assert took(8000) < 5 * took(4) + 2


def test_dendrite_mesh_by_hand(spark):
    v = spark.createDataFrame([(7, k, float(x), 0.0, 0.0) for k, x in enumerate((0, 1, 2, 10, 11))] + [(8, 0, 5.0, 5.0, 5.0)], "seg_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(7, 0, 0, 1, 2), (7, 1, 1, 2, 3), (7, 2, 2, 1, 0)], "seg_id long, fid long, v0 long, v1 long, v2 long")
    bones = spark.createDataFrame([(7, 0, 4, 0.002, 0.0, 0.0), (7, 1, 2, 0.0, 0.0, 0.0), (7, 2, 3, 0.0105, 0.0, 0.0)], "root_id long, vid long, compartment int, x double, y double, z double")
    kept, faces = geometry.dendrite_mesh(v, f, bones, scale=1000.0)
    # vertex 0 is nearest to the axon; vertex 1 is as near to both and copies the least vid; segment 8 has no skeleton
    assert sorted((r.seg_id, r.old_vid, r.vid) for r in kept.collect()) == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (7, 4, 3), (8, 0, 0)]
    assert [tuple(r) for r in faces.collect()] == [(7, 1, 0, 0, 1, 2)]
    kept, faces = geometry.dendrite_mesh(v.limit(0), f, bones)
    assert kept.count() == 0 and faces.count() == 0


def test_drawing_leaves_the_root_and_short_lines_out(spark):
    rows = [(1, 0, -1), (1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 0, -1), (2, 1, 0), (2, 2, 1)]
    v = spark.createDataFrame([(r, k, p, float(k), float(k * k), 0.0, 0.5, 3) for r, k, p in rows], "root_id long, vid long, parent long, x double, y double, z double, radius double, compartment int")
    got = geometry.drawing(v, ("x", "z"), 2.0).orderBy("root_id", "line", "place").collect()
    # neuron 1: 3-0-1-2 is one line, as 0 has two neighbours; without 0 it goes from 3 over 1 to 2 or back
    assert [sorted({r.vid for r in got if r.root_id == k}) for k in (1, 2)] == [[1, 2, 3], [1, 2]]
    assert [(r.x, r.y, r.vid) for r in got if r.root_id == 2] == [(1.0, 1.0, 1), (2.0, 1.0, 2), (2.0, -1.0, 2), (1.0, -1.0, 1)]
    assert geometry.drawing(v, skip_root=False).where("vid = 0").count() == 4


def test_array_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = rng.random((1003, 3))
    np.save(tmp_path / "v.npy", rows)
    np.savez_compressed(tmp_path / "v.npz", vertices=rows.astype(np.float32), faces=np.arange(12).reshape(4, 3))
    df = readers.array_rows(spark, str(tmp_path / "v.npy"), dict.fromkeys("xyz", "double"), split=100)
    assert df.rdd.getNumPartitions() == 11
    assert [(r.x, r.y, r.z) for r in df.orderBy("row").collect()] == [tuple(r) for r in rows.tolist()]
    df = readers.array_rows(spark, "file://" + str(tmp_path / "v.npz"), {"a": "int", "b": "int"}, "faces", split=3)
    assert sorted(map(tuple, df.collect())) == [(0, 0, 1), (1, 3, 4), (2, 6, 7), (3, 9, 10)]
    np.save(tmp_path / "bad.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="pickled"):
        readers.array_rows(spark, str(tmp_path / "bad.npy"), {"a": "int"}).count()
    with pytest.raises(Exception, match="mounted storage"):
        readers.array_rows(spark, "hdfs://x/v.npy", {"a": "int"}).count()


@pytest.mark.parametrize("kind", ["csr", "csc"])
def test_matrices_are_read_and_written_in_ranges(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    dense = rng.integers(0, 3, (70, 50)) * (rng.random((70, 50)) < 0.2)
    dense[10:20] = 0  # rows without entries, on the edges of ranges too
    by = dense if kind == "csr" else dense.T
    indptr = np.concatenate([[0], np.cumsum((by != 0).sum(1))])
    np.savez_compressed(tmp_path / "m.npz", indptr=indptr.astype(np.int32), indices=np.nonzero(by)[1].astype(np.int32), data=by[by != 0], format=np.array(kind.encode()), shape=np.array(dense.shape))
    cells = readers.matrix_cells(spark, str(tmp_path / "m.npz"), split=17)
    want = sorted((int(r), int(c), float(dense[r, c])) for r, c in zip(*np.nonzero(dense), strict=True))
    assert sorted(map(tuple, cells.collect())) == want and cells.rdd.getNumPartitions() == -(-len(want) // 17)
    readers.write_matrix(cells, str(tmp_path / "parts"))
    assert sorted(map(tuple, readers.matrix_cells(spark, str(tmp_path / "parts"), split=9).collect())) == want
    readers.write_matrix(cells.limit(0), str(tmp_path / "none"))
    ids = spark.createDataFrame([(k, 100 + k) for k in range(0, 70, 2)], "idx long, root_id long")
    got = readers.sparse_matrix(spark, str(tmp_path / "m.npz"), ids, split=17)
    assert sorted(map(tuple, got.collect())) == sorted((100 + c, 100 + r, int(v)) for r, c, v in want if r % 2 == 0 and c % 2 == 0)


@pytest.mark.parametrize("fineness", [64, 2048])
def test_binned_density_is_that_of_the_direct_sum(spark, fineness):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(50, 9, 400), "b": np.concatenate([rng.normal(0, 1, 300), [500.0]]), "c": np.array([3.0, 3.0, 3.0]), "d": np.array([4.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", math.nan), ("a", math.inf), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    grid = [float(x) for x in np.linspace(-20, 520, 541)]
    for bandwidth in (None, 2.5):
        got = {}
        for r in stats.density(df, "v", "k", grid, bandwidth, fineness=fineness).collect():
            got.setdefault(r.k, {})[r.x] = r.density
        assert sorted(got) == (["a", "b"] if bandwidth is None else ["a", "b", "c", "d"])
        for k, curve in got.items():
            v = groups[k]
            bw = bandwidth or v.std(ddof=1) * len(v) ** -0.2
            want = np.exp(-(((np.array(grid)[:, None] - v) / bw) ** 2) / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
            assert np.abs(np.array([curve[x] for x in grid]) - want).max() < 1e-4 * want.max()


def test_fliers_are_those_that_box_counts(spark):
    rows = [("a", float(x)) for x in [1, 2, 2, 3, 3, 4, 50, 50, -40]] + [("b", 1.0), ("b", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert sorted(map(tuple, stats.fliers(df, "v", "k").collect())) == [("a", -40.0, 1), ("a", 50.0, 2)]
    assert {r.k: r.beyond for r in stats.box(df, "v", "k").collect()} == {"a": 3, "b": 0}


def test_reindexing_keeps_the_old_order(spark):
    mapping = spark.createDataFrame([(0, 50), (1, 7), (2, 99), (3, 1), (4, 30)], "idx long, root_id long")
    cells = spark.createDataFrame([(0, 1, 5), (1, 3, 2), (3, 3, 1), (4, 0, 9)], "row long, col long, n_syn long")
    ids = spark.createDataFrame([(1,), (7,), (7,), (50,), (1000,)], "root_id long")
    left, new = graph.reindexed(cells, mapping, ids)
    assert sorted(map(tuple, new.collect())) == [(0, 50), (1, 7), (2, 1)]
    assert sorted(map(tuple, left.collect())) == [(0, 1, 5), (1, 2, 2), (2, 2, 1)]
    with pytest.raises(ValueError):
        graph.reindexed(cells, mapping, ids.where("root_id = 1000"))


def test_partners_whole_rows(spark):
    neurons = spark.createDataFrame([(1, "E", "x", 5), (2, "I", "y", 6), (3, "E", None, 7)], "root_id long, clf_type string, cell_type string, n int")
    edges = spark.createDataFrame([(1, 3, "E", 2), (2, 3, "I", 1), (9, 3, "E", 1), (3, 3, "E", 4), (1, 2, "E", 1)], "pre_id long, post_id long, pre_type string, n_syn long")
    assert sorted(graph.partner_rows(edges, neurons, 3).collect(), key=lambda r: r.root_id) == [(1, "E", "x", 5, 2), (2, "I", "y", 6, 1), (3, "E", None, 7, 4)]
    assert [r.root_id for r in graph.partner_rows(edges, neurons, 3, "I").collect()] == [2] and graph.partner_rows(edges, neurons, 1).count() == 0


def test_features_of_all_replicates_are_those_of_each(spark):
    random.seed(8)
    neurons = spark.createDataFrame([(i, "E" if i % 3 else "I", 10.0 * i, 99) for i in range(20)], "root_id long, clf_type string, dendrite_length double, in_synapses long")
    pairs = {(random.randrange(18), random.randrange(18)) for _ in range(60)}
    edges = graph.typed(spark.createDataFrame([(a, b, 1) for a, b in pairs], "pre_id long, post_id long, n_syn long"), neurons)
    graphs = nullmodel.shuffled(edges, 4, 5).persist()
    names = ["root_id", "in_synapses", "ex_in_neurons", "inh_out_synapses", "contacts", "syn_density"]
    got = features.connectivity_features(neurons, graphs, replicas=4).select("replica", *names).collect()
    want = [(k, *r) for k in range(4) for r in features.connectivity_features(neurons, graphs.where(F.col("replica") == k)).select(*names).collect()]
    assert len(got) == 80 and sorted(map(tuple, got), key=str) == sorted(want, key=str)
    graphs.unpersist()


@pytest.mark.parametrize("top, half", [(0.9, 30_000.0), (0.5, 1e6), (1.0, 300.0), (0.3, 1e-3), (0.7, 12.0)])
def test_saturating_fit_has_no_upper_bound(top, half):
    d = np.arange(15.0, 1200.0, 30.0)
    found = fit.fit_saturating(d, top * d / (d + half), np.arange(1.0, len(d) + 1))
    assert found == pytest.approx((top, half), rel=1e-3)
    assert fit.fit_saturating(d, 0 * d, d) == (0.0, 1e-5)


def test_population_and_neurons_cross_by_their_own_rules_and_bins(spark):
    rows = [(1, 2.0, "spine"), (1, 3.0, "spine"), (1, 12.0, "spine"), (2, 4.0, "spine"), (2, 13.0, "shaft"), (2, 14.0, "shaft"), (2, 33.0, "spine"), (2, 34.0, "spine")]
    df = spark.createDataFrame([(*r, "E") for r in rows], "pre_id long, dist double, tag string, post_clf_type string")
    edges, own = [0.0, 10.0, 20.0, 30.0, 40.0], [0.0, 20.0, 40.0]
    for average, second in (("macro", 0.5), ("micro", 1 / 3)):
        got = profiles.axon_profile(df, edges, [1, 2], own, average, least=1).collect()
        assert {r.series: r.crossing for r in got if r.series != "2"} == {"all": 5.0, "1": 0.0}
        assert {r.bin: r.share for r in got if r.series == "all"} == pytest.approx({0: 1.0, 1: second, 3: 1.0})
        two = {r.bin: (r.centre, r.n, r.share) for r in got if r.series == "2"}
        assert two == {0: (10.0, 3, pytest.approx(1 / 3)), 1: (30.0, 2, 1.0)}
        assert next(r.crossing for r in got if r.series == "2") == pytest.approx(10 + 20 * (0.5 - 1 / 3) / (2 / 3))
    with pytest.raises(ValueError):
        profiles.axon_profile(df, edges, [1], average="mean")


def test_wanted_skeletons(spark):
    v = spark.createDataFrame([(1, 0, -1), (1, 1, 0)], "root_id long, vid int, parent int")
    got = readers.wanted(spark.createDataFrame([(1,), (2,), (2,)], "root_id long"), v).collect()
    assert sorted((r.root_id, r.vid, r.found) for r in got if r.found) == [(1, 0, True), (1, 1, True)]
    assert [(r.root_id, r.vid, r.found) for r in got if not r.found] == [(2, None, False)]


def test_replicates_in_batches_are_those_of_one_plan_and_leave_no_shuffles(spark):
    edges = spark.createDataFrame([(k % 13, k % 17, "EI"[k % 13 % 2], "EI"[k % 17 % 2], 1) for k in range(150)], "pre_id long, post_id long, pre_type string, post_type string, n_syn long")
    neurons = spark.createDataFrame([(k, "EI"[k % 2], 10.0) for k in range(17)], "root_id long, clf_type string, dendrite_length double")
    whole = features.connectivity_features(neurons, nullmodel.shuffled(edges, 5, 3), replicas=5)
    parts = nullmodel.by_batches(edges, 5, 3, lambda graphs, first, n: features.connectivity_features(neurons, graphs, n, first), size=300)
    assert sorted(map(str, parts.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert len({f.rsplit("/", 1)[0] for f in parts.inputFiles()}) == 3  # two replicates at once
    assert spark.conf.get(nullmodel._CLEANUP, "false") == "false"


def test_shuffled_edges_are_dealt_once_for_both_sides(spark):
    edges = spark.createDataFrame([(k % 13, k % 17, "EI"[k % 13 % 2], "EI"[k % 17 % 2], 1) for k in range(150)], "pre_id long, post_id long, pre_type string, post_type string, n_syn long")
    plan = graph.shared_input(nullmodel.shuffled(edges, 3, 7), ("replica",))._jdf.queryExecution().executedPlan().toString()
    every = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # dealing, places, sources, targets; sizes of ranges, their sums and the pairs of types are small
    small = [line for line in every if "lane" in line or "block" in line]
    assert len(every) - len(small) == 4


def test_array_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    rows = spark.range(5000).select(((F.col("id") * 7 + 3) % 5000).alias("k"), (F.col("id") / 2).alias("x"), "id").repartition(6)
    readers.write_rows(rows, ["x", "id"], "k", 5000, str(tmp_path / "a.npy"))
    readers.write_rows(rows, ["id", "k"], "k", 5000, str(tmp_path / "b.npy"))
    ids = np.arange(5000)
    want = np.empty((5000, 2))
    want[(ids * 7 + 3) % 5000] = np.stack([ids / 2, ids], 1)
    assert (np.load(tmp_path / "a.npy") == want).all()
    assert np.load(tmp_path / "b.npy").dtype == np.int64 and (np.load(tmp_path / "b.npy")[:, 1] == ids).all()
    with pytest.raises(ValueError, match="4999 of 5000"):
        readers.write_rows(rows.where("k <> 7"), ["x"], "k", 5000, str(tmp_path / "c.npy"))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a.npy", "b.npy"]


def test_many_neurons_are_fitted_side_by_side_as_each_alone():
    rng = np.random.default_rng(5)
    d = np.sort(rng.uniform(1, 1200, (3000, 8)), 1)
    top, half = rng.uniform(0.1, 1, 3000), 10 ** rng.uniform(0, 4, 3000)
    y = top[:, None] * d / (d + half[:, None])
    y[:5], w = 0, rng.integers(1, 9, d.shape).astype(float)
    began = time.time()
    found = fit.fit_saturating_all(d, y, w)
    together = time.time() - began
    began = time.time()
    alone = [fit.fit_saturating(*one) for one in zip(d[:300], y[:300], w[:300], strict=True)]
    assert np.allclose(np.stack(found, 1)[:300], alone, rtol=1e-6)
    assert found[0][5:] == pytest.approx(top[5:], rel=1e-3) and set(found[1][:5]) == {1e-5}
    assert together / 3000 < (time.time() - began) / 300


def test_fits_over_common_bins_cost_less_than_one_grid_of_curves():
    rng = np.random.default_rng(6)
    d = np.tile(np.arange(15.0, 1200, 30), (2000, 1))
    w = rng.integers(2, 9, d.shape)
    y = rng.binomial(w, 0.5) / w
    halves = np.exp(np.linspace(np.log(1e-5), np.log(12_000), 420))
    began = time.time()
    for k in range(0, 2000, 8):
        f = d[k : k + 8, None] / (d[k : k + 8, None] + halves[:, None])
        top = (w[k : k + 8, None] * y[k : k + 8, None] * f).sum(2) / (w[k : k + 8, None] * f * f).sum(2)
        (w[k : k + 8, None] * (y[k : k + 8, None] - np.clip(top, 0, 1)[:, :, None] * f) ** 2).sum(2)
    grid = time.time() - began
    began = time.time()
    top, half = fit.fit_saturating_all(d, y, w)
    assert time.time() - began < grid / 2
    loss = [(w * (y - top[:, None] * d / (d + half[:, None] * by)) ** 2).sum(1) for by in (0.999, 1, 1.001)]
    inside = (half > 1e-5) & (half < 12_000)  # no fit at an end of the search
    assert inside.sum() > 300 and (loss[1] <= np.minimum(loss[0], loss[2]) + 1e-12)[inside].all()


def test_a_bin_takes_each_edge_once(spark):
    bins = profiles.histogram_bin(list(map(float, range(41))), F.col("id"))
    plan = spark.range(9).select(bins.alias("bin")).where("bin IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") <= 45  # the filter and the bin; three times the edges each make code too long to be compiled


def test_edges_are_counted_in_tasks_whose_rows_do_not_grow(spark, monkeypatch):
    from wiring.functions import scratch
    from wiring.plans import catalog
    from wiring.sources.fixture import Fixture

    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    fx = Fixture(spark, "/root/testdata/sf0.001")
    want = -(-fx.table("lineitem").count() // 500)
    assert fx.parts == want > 4
    plan = catalog.QUERIES["reassembled_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {want}), REPARTITION_BY_NUM" in plan and "Union" not in plan and plan.count("lineitem.parquet") == 1
    sweep = catalog.QUERIES["subnetwork_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("network" in line and f", {want}), REPARTITION_BY_NUM" in line for line in sweep.splitlines())


ODD_EDGES = [(k % 13 * 7**(k % 9), k % 17 * 7**(k % 7), "EIX"[k % 13 % 3], "EI"[k % 17 % 2], 1) for k in range(400)] + [
    (None, 5, "E", "I", 1), (6, None, "E", "I", 2), (3, 3, "E", "E", 1), (-(2**62), 2**62, "E", "I", 1), (1, 4, None, "I", 1), (1, 40, "X", None, 1), (0, 2, "E", "E", 1), (0, 2, "E", "E", 3), (0, 99, "I", "E", 3)]


@pytest.mark.parametrize("keep_types, by_block", [(True, False), (True, True), (False, False), (False, True)])
def test_shared_input_of_whole_replicates_is_that_of_dealt_ones(spark, monkeypatch, keep_types, by_block):
    edges = spark.createDataFrame(ODD_EDGES, "pre_id long, post_id long, pre_type string, post_type string, n_syn long")
    got = nullmodel.null_shared_input(edges, 5, 3, keep_types, by_block)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # nothing of a replicate is sent
    monkeypatch.setattr(nullmodel.replicates, "WHOLE_EDGES", 0)
    want = nullmodel.null_shared_input(edges, 5, 3, keep_types, by_block)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert nullmodel.null_shared_input(edges.limit(0), 5, 3, keep_types, by_block).count() == 0


def test_features_of_whole_replicates_are_those_of_dealt_ones(spark, monkeypatch):
    edges = spark.createDataFrame(ODD_EDGES, "pre_id long, post_id long, pre_type string, post_type string, n_syn long")
    neurons = edges.select(F.col("pre_id").alias("root_id"), F.lit("E").alias("clf_type"), F.lit(10.0).alias("dendrite_length"), F.lit(9).alias("in_synapses"))
    got = nullmodel.replica_features(neurons, edges, 5, 3)
    none = nullmodel.replica_features(neurons, edges.limit(0), 2, 3)
    monkeypatch.setattr(nullmodel.replicates, "WHOLE_EDGES", 0)
    want = nullmodel.replica_features(neurons, edges, 5, 3)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert none.count() == 2 * neurons.count() and none.where("in_synapses + out_neurons > 0").count() == 0


@pytest.mark.parametrize("length", [0, 1, 13, 46, 47, 80])
def test_md5_side_by_side(length):
    texts = np.random.default_rng(length).integers(0, 256, (40, length), dtype=np.uint8)
    want = [hashlib.md5(b"7-1-pre-" + t.tobytes()).hexdigest() for t in texts]
    assert [f"{a:016x}{b:016x}" for a, b in zip(md5.digests(b"7-1-pre-", texts), md5.digests(b"7-1-pre-", texts, low=True))] == want


@pytest.mark.parametrize("keep_types, diagonal", [(True, False), (False, False), (True, True)])
def test_replicates_joined_by_parts_in_batches_are_those_of_one_plan(spark, monkeypatch, keep_types, diagonal):
    edges = spark.createDataFrame(ODD_EDGES, "pre_id long, post_id long, pre_type string, post_type string, n_syn long")
    neurons = edges.select(F.col("pre_id").alias("root_id"), F.col("pre_type").alias("clf_type")).union(edges.select("post_id", "post_type")).where("root_id IS NOT NULL AND root_id <> 3").distinct()
    of = neurons if diagonal else None
    want = nullmodel.shuffled(edges, 4, 3, keep_types, diagonal_of=of)
    monkeypatch.setattr(nullmodel.replicates, "PART_ROWS", 20)
    monkeypatch.setattr(nullmodel.replicates, "BUCKETS", 2)  # buckets that lie on cuts, and empty ones
    got = nullmodel.shuffled(edges, 4, 3, keep_types, diagonal_of=of, size=900)
    assert got.schema.simpleString() == want.schema.simpleString() and want.count() > 900
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) == 2  # written by batches, so their shuffles are gone
    assert spark.conf.get(nullmodel._CLEANUP, "false") == "false"
