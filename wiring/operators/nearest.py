"""The nearest site of every point: regions of space from a sample, a k-d tree in each."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiring.functions.numeric import finite

REGION = 200_000  # sites of a region, and points of a block, that a task holds at once
SAMPLE = 50_000  # sites, about, that lay out the regions and bound distances; they decide no result
_LEAF = 24


class KdTree:
    """Sites in a tree of medians, each node with the box around its sites.

    ``nearest`` first takes every point down to its own leaf, then walks the tree once with all points
    and drops, at each node, those whose best is closer than the node's box.  Distances to boxes and
    sites are summed in the same order, so rounding never drops a site that is as near; of equally near sites the
    least id wins.
    """

    def __init__(self, xyz: np.ndarray, ids: np.ndarray, leaf: int = _LEAF):
        order = np.lexsort((ids, xyz[:, 2], xyz[:, 1], xyz[:, 0]))
        xyz, ids = xyz[order], ids[order]
        first = np.ones(len(ids), bool)  # of sites at one place only the least id can win
        first[1:] = (xyz[1:] != xyz[:-1]).any(1)
        self.xyz, self.ids = xyz[first], ids[first]
        self.low, self.high, self.split, self.children, self.sites = [], [], [], [], []
        if len(self.ids):
            self._grow(np.arange(len(self.ids)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        node, own = len(self.low), self.xyz[rows]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        for part in (self.split, self.children, self.sites):
            part.append(None)
        if len(rows) <= leaf:
            self.sites[node] = rows[np.argsort(self.ids[rows], kind="stable")]
            return node
        axis = int((self.high[node] - self.low[node]).argmax())
        order = rows[np.argpartition(own[:, axis], len(rows) // 2)]
        left, right = order[: len(rows) // 2], order[len(rows) // 2 :]
        self.split[node] = (axis, float(self.xyz[right, axis].min()))
        self.children[node] = (self._grow(left, leaf), self._grow(right, leaf))
        return node

    def leaves(self) -> list[int]:
        return [n for n, rows in enumerate(self.sites) if rows is not None]

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        """The number of the leaf into which each point falls."""
        found = np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            if self.sites[node] is not None:
                found[rows] = node
            elif len(rows):
                axis, at = self.split[node]
                right = p[rows, axis] >= at
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return found

    def away(self, node: int, p: np.ndarray) -> np.ndarray:
        """Squared distance of points to a node's box."""
        gap = np.maximum(np.maximum(self.low[node] - p, p - self.high[node]), 0.0)
        return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]

    def fit_boxes(self, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Take other boxes for the leaves, none for those that ``boxes`` lacks, and give every node the one around its leaves."""
        none = np.full(3, np.inf), np.full(3, -np.inf)
        for node in range(len(self.low) - 1, -1, -1):  # children come after their parents
            if self.sites[node] is not None:
                self.low[node], self.high[node] = boxes.get(node, none)
            else:
                a, b = self.children[node]
                self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def within(self, p: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of points and leaves whose boxes are no farther than the point's ``reach`` (squared)."""
        rows_found, leaves_found, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            rows = rows[self.away(node, p[rows]) <= reach[rows]]
            if not len(rows):
                continue
            if self.sites[node] is None:
                todo += [(child, rows) for child in self.children[node]]
            else:
                rows_found.append(rows)
                leaves_found.append(np.full(len(rows), node))
        return np.concatenate(rows_found), np.concatenate(leaves_found)

    def _compare(self, node: int, p: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        sites = self.sites[node]
        step = max(1, 2_000_000 // len(sites))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            d2 = np.zeros((len(some), len(sites)))
            for c in range(3):
                gap = p[some, c, None] - self.xyz[sites, c][None]
                d2 += gap * gap
            place = d2.argmin(1)
            near, who = d2[np.arange(len(some)), place], self.ids[sites[place]]
            closer = (near < best[some]) | ((near == best[some]) & (who < at[some]))
            best[some[closer]], at[some[closer]] = near[closer], who[closer]

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and squared distance of the nearest site of each point; there must be a site."""
        p, back = np.unique(np.asarray(p, float).reshape(-1, 3), axis=0, return_inverse=True)
        best, at = np.full(len(p), np.inf), np.full(len(p), np.iinfo(np.int64).max)
        own = self.leaf_of(p)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for rows in np.split(order, cuts) if len(p) else ():
            self._compare(own[rows[0]], p, rows, best, at)
        todo = [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            rows = rows[self.away(node, p[rows]) <= best[rows]]
            if not len(rows):
                continue
            if self.sites[node] is None:
                todo += [(child, rows) for child in self.children[node]]
            else:
                other = rows[own[rows] != node]
                if len(other):
                    self._compare(node, p, other, best, at)
        return at[back.reshape(-1)], best[back.reshape(-1)]


XYZ = ["x", "y", "z"]


def _placed(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column), *[F.col(c).cast("double").alias(c) for c in XYZ])


def nearest(points: DataFrame, sites: DataFrame, key: str = "vid", site: str = "site_id", region: int = REGION) -> DataFrame:
    """``key``, the nearest site of every point and its squared distance ``d2``; ties go to the least id.

    A k-d tree over a sample of the sites parts space into regions of about ``region`` sites.  The nearest of
    the sample bounds a point's distance, so the point is sent just to the regions whose boxes (exact, one row a
    region on the driver) lie within that; a task meets one region's sites with a block of the points sent
    there and searches a k-d tree.  Points and sites at one place are one row, whatever their number; no pair
    of point and site is a row.

    A point without three finite coordinates has no site; such sites are left out; without any site every
    point has none.  Repeated points each have a row.
    """
    there = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    kind = points.schema[key].dataType.simpleString()
    points = _placed(points, key).groupBy(key, *XYZ).agg(F.count(F.lit(1)).alias("copies"))
    sites = _placed(sites, site).where(there).groupBy(*XYZ).agg(F.min(F.col(site).cast("long")).alias(site))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    none = points.select(key, F.lit(None).cast("long").alias(site), F.lit(None).cast("double").alias("d2"), again, there.alias("placed"))
    number = sites.count()
    if not number:
        return none.drop("copy", "placed")
    some = sites.sample(min(1.0, SAMPLE / number), seed=1).select(site, *XYZ).toPandas()
    if not len(some):
        some = sites.select(site, *XYZ).limit(1).toPandas()
    leaf = max(1, len(some) * region // number)
    layout = KdTree(some[XYZ].to_numpy(float), some[site].to_numpy(), leaf=leaf)

    def homes(frames):
        for pdf in frames:
            pdf["region"] = layout.leaf_of(pdf[XYZ].to_numpy(float))
            yield pdf

    dealt = sites.select(site, *XYZ).mapInPandas(homes, f"`{site}` long, x double, y double, z double, region long")
    boxes = dealt.groupBy("region").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).toPandas()
    low, high = boxes[[f"min_{c}" for c in XYZ]].to_numpy(float), boxes[[f"max_{c}" for c in XYZ]].to_numpy(float)
    around = KdTree(some[XYZ].to_numpy(float), some[site].to_numpy(), leaf=leaf)
    around.fit_boxes({int(k): (low[i], high[i]) for i, k in enumerate(boxes["region"])})
    bounds = KdTree(some[XYZ].to_numpy(float), some[site].to_numpy())

    def visits(frames):
        for pdf in frames:
            p = pdf[XYZ].to_numpy(float)
            row, at = around.within(p, bounds.nearest(p)[1])
            out = pdf.iloc[row].copy()
            out["region"] = at
            yield out

    sent = points.where(there).select(key, *XYZ).mapInPandas(visits, f"`{key}` {kind}, x double, y double, z double, region long")
    blocks = sent.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / region).cast("int").alias("blocks"))  # a row a region
    left = sent.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64(key, *XYZ), F.col("blocks")).cast("int"))
    right = dealt.join(blocks, "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = own[[key, *XYZ]].copy()
        ids, d2 = KdTree(held[XYZ].to_numpy(float), held[site].to_numpy()).nearest(own[XYZ].to_numpy(float)) if len(own) and len(held) else (np.zeros(0, np.int64), np.zeros(0))
        out = out.iloc[: len(ids)]
        out[site], out["d2"] = ids, d2
        return out

    left, right = left.select("region", "block", key, *XYZ), right.select("region", "block", site, *XYZ)
    met = left.groupBy("region", "block").cogroup(right.groupBy("region", "block")).applyInPandas(search, f"`{key}` {kind}, x double, y double, z double, `{site}` long, d2 double")
    best = met.groupBy(key, *XYZ).agg(F.min(F.struct("d2", site)).alias("m"))
    same = [points[c].eqNullSafe(best[c]) for c in (key, *XYZ)]
    found = points.where(there).join(best, same[0] & same[1] & same[2] & same[3]).select(points[key], F.col(f"m.{site}").alias(site), F.col("m.d2").alias("d2"), again)
    return found.drop("copy").unionByName(none.where("NOT placed").drop("copy", "placed"))


#: Sites of a group that are compared one by one, and pairs of points and sites that are compared at once.
_FEW, _PAIRS = 64, 1_000_000


def _in_own_groups(first: np.ndarray, is_point: np.ndarray, xyz: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1 without any) and squared distance of the nearest site of each point in its group.

    Groups begin at rows ``first``; in each the sites come before the points and by their ids.  Groups with as
    many sites, few of them, are searched side by side, the others each with a tree.
    """
    ends = np.append(first[1:], len(xyz))
    sites = np.add.reduceat(~is_point, first, dtype=np.int64)
    points = ends - first - sites
    at, d2 = np.full(len(xyz), -1, np.int64), np.full(len(xyz), np.nan)
    whole = is_point & np.isfinite(xyz).all(1)
    group = np.repeat(np.arange(len(first)), ends - first)
    many = (sites > _FEW) | (points * sites > _PAIRS)
    for g in np.flatnonzero(many & (points > 0)):
        held = slice(first[g], first[g] + sites[g])
        rows = first[g] + sites[g] + np.flatnonzero(whole[first[g] + sites[g] : ends[g]])
        at[rows], d2[rows] = KdTree(xyz[held], ids[held]).nearest(xyz[rows])
    for n in np.unique(sites[~many & (sites > 0)]):
        own = np.flatnonzero(whole & (~many & (sites == n))[group])
        for k in range(0, len(own), _PAIRS // n):
            rows = own[k : k + _PAIRS // n]
            held = first[group[rows]][:, None] + np.arange(n)
            far = np.zeros(held.shape)
            for c in range(3):  # summed in the order of the tree
                gap = xyz[rows, c, None] - xyz[held, c]
                far += gap * gap
            best = far.argmin(1)
            at[rows], d2[rows] = ids[held[np.arange(len(rows)), best]], far[np.arange(len(rows)), best]
    return at[is_point], d2[is_point]


def nearest_within(points: DataFrame, sites: DataFrame, by: str, key: str = "vid", site: str = "site_id", block: int = REGION) -> DataFrame:
    """``by, key``, the nearest site of the same ``by`` and its squared distance.

    For groups whose sites fit a task each (the skeleton of one neuron); a group's points are dealt in
    blocks.  A task reads its groups one after the other and searches those of a batch together.  Odd rows as in
    ``nearest``; a group without sites has none.
    """
    there = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    kinds = {c: points.schema[c].dataType.simpleString() for c in (by, key)}
    points = points.select(by, key, *[F.col(c).cast("double").alias(c) for c in XYZ])
    sizes = points.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    left = points.join(sizes, by).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    own = sites.where(there).select(by, F.col(site).cast("long").alias(site), *[F.col(c).cast("double").alias(c) for c in XYZ])
    right = own.join(sizes, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        is_point = rows["__point"].to_numpy()
        xyz = np.stack([rows[c].to_numpy() for c in XYZ], 1)
        at, d2 = _in_own_groups(first, is_point, xyz, rows[site].fill_null(-1).to_numpy())
        rows, none = rows.filter(pa.array(is_point)), np.isnan(d2)
        found = [*[rows[c].combine_chunks() for c in (by, key)], pa.array(at, mask=none), pa.array(d2, mask=none)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found], [by, key, site, "d2"])

    def run(batches):
        held, name = [], None  # batches of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch[c].dictionary_encode().indices.to_numpy() for c in (by, "block")]
            first = np.flatnonzero(np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
            names = [repr([batch[c][int(row)].as_py() for c in (by, "block")]) for row in (0, first[-1])]
            if held and names[0] != name:
                yield search(pa.Table.from_batches(held), np.zeros(1, int))
                held = []
            if len(first) > 1:
                before = sum(b.num_rows for b in held)
                yield search(pa.Table.from_batches([*held, batch.slice(0, first[-1])]), np.r_[0, before + first[1:-1]])
                held = []
            held.append(batch.slice(first[-1]))
            name = names[1]
        if held:
            yield search(pa.Table.from_batches(held), np.zeros(1, int))

    left = left.select(by, "block", key, F.lit(None).cast("long").alias(site), F.lit(True).alias("__point"), *XYZ)
    right = right.select(by, "block", F.lit(None).cast(kinds[key]).alias(key), site, F.lit(False).alias("__point"), *XYZ)
    dealt = left.unionByName(right).repartition(by, "block").sortWithinPartitions(by, "block", "__point", site)
    return dealt.mapInArrow(run, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, `{site}` long, d2 double")
