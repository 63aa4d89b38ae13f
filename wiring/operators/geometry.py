"""Points, skeleton trees and triangle meshes as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.operators.nearest import nearest, nearest_within

SOMA, AXON, DENDRITES = 1, (2,), (3, 4)


def in_box(x: str, y: str, xlim: tuple[float, float], ylim: tuple[float, float]) -> Column:
    return F.col(x).between(*xlim) & F.col(y).between(*ylim)


def scaled(df: DataFrame, columns: list[str], factors: list[float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * float(f) for c, f in zip(columns, factors, strict=True)})


def affine(df: DataFrame, columns: list[str], matrix: list[list[float]]) -> DataFrame:
    """Three columns through a 3 x 4 map."""
    return df.withColumns({c: sum((F.col(columns[k]) * float(row[k]) for k in range(3)), F.lit(float(row[3]))) for c, row in zip(columns, matrix, strict=True)})


def collapsed(vertices: DataFrame, compartments: tuple[int, ...]) -> DataFrame:
    """Vertices of the compartments moved onto their root's position; edges stay."""
    roots = vertices.where("parent = -1").groupBy("root_id").agg(F.min_by(F.struct("x", "y", "z"), "vid").alias("__r"))
    gone = F.col("compartment").isin(*compartments)
    return vertices.join(roots, "root_id", "left").withColumns({c: F.when(gone, F.col(f"__r.{c}")).otherwise(F.col(c)) for c in "xyz"}).drop("__r")


def masked(vertices: DataFrame, keep: Column) -> DataFrame:
    """Vertices that meet ``keep``; a vertex whose parent goes becomes a root."""
    left = vertices.where(keep)
    up = left.select("root_id", F.col("vid").alias("parent"), F.lit(True).alias("__has"))
    return left.join(up, ["root_id", "parent"], "left").withColumn("parent", F.when(F.col("__has"), F.col("parent")).otherwise(-1)).select(*vertices.columns)


def path_length(vertices: DataFrame, compartments: tuple[int, ...] | None = None, xlim: tuple[float, float] | None = None, zlim: tuple[float, float] | None = None) -> DataFrame:
    """Cable length of each tree over edges whose two ends lie in the compartments and the x and z limits."""
    keep = F.lit(True)
    if compartments:
        keep &= F.col("compartment").isin(*compartments)
    for c, lim in (("x", xlim), ("z", zlim)):
        if lim:
            keep &= F.col(c).between(*lim)
    v = vertices.where(keep)
    up = v.select("root_id", F.col("vid").alias("parent"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    step = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("px")) ** 2))
    return v.join(up, ["root_id", "parent"]).groupBy("root_id").agg(F.sum(step).alias("length"))


def copied_flag(points: DataFrame, sites: DataFrame, flag: str) -> DataFrame:
    """Points with the flag of their nearest site."""
    return points.join(nearest(points, sites), "vid").join(sites.select("site_id", flag), "site_id")


def dendrite_mesh(vertices: DataFrame, faces: DataFrame, skeletons: DataFrame, leave: tuple[int, ...] = AXON, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Meshes without the parts whose nearest skeleton vertex is of a compartment in ``leave``.

    ``vertices`` has ``seg_id, vid, x, y, z``, ``faces`` ``seg_id, fid, v0, v1, v2`` and ``skeletons`` ``root_id, vid,
    compartment, x, y, z`` in units of 1 / ``scale``; each segment meets its own skeleton.  A vertex copies
    the compartment of the nearest skeleton vertex (the least ``vid`` of several); a face stays if its three
    corners do.  What stays is numbered anew from 0 in its old order, segment by segment, ``old_vid`` and
    ``old_fid`` beside it.  A segment without a skeleton, and a vertex without a place, stay whole; empty
    tables give empty tables.
    """
    bones = skeletons.select(F.col("root_id").alias("seg_id"), F.col("vid").cast("long").alias("site_id"), "compartment", *[(F.col(c) * float(scale)).alias(c) for c in "xyz"])
    kind = bones.select("seg_id", "site_id", F.col("compartment").isin(*leave).alias("gone"))
    near = nearest_within(vertices, bones, "seg_id").select("seg_id", "vid", "site_id")
    flagged = vertices.join(near, ["seg_id", "vid"]).join(kind, ["seg_id", "site_id"], "left").drop("site_id")
    in_order = Window.partitionBy("seg_id").orderBy("old_vid")
    kept = flagged.where(~F.coalesce("gone", F.lit(False))).drop("gone").withColumnRenamed("vid", "old_vid").withColumn("vid", F.row_number().over(in_order) - 1)
    left = faces.withColumnRenamed("fid", "old_fid")
    for k in range(3):
        corner = kept.select("seg_id", F.col("old_vid").alias(f"v{k}"), F.col("vid").alias(f"__v{k}"))
        left = left.join(corner, ["seg_id", f"v{k}"])
    by_face = Window.partitionBy("seg_id").orderBy("old_fid")
    left = left.select("seg_id", "old_fid", (F.row_number().over(by_face) - 1).alias("fid"), *[F.col(f"__v{k}").alias(f"v{k}") for k in range(3)])
    return kept.select("seg_id", "old_vid", "vid", "x", "y", "z"), left


def triangles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their three corners."""
    out = faces
    for k in range(3):
        v = vertices.select("seg_id", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        out = out.join(v, ["seg_id", f"v{k}"])
    return out


def cropped(tri: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """Triangles with any corner in the box."""
    inside = F.lit(False)
    for k in range(3):
        inside |= in_box(f"x{k}", f"y{k}", xlim, ylim)
    return tri.where(inside)


def shading(tri: DataFrame, light: tuple[float, float, float] = (0.3, 0.5, 1.0), ambient: float = 0.3) -> DataFrame:
    """Lambert shade of each triangle; one turned away from the light or without area has only the ambient part."""
    a = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    b = {c: F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"}
    n = {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}
    size = float(np.linalg.norm(light))
    dot = sum((n[c] * (v / size) for c, v in zip("yz", light[1:], strict=True)), n["x"] * (light[0] / size))
    norm = F.sqrt(n["x"] ** 2 + n["y"] ** 2 + n["z"] ** 2)
    lit = F.least(F.greatest(F.coalesce(F.try_divide(dot, norm), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return tri.withColumn("shade", ambient + (1 - ambient) * lit)


def local_path_length(vertices: DataFrame, neurons: DataFrame) -> DataFrame:
    """Axon and dendrite length of each neuron inside the x and z extent of the given neurons' positions.

    ``neurons`` has ``root_id, x, z``; a neuron without a skeleton has no lengths, one without cable inside 0.
    """
    low, high, near, far = neurons.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    out = neurons
    if low is None or near is None:
        return neurons.withColumns({f"{n}_local_length": F.lit(None).cast("double") for n in ("axon", "dendrite")})
    for name, compartments in (("axon", AXON), ("dendrite", DENDRITES)):
        cable = path_length(vertices, (SOMA, *compartments), (low, high), (near, far)).withColumnRenamed("length", "__len")
        has = vertices.select("root_id").distinct().withColumn("__has", F.lit(True))
        out = out.join(cable, "root_id", "left").join(has, "root_id", "left").withColumn(f"{name}_local_length", F.coalesce("__len", F.when(F.col("__has"), 0.0))).drop("__len", "__has")
    return out


def polylines(vertices: DataFrame) -> DataFrame:
    """Each tree cut into its maximal unbranched lines, pure cycles included: ``root_id, line, vids``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for v, p in zip(pdf["vid"], pdf["parent"], strict=True):
            near.setdefault(int(v), [])
            if p >= 0:
                near[int(v)].append(int(p))
                near.setdefault(int(p), []).append(int(v))
        used: set[frozenset[int]] = set()
        lines = []

        def walk(start: int, to: int) -> list[int]:
            line = [start, to]
            used.add(frozenset((start, to)))
            while len(near[line[-1]]) == 2:
                nxt = [w for w in near[line[-1]] if frozenset((line[-1], w)) not in used]
                if not nxt:
                    break
                used.add(frozenset((line[-1], nxt[0])))
                line.append(nxt[0])
            return line

        for ends in (lambda v: len(near[v]) != 2, lambda v: True):  # open lines first, then cycles
            for v in sorted(near):
                if ends(v):
                    for w in sorted(near[v]):
                        if frozenset((v, w)) not in used:
                            lines.append(walk(v, w))
        return pd.DataFrame({"root_id": [pdf["root_id"].iloc[0]] * len(lines), "line": range(len(lines)), "vids": lines})

    return vertices.select("root_id", "vid", "parent").groupBy("root_id").applyInPandas(run, "root_id long, line long, vids array<long>")


def ribbons(lines: DataFrame, vertices: DataFrame) -> DataFrame:
    """Polygons around polylines: each point moved by its radius along the mean normal of its two segments."""
    points = lines.select("root_id", "line", F.posexplode("vids").alias("place", "vid")).join(vertices.select("root_id", "vid", "x", "y", "radius"), ["root_id", "vid"])
    points = points.select("root_id", "line", "place", F.col("x").cast("double"), F.col("y").cast("double"), F.col("radius").cast("double"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place")
        xy, radius = rows[["x", "y"]].to_numpy(float), rows["radius"].to_numpy(float)
        seg = np.diff(xy, axis=0)
        normal = np.stack([-seg[:, 1], seg[:, 0]], 1) / np.maximum(np.linalg.norm(seg, axis=1), 1e-12)[:, None] if len(seg) else np.zeros((0, 2))
        mean = np.zeros_like(xy)
        mean[:-1] += normal
        mean[1:] += normal
        mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-12)[:, None]
        ring = np.concatenate([xy + mean * radius[:, None], (xy - mean * radius[:, None])[::-1]])
        return pd.DataFrame({"root_id": pdf["root_id"].iloc[0], "line": pdf["line"].iloc[0], "place": range(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    return points.groupBy("root_id", "line").applyInPandas(run, "root_id long, line long, place long, x double, y double")


def drawing(vertices: DataFrame, coords: tuple[str, str] = ("x", "y"), width: float = 1.0, skip_root: bool = True) -> DataFrame:
    """Skeletons as filled lines, ready to draw: ``root_id, line, place, x, y, vid``, the corners of each line's polygon in turn.

    Lines are those of ``polylines``; with ``skip_root`` vertex 0 is taken out of them, and lines of fewer than two
    points go.  ``coords`` names the axes drawn, radii are times ``width``; lines are numbered as
    ``polylines`` has them.  A polygon goes along its left side and back along its right, moved by the radius along
    the mean normal of the two segments at each point; ``vid`` is the vertex that a corner belongs to.
    """
    lines = polylines(vertices)
    if skip_root:
        lines = lines.withColumn("vids", F.filter("vids", lambda v: v != 0))
    lines = lines.where(F.size("vids") > 1)
    # the two axes take the names that ribbons draws
    flat = vertices.select("root_id", "vid", F.col(coords[0]).alias("x"), F.col(coords[1]).alias("y"), (F.col("radius") * float(width)).alias("radius"))
    n = F.size("vids")
    corners = lines.select("root_id", "line", F.posexplode(F.concat("vids", F.reverse("vids"))).alias("place", "vid"), n.alias("n"))
    return ribbons(lines, flat).join(corners.select("root_id", "line", F.col("place").cast("long").alias("place"), "vid"), ["root_id", "line", "place"])


def branch_view(faces: DataFrame, vertices: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float], light: tuple[float, float, float] = (0.3, 0.5, 1.0)) -> DataFrame:
    """What a view of a branch shows: the triangles with a corner in the box, with their shades."""
    return shading(cropped(triangles(faces, vertices), xlim, ylim), light)


def overlay(vertices: DataFrame, synapses: DataFrame, colours: dict[str, str], kind: str = "tag") -> DataFrame:
    """A neuron's drawing as rows ``root_id, layer, x, y, colour``: axon, dendrites, then synapses coloured by kind; kinds without a colour go."""
    layers = [vertices.where(F.col("compartment").isin(*part)).select("root_id", F.lit(name).alias("layer"), "x", "y", F.lit(None).cast("string").alias("colour"))
              for name, part in (("axon", AXON), ("dendrite", DENDRITES))]
    palette = F.create_map(*[F.lit(v) for pair in colours.items() for v in pair])
    dots = synapses.select("root_id", F.lit("synapse").alias("layer"), "x", "y", F.try_element_at(palette, F.col(kind)).alias("colour")).where("colour IS NOT NULL")
    return layers[0].unionByName(layers[1]).unionByName(dots)
