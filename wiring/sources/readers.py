"""Readers: schemas are given, never inferred; files become the tables that the operators take."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiring.functions.numeric import numbers_in
from wiring.sources import arrays

SWC = "vid_raw long, compartment int, x double, y double, z double, radius double, parent_raw long"


def csv(spark: SparkSession, path: str, schema: str, index_column: bool = False) -> DataFrame:
    """A CSV file with a header; with ``index_column`` the unnamed first column is dropped."""
    full = ("_index string, " if index_column else "") + schema
    df = spark.read.schema(full).option("header", True).option("enforceSchema", True).csv(path)
    return df.drop("_index")


def positions(df: DataFrame, column: str = "center_position", units: tuple[float, float, float] = (1.0, 1.0, 1.0),
              affine: list[list[float]] | None = None, suffix: str = "_t") -> DataFrame:
    """``"[x, y, z]"`` strings as three columns, scaled by ``units`` and sent through a 3 x 4 ``affine`` map."""
    parsed = df.withColumn("__p", numbers_in(F.col(column)))
    p = [F.get(F.col("__p"), F.lit(k)) * float(units[k]) for k in range(3)]
    m = affine or [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    return parsed.withColumns({f"{c}{suffix}": sum((p[k] * float(m[i][k]) for k in range(3)), F.lit(float(m[i][3]))) for i, c in enumerate("xyz")}).drop("__p")


def swc(spark: SparkSession, path: str) -> DataFrame:
    """Skeleton files ``<root_id>.swc`` as ``root_id, vid, parent, x, y, z, radius, compartment``.

    Raw ids need not be dense: ``vid`` counts the rows of a file by raw id and ``parent`` points to a
    ``vid``; -1 marks a root.  A folder without the file of a neuron simply has no rows for it.
    """
    raw = spark.read.schema(SWC).option("sep", " ").option("comment", "#").csv(path).withColumn(
        "root_id", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.swc$", 1).cast("long"))
    own = raw.withColumn("vid", (F.row_number().over(Window.partitionBy("root_id").orderBy("vid_raw")) - 1).cast("int"))
    up = own.select("root_id", F.col("vid_raw").alias("parent_raw"), F.col("vid").alias("parent"))
    return own.join(up, ["root_id", "parent_raw"], "left").select(
        "root_id", "vid", F.coalesce("parent", F.lit(-1)).cast("int").alias("parent"), "x", "y", "z", "radius", "compartment")


def wanted(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """The skeletons of the neurons asked for; one without a file has a row without a vertex that says so in ``found``."""
    return ids.select("root_id").distinct().join(vertices.withColumn("found", F.lit(True)), "root_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def matrix_cells(spark: SparkSession, path: str, split: int = 1_000_000) -> DataFrame:
    """``row, col, value`` of a compressed sparse matrix file, or of a folder of its parts, read in ranges of ``split`` entries."""
    arrays.register(spark)
    return spark.read.format("sparse_matrix").option("rowsPerPartition", split).load(path).select("row", "col", "value")


def write_matrix(cells: DataFrame, path: str) -> None:
    """``row, col, value`` as matrix files, a range of rows each."""
    arrays.register(cells.sparkSession)
    rows = cells.select(F.lit("").alias("file"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    rows.repartitionByRange("row").write.format("sparse_matrix").mode("append").save(path)


def sparse_matrix(spark: SparkSession, npz_path: str, mapping: dict[int, int] | DataFrame, stored_post_by_pre: bool = True, split: int = 1_000_000) -> DataFrame:
    """A compressed sparse matrix file as the edge list ``pre_id, post_id, n_syn``; no pickles are read.

    ``mapping`` gives the id of each index, as a dictionary or a table ``idx, root_id``; cells of an index
    that it lacks go.  The file is read in ranges by the tasks.
    """
    if isinstance(mapping, dict):
        mapping = spark.createDataFrame([*mapping.items()], "idx long, root_id long")
    cells = matrix_cells(spark, npz_path, split).withColumnsRenamed({"row": "post_at", "col": "pre_at"} if stored_post_by_pre else {"row": "pre_at", "col": "post_at"})
    pre, post = (mapping.select(F.col("idx").alias(f"{n}_at"), F.col("root_id").alias(f"{n}_id")) for n in ("pre", "post"))
    return cells.join(pre, "pre_at").join(post, "post_at").select("pre_id", "post_id", F.col("value").cast("long").alias("n_syn"))


def binarised(edges: DataFrame) -> DataFrame:
    return edges.where("n_syn > 0").withColumn("n_syn", F.lit(1).cast("long"))


def both_matrices(edges: DataFrame) -> DataFrame:
    """Edges with their weight ``n_syn`` and, beside it, the binary matrix' entry ``linked``."""
    return edges.withColumn("linked", F.least(F.col("n_syn"), F.lit(1)).cast("long"))


def neuron_positions(types: DataFrame, neurons: DataFrame, leave: tuple[str, ...], affine: list[list[float]] | None = None,
                     units: tuple[float, float, float] = (1.0, 1.0, 1.0), position: str = "pt_position") -> DataFrame:
    """Neurons beside type and position of their annotation, where they have just one.

    Annotations without a neuron, of systems in ``leave``, with key 0 or a repeated key go; positions
    are scaled and sent through ``affine``.
    """
    from wiring.operators.features import cleaned_types, placed

    kept = cleaned_types(types, neurons, leave)
    moved = positions(kept, position, units, affine).select("pt_root_id", "cell_type", "x_t", "y_t", "z_t")
    return placed(neurons, moved)


def synapses(raw: DataFrame, affine: list[list[float]] | None = None, column: str = "center_position") -> DataFrame:
    """Synapses with their position string as three columns, sent through ``affine`` without scaling; the string goes."""
    return positions(raw, column, affine=affine).drop(column)


def full_neurons(types: DataFrame, neurons: DataFrame, edges: DataFrame, levels: list[str], leave: tuple[str, ...], affine: list[list[float]] | None = None) -> DataFrame:
    """Neurons with type, position, degree and contact features, and the place of their type among ``levels``, in that order; other types come last."""
    from wiring.operators.features import category_order, connectivity_features

    return category_order(connectivity_features(neuron_positions(types, neurons, leave, affine), edges), "cell_type", levels, "root_id")


def mesh(spark: SparkSession, path: str, seg_id: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of one mesh from the Parquet tables ``vertices`` and ``faces`` of a folder; a missing mesh is an error."""
    vertices = spark.read.schema("seg_id long, vid int, x double, y double, z double").parquet(f"{path}/vertices").where(F.col("seg_id") == seg_id)
    if vertices.isEmpty():
        raise FileNotFoundError(f"no mesh {seg_id} in {path}")
    return vertices, spark.read.schema("seg_id long, fid int, v0 int, v1 int, v2 int").parquet(f"{path}/faces").where(F.col("seg_id") == seg_id)


def array_rows(spark: SparkSession, path: str, columns: dict[str, str], member: str | None = None, split: int = 1_000_000) -> DataFrame:
    """The rows of an array file as ``row`` and a column of the type named for each place, read in ranges of ``split`` rows."""
    arrays.register(spark)
    reader = spark.read.format("array_rows").option("rowsPerPartition", split)
    rows = (reader.option("member", member) if member else reader).load(path)
    return rows.select("row", *[F.get("values", F.lit(k)).cast(kind).alias(c) for k, (c, kind) in enumerate(columns.items())])


def ingest_mesh(spark: SparkSession, path: str, seg_id: int, vertices: str, faces: str, split: int = 1_000_000) -> None:
    """Add the mesh in the array files ``vertices`` (n x 3) and ``faces`` (m x 3) to the tables that ``mesh`` reads."""
    seg = F.lit(seg_id).cast("long").alias("seg_id")
    v = array_rows(spark, vertices, dict.fromkeys("xyz", "double"), split=split).select(seg, F.col("row").cast("int").alias("vid"), *"xyz")
    f = array_rows(spark, faces, {f"v{k}": "int" for k in range(3)}, split=split).select(seg, F.col("row").cast("int").alias("fid"), "v0", "v1", "v2")
    for name, rows in (("vertices", v), ("faces", f)):
        rows.write.mode("append").parquet(f"{path}/{name}")


SYNAPSE = T.StructType([T.StructField("id_", T.LongType()), T.StructField("pre_pt_root_id", T.LongType()), T.StructField("post_pt_root_id", T.LongType()),
                        T.StructField("size", T.LongType()), T.StructField("center_position", T.ArrayType(T.DoubleType()))])


def incoming_synapses(objects: DataFrame, units: tuple[float, float, float] = (4.0, 4.0, 40.0), scale: float = 1000.0) -> DataFrame:
    """One row for each incoming synapse of nested neuron records, positions in scaled units, type ``Unk``."""
    rows = objects.select("root_id", F.explode("pre_synapses").alias("s"))
    xyz = [(F.get("s.center_position", F.lit(k)) * units[k] / scale).alias(c) for k, c in enumerate("xyz")]
    return rows.select("root_id", "s.id_", "s.pre_pt_root_id", "s.size", *xyz, F.lit("Unk").alias("cell_type"))


def networks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet tables of several networks in one frame, told apart by ``network``."""
    frames = [spark.read.parquet(p).withColumn("network", F.lit(name)) for name, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).orderBy("path")


def write_figure_data(df: DataFrame, path: str) -> None:
    """The rows behind a figure; drawing is left to the reader's tools."""
    df.write.mode("overwrite").parquet(path)


def write_array(df: DataFrame, column: str | list[str], order: str, path: str) -> None:
    """A column of a result of figure size, or several as the columns of a table, as an array file on the driver, by ``order``."""
    rows = df.orderBy(order).toPandas()
    np.save(path, np.ascontiguousarray(rows[column].to_numpy()), allow_pickle=False)


def write_rows(df: DataFrame, columns: list[str], row: str, n: int, path: str) -> None:
    """``columns`` of a table of any size as the ``n`` rows of an array file, by the row numbers ``row``, each once.

    The driver lays out the empty file, in storage that all executors mount, and every task writes its own rows
    in place; whole numbers are kept as such, other columns make all double.  A row number that is missing or
    too many raises ``ValueError`` and leaves no file.
    """
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns)
    kind, path = np.dtype(np.int64 if whole else np.float64), arrays.mounted(path)
    held = f"{path}.{uuid.uuid4().hex}"
    with open(held, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (n, len(columns))})
        start = f.tell()
        f.truncate(start + n * kind.itemsize * len(columns))

    def run(batches):
        with open(held, "r+b") as out:
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(kind) for c in batch.columns[1:]], 1)
                order = np.argsort(at, kind="stable")
                at, values = at[order], values[order]
                breaks = np.flatnonzero(np.diff(at) != 1) + 1  # each run of rows that follow each other is one write
                for begin, end in zip(np.r_[0, breaks], np.r_[breaks, len(at)], strict=True):
                    if begin < end:
                        out.seek(start + int(at[begin]) * kind.itemsize * len(columns))
                        out.write(values[begin:end].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(at)]), pa.array([int(at.sum())])], ["n", "total"])

    try:
        inside = df.where(F.col(row).between(0, n - 1)).select(F.col(row).cast("long").alias("__row"), *columns)
        done = inside.mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
        if (done[0] or 0, done[1] or 0) != (n, n * (n - 1) // 2):
            raise ValueError(f"{done[0] or 0} of {n} rows for {path}")
        os.replace(held, path)
    finally:
        if os.path.exists(held):
            os.remove(held)


def write_swc(vertices: DataFrame, path: str) -> DataFrame:
    """Skeletons as files ``<root_id>.swc`` in a folder that all executors mount, one task a skeleton; gives ``root_id, n`` when it runs.

    Raw ids are ``vid``, so vertices taken out leave gaps that ``swc`` closes; a vertex without a parent has -1.
    """
    folder = arrays.mounted(path)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("vid")
        os.makedirs(folder, exist_ok=True)
        root = int(rows["root_id"].iloc[0])
        held = os.path.join(folder, f"_{root}-{uuid.uuid4().hex}")  # a task that runs twice leaves one whole file
        with open(held, "w") as f:
            f.write("# id type x y z radius parent\n")
            for r in rows.itertuples():
                f.write(f"{r.vid} {r.compartment} {r.x!r} {r.y!r} {r.z!r} {r.radius!r} {r.parent}\n")
        os.replace(held, os.path.join(folder, f"{root}.swc"))
        return pd.DataFrame({"root_id": [root], "n": [len(rows)]})

    own = vertices.select("root_id", F.col("vid").cast("long"), "compartment", *[F.col(c).cast("double") for c in ("x", "y", "z", "radius")], F.col("parent").cast("long"))
    return own.groupBy("root_id").applyInPandas(run, "root_id long, n long")
