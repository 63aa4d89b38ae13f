"""Array files as partitioned data sources: a task reads its own range of rows, no array goes through the driver.

``register(spark)`` makes two formats known:

* ``array_rows``: one row for each row of an array in a ``.npy`` file, or of the option ``member`` of an
  ``.npz`` archive; ``file string, row long, values array<double>``.
* ``sparse_matrix``: the entries other than zero of a compressed sparse matrix (CSR or CSC, ``.npz``);
  ``file string, row long, col long, value double``.  It can be written too: each task writes its rows of
  ``row, col, value`` as a matrix file of its own into the folder.

``path`` is a file or a folder of such files, in storage that all executors mount; ``rowsPerPartition`` (1,000,000
rows, or entries of a matrix) sets the size of a split.  Pickled arrays are refused.  A compressed member is
read from its start to reach a range, in pieces, so memory is bounded by the range.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_PIECE = 1 << 16
_SPLIT = 1_000_000


def mounted(path: str) -> str:
    """The place of a file that tasks open themselves."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"array files are read from mounted storage, not from {path}")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _files(path: str, ending: str) -> list[str]:
    path = mounted(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending) and f[0] not in "._")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


class _Array:
    """The header of an array in a file or archive, and any range of its rows."""

    def __init__(self, file: str, member: str | None = None):
        self.file, self.member = file, member
        with self._open() as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, self.by_column, self.dtype = read(f)
            self.start = f.tell()
        if self.dtype.hasobject:
            raise ValueError(f"{file} holds pickled objects")
        if self.by_column and len(self.shape) > 1:
            raise ValueError(f"{file} is stored by column; its rows cannot be read in ranges")

    def _open(self):
        if self.member is None:
            return open(self.file, "rb")
        return zipfile.ZipFile(self.file).open(f"{self.member}.npy")

    def rows(self, begin: int, end: int) -> np.ndarray:
        width = int(np.prod(self.shape[1:], dtype=np.int64)) if len(self.shape) > 1 else 1
        size = self.dtype.itemsize * width
        with self._open() as f:
            f.seek(self.start + begin * size)
            raw = f.read((end - begin) * size)
        return np.frombuffer(raw, self.dtype).reshape(end - begin, *self.shape[1:])


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def _ranges(file: str, rows: int, size: int) -> list[InputPartition]:
    return [Range(file, k, min(rows, k + size)) for k in range(0, rows, size)]


class _ArrayRowsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.member, self.size = options["path"], options.get("member"), int(options.get("rowsPerPartition", _SPLIT))

    def partitions(self) -> list[InputPartition]:
        found = []
        for file in _files(self.path, ".npz" if self.member else ".npy"):
            found += _ranges(file, _Array(file, self.member).shape[0], self.size)
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["file", "row", "values"]
        if part.end == part.begin:
            return
        array = _Array(part.file, self.member)
        for k in range(part.begin, part.end, _PIECE):
            held = array.rows(k, min(part.end, k + _PIECE)).astype(np.float64)
            flat = held.reshape(len(held), -1)
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            values = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(flat)), pa.array(np.arange(k, k + len(flat))), values], names)


class ArrayRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayRowsReader(self.options)


def _starts(indptr: _Array, begin: int, end: int) -> tuple[int, np.ndarray]:
    """The first row that has an entry of a range, and where it and the rows after it start, up to the end of the range."""
    first, held = 0, []
    for k in range(0, indptr.shape[0], _PIECE):
        some = indptr.rows(k, min(indptr.shape[0], k + _PIECE)).astype(np.int64)
        low, high = np.searchsorted(some, begin, "right"), np.searchsorted(some, end, "left")
        if low:  # the last start that is not beyond the range's begin
            first, held = k + int(low) - 1, [some[low - 1 : low]]
        held.append(some[low:high])
        if high < len(some):
            break
    return first, np.concatenate(held)


class _MatrixReader(DataSourceReader):
    """Splits by ranges of entries; the rows of a range are found in ``indptr``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("rowsPerPartition", _SPLIT))

    def partitions(self) -> list[InputPartition]:
        found = []
        for file in _files(self.path, ".npz"):
            found += _ranges(file, _Array(file, "indices").shape[0], self.size)
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.begin:
            return
        with np.load(part.file, allow_pickle=False) as z:
            kind = z["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        if kind not in ("csr", "csc"):
            raise ValueError(f"{part.file} is stored as {kind}")
        indptr, indices, data = (_Array(part.file, m) for m in ("indptr", "indices", "data"))
        first, starts = _starts(indptr, part.begin, part.end)
        offset = np.zeros(2, np.int64)
        with zipfile.ZipFile(part.file) as z:
            if "first_row.npy" in z.namelist():  # a part of a larger matrix
                offset[0 if kind == "csr" else 1] = int(_Array(part.file, "first_row").rows(0, 1)[0])
        for k in range(part.begin, part.end, _PIECE):
            end = min(part.end, k + _PIECE)
            major = first + np.searchsorted(starts, np.arange(k, end), "right") - 1
            minor, value = indices.rows(k, end).astype(np.int64), data.rows(k, end).astype(np.float64)
            row, col = (major, minor) if kind == "csr" else (minor, major)
            some = value != 0
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * int(some.sum()), pa.string()), pa.array(row[some] + offset[0]), pa.array(col[some] + offset[1]), pa.array(value[some])],
                                             ["file", "row", "col", "value"])


class _MatrixWriter(DataSourceArrowWriter):
    """One file a task, with the rows it was given; files of a task that fails are taken away."""

    def __init__(self, options: dict[str, str]):
        self.path = mounted(options["path"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        message, some = WriterCommitMessage(), [b for b in batches if b.num_rows]
        message.file = None
        if not some:
            return message
        held = pa.Table.from_batches(some)
        row, col, value = (held.column(c).to_numpy() for c in ("row", "col", "value"))
        order = np.lexsort((col, row))
        row, col, value = row[order], col[order], value[order].astype(np.float64)
        first = int(row[0])
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row - first))])
        os.makedirs(self.path, exist_ok=True)
        message.file = os.path.join(self.path, f"{first:012d}-{uuid.uuid4().hex}.npz")
        np.savez_compressed(message.file, indptr=indptr, indices=col, data=value, format=np.array("csr"), shape=np.array([first + len(indptr) - 1, int(col.max()) + 1]), first_row=np.array([first]))
        return message

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.file:
                os.remove(m.file)


class SparseMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparse_matrix"

    def schema(self) -> str:
        return "file string, row long, col long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("matrix files are added to a folder; write to a new one")
        return _MatrixWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (ArrayRows, SparseMatrix):
        spark.dataSource.register(source)
