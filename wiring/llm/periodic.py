"""Runs of periodic words, found by bit-parallel lags.

The words of a text are numbered by their first places, and bit k of all numbers makes one plane, a big
integer with a bit for each word.  For a lag p a plane XOR the plane shifted by p marks the places that
differ in that bit from the word p further on; OR over the planes leaves 0 just where both words are equal.
A stretch with period p and length m is m - p such zeros in a row: AND of the inverted mask with itself,
shifted by 1, 2, 4, ... up to that number, leaves a bit only where a long enough stretch begins.

A run of length 4p holds, for any offset, four words in a row that lie p apart, and all are equal.
In long texts that is asked of a few offsets first, so most of their lags never touch the planes.

A stretch found with a lag has a smaller period only if that divides the lag (it is at least four lags
long), and then the smaller lag has found the same stretch before.

Defined results: a null or empty text, and one without words, has no runs and an empty collapsed text; a
null id plants nothing; texts of any length are read whole, a text is one task's work; repeated rows give
a row each; ties among longest runs go to the least start, then the least period; an empty table gives
an empty table; of other columns only the id is carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t-\r]+")
#: A run has this many periods and this many words at least.
PERIODS, LEAST = 4, 6
_OFFSETS = 4
_LONG = 8_000  # words of a text from which asking a few offsets first costs less than the planes
_TEXTS = 64


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def planes(ids: np.ndarray) -> list[int]:
    """A big integer for each bit of the numbers; its bit i is that of word i."""
    return [_bits((ids >> k) & 1) for k in range(int(ids.max(initial=0)).bit_length())]


def _may_repeat(ids: np.ndarray, lag: int) -> bool:
    """Whether, for each of some offsets, ``PERIODS`` words that lie ``lag`` apart are equal somewhere."""
    for offset in sorted({lag * k // _OFFSETS for k in range(_OFFSETS)}):
        every = ids[offset::lag]
        same = every[1:] == every[:-1]
        run = same[: len(same) - PERIODS + 2]
        for k in range(1, PERIODS - 1):
            run = run & same[k : k + len(run)]
        if not run.any():
            return False
    return True


def _stretches(equal: int, size: int, least: int) -> list[tuple[int, int]]:
    """First bit and length of every stretch of ``least`` ones or more in a row."""
    held = 1
    while held < least and equal:
        step = min(held, least - held)
        equal &= equal >> step
        held += step
    if not equal:
        return []
    flags = np.unpackbits(np.frombuffer(equal.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8)))
    return [(int(a), int(b - a) + least - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start and period."""
    n = len(words)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    every, found = planes(ids), {}
    for lag in range(1, n // PERIODS + 1):
        if n >= _LONG and not _may_repeat(ids, lag):
            continue
        size = n - lag
        differ = 0
        for plane in every:
            differ |= plane ^ (plane >> lag)
        equal = ~differ & ((1 << size) - 1)
        for start, m in _stretches(equal, size, max(LEAST, PERIODS * lag) - lag):
            found.setdefault((start, m + lag), lag)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def planted(words: list[str], id_: int | None) -> list[str]:
    """The words of a document, for one id in ten with a periodic end that the id decides."""
    n, h = len(words), zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _unchanged(words: list[str], id_: int | None) -> list[str]:
    return words


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         change: Callable[[list[str], int | None], list[str]] = _unchanged) -> DataFrame:
    """``id_col``, ``runs`` (structs of start, length and period) and ``collapsed``, the words left joined by blanks, of every row.

    ``change`` takes the words and the id and gives the words to search.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                keys, texts = batch.column(0).slice(at, _TEXTS), batch.column(1).slice(at, _TEXTS)
                every, left = [], []
                for key, text in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
                    words = change(WORD.findall(text or ""), key)
                    found = runs(words)
                    every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    left.append(" ".join(collapsed(words, found)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(every, pa.list_(run)), pa.array(left, pa.string())], [id_col, "runs", "collapsed"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(work, f"`{id_col}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each of ``find``: the number of runs, the longest and digests of all runs and of the text left."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    none = F.size("runs") == 0
    rows = found.withColumn("best", F.when(~none, best))
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.k")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.k div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
