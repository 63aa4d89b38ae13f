"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``CHUNK`` characters are cut before the library sees them, only at places
where no match of the split pattern can span the cut, so ids are those of the whole text.

Defined results: a null or empty text has no ids and decodes to no bytes; texts of any length are
encoded whole; repeated rows and repeated ids give one output row each; an empty table gives an
empty table; other columns of the input, whatever their names, are not carried along.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest text, in characters, that the library is given in one call.
CHUNK = 1 << 16

#: A white-space run is never joined to what stands before it, so a cut just before one that follows
#: any other character is safe; so is a cut between a letter and a digit.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once in each process."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in chunks(text):
        ids += enc.encode_ordinary(part)
    return ids


def _paths(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
           pattern: str | None = None, round_trip: bool = False) -> DataFrame:
    """``id_col``, ``ids array<int>`` and, with ``round_trip``, ``decoded binary`` from those ids."""
    path, pat = _paths(ranks_path, pattern)

    def run(batches):
        enc = encoding(path, pat)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                ids = [encode_text(enc, t) for t in texts.slice(at, 512).to_pylist()]
                out = [keys.slice(at, 512), pa.array(ids, pa.list_(pa.int32()))]
                if round_trip:
                    out.append(pa.array([enc.decode_bytes(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [id_col, "ids", "decoded"][: len(out)])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * round_trip)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``decoded binary``; raw bytes, as a list of ids need not end with a whole character."""
    path, pat = _paths(ranks_path, pattern)

    def run(batches):
        enc = encoding(path, pat)
        for batch in batches:
            got = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [id_col, "decoded"])

    source = df.select(F.col(id_col), F.col(ids_col).cast("array<int>"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, decoded binary")
