"""Token ids as directly addressable codes: any id of a file is read without decoding a block.

An id is cut into chunks of ``LEVELS`` bits, lowest first.  Level 0 holds the first chunk of every
id; a bitmap beside it says which ids go on; level 1 holds the next chunk of just those, and so on.
The place of an id's next chunk is the number of ones before its bit, which a rank directory (one
count for each 512 bits) gives with one popcount of at most 64 bytes.

Layout of a shard (little endian): magic ``DAC2``; u32 number of levels; u64 number of documents;
u64 number of ids; per level: u8 bits, u64 number of chunks; then doc_id (i64 each, 0 for none), a
bitmap of the documents without one (bytes), the number of ids before each document within the shard
(u64 each, one more at the end), then per level the chunks (u8 or u16 each), the bitmap (bytes) and
its rank directory (u32 each).  All shards of a store lie in one Parquet folder, a row for each,
ascending by first document, their payloads neither compressed nor encoded, so ``lookup`` takes any id
out of the bytes as they lie.  Spark's committer writes that folder, so a lost or repeated task leaves
no half shard.

Texts are given to the library as they are: a special token that stands in a text is that token.

Defined results: a null or empty text has the end id only; texts of any length are encoded whole;
documents without a doc_id come first; rows with the same doc_id, or none, each stay, in the order of
a hash of their text, and may lie in several shards; an empty table gives an empty store; other
columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiring.llm.common import scratch_path

MAGIC = b"DAC2"
#: Bits of each level.  Any id below 2**32 can be coded.
LEVELS = (8, 8, 16)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BLOCK = 64  # bytes of bitmap for each count of the rank directory

#: White space other than these four makes the place of a safe cut depend on the pattern's details.
_ODD = re.compile("[%s]" % "".join(map(chr, [11, 12, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
_PIECE = re.compile(r"[ \n\r\t]+[^ \n\r\t]*|[^ \n\r\t]+")


#: Latin letters after at most one blank, then signs other than the apostrophe (which may open a contraction).
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


#: Where one of these stands, white space comes in runs or is of other kinds.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: The signs that end a word, without the apostrophe.
_SIGNS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _shown() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_SHOWN = _shown()
_BLANK = chr(_SHOWN[32])
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


# --- encoding of texts ------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder(dict):
    """Ids of whole texts, with the ids of pieces kept.

    A byte-level tokenizer never joins white space to what stands before it, so a text may be cut
    before each run of white space; a piece is given to the library once and then looked up.
    """

    LIMIT = 700_000  # pieces kept; beyond, those met first stay
    LONGEST = 64

    def __init__(self, path: str):
        super().__init__()
        self.library = tokenizer(path)
        self.model = self.library.model.tokenize
        self.later = _Later(self)

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= self.LONGEST:
            self[piece] = ids
        return ids

    def learn(self, piece: str) -> bytes:
        """A word with at most one blank before it is one pre-token, so the model can be asked at once; signs after it are another."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and word.isascii():
            return self._packed(piece if word is piece else _BLANK + word)
        if _letters(word):
            return self._word(piece)
        if piece[-1] in _SIGNS and _letters(word[:-1]):
            return (self.later[word[:-1]] if word is not piece else self[word[:-1]]) + self[piece[-1]]
        if (m := _WORD.fullmatch(piece)) is not None:
            return self.learn(m[1]) + self._word(m[2])
        return np.asarray(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _packed(self, shown: str) -> bytes:
        ids = [t.id for t in self.model(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return self._packed(word.encode().decode("latin-1").translate(_SHOWN))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        for kept in (self, self.later):
            if len(kept) > self.LIMIT:
                first = list(itertools.islice(kept.items(), self.LIMIT // 3))
                kept.clear()
                kept.update(first)
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if _ODD.search(text):
            return self[text]
        if any(run in text for run in _RUNS) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.__getitem__, _PIECE.findall(text)))
        # words with one blank or one line end between them: a line end before a word is a pre-token by itself
        parts, later, end = [], self.later.__getitem__, self["\n"]
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts += (end, self[head], *map(later, rest))
        return b"".join(parts[1:])


class _Later(dict):
    """Ids of words that one blank stands before, by the word alone."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.learn = encoder.learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(" " + word)
        if len(word) < PieceEncoder.LONGEST:
            self[word] = ids
        return ids


def _letters(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= "\u024f")


class WholeEncoder:
    """Ids of whole texts by the library alone, for tokenizers whose texts cannot be cut by the rules of ``PieceEncoder``."""

    def __init__(self, path: str):
        self.library = tokenizer(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]


def cut_like_bytes(path: str) -> bool:
    """Whether a tokenizer file is byte-level BPE as ``PieceEncoder`` cuts it: nothing normalised, the library's own split, no blank put before a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
    ordinary = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return plain and ordinary and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder | WholeEncoder:
    return PieceEncoder(path) if cut_like_bytes(path) else WholeEncoder(path)


# --- the format -------------------------------------------------------------------------------


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of the bitmap."""
    padded = np.zeros(-(-len(bits) // _BLOCK) * _BLOCK, np.uint8)
    padded[: len(bits)] = _POP[bits]
    counts = padded.reshape(-1, _BLOCK).sum(1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.zeros(0, "<u4")


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> bytes:
    """One shard; ``ids`` are those of all documents in turn, ``lengths`` their numbers."""
    rest, parts, sizes = ids.astype(np.uint32), [], []
    for k, bits in enumerate(levels):
        kind = np.uint8 if bits <= 8 else np.dtype("<u2")
        more = (rest >> bits) > 0 if k + 1 < len(levels) else np.zeros(len(rest), bool)
        flags = np.packbits(more, bitorder="little")
        parts += [(rest & ((1 << bits) - 1)).astype(kind).tobytes(), flags.tobytes(), _ranks(flags).tobytes()]
        sizes.append((bits, len(rest)))
        rest = rest[more] >> bits
    head = MAGIC + np.array([len(levels)], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    head += b"".join(np.array([b], "u1").tobytes() + np.array([n], "<u8").tobytes() for b, n in sizes)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    none = np.packbits(np.array([i is None for i in doc_ids], bool), bitorder="little")
    return head + np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes() + none.tobytes() + starts.tobytes() + b"".join(parts)


class Shard:
    """A shard opened for reading; its arrays are views of the bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.n_docs, self.n_ids = map(int, np.frombuffer(data, "<u8", 2, 8))
        at, sizes = 24, []
        for _ in range(n_levels):
            sizes.append((data[at], int(np.frombuffer(data, "<u8", 1, at + 1)[0])))
            at += 9
        ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        none = np.unpackbits(np.frombuffer(data, "u1", -(-self.n_docs // 8), at), count=self.n_docs, bitorder="little").astype(bool)
        at += -(-self.n_docs // 8)
        self.doc_ids = pa.array(ids, pa.int64(), mask=none)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for bits, n in sizes:
            kind = np.dtype("u1" if bits <= 8 else "<u2")
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            flags = np.frombuffer(data, "u1", -(-n // 8), at)
            at += len(flags)
            ranks = np.frombuffer(data, "<u4", -(-len(flags) // _BLOCK), at)
            at += 4 * len(ranks)
            self.levels.append((bits, chunks, flags, ranks))

    def token(self, i: int) -> int:
        """The id at place ``i`` of the shard: one chunk and one rank for each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for bits, chunks, flags, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += bits
            byte, bit = divmod(i, 8)
            if not flags[byte] >> bit & 1:
                break
            block = byte // _BLOCK
            i = int(ranks[block]) + int(_POP[flags[block * _BLOCK : byte]].sum()) + int(_POP[flags[byte] & ((1 << bit) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, at, shift = np.zeros(self.n_ids, np.uint32), None, 0
        for bits, chunks, flags, _ in self.levels:
            part = chunks.astype(np.uint32) << np.uint32(shift)
            if at is None:
                out, at = part, np.arange(self.n_ids)
            else:
                out[at] |= part
            at = at[np.unpackbits(flags, count=len(chunks), bitorder="little").astype(bool)]
            shift += bits
        return out


# --- store ------------------------------------------------------------------------------------


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
          end_id: int | None = 2, shard_ids: int = 8_000_000, partitions: int | None = None) -> str:
    """Encode every text, append ``end_id`` to each and write the store at ``path``, ascending by ``id_col``.

    A shard ends once it has ``shard_ids`` ids.  Documents are dealt by range of their id and a hash of
    their text, so each task holds one range, and many rows of one id or none are split; the number of
    ranges follows the session's shuffle partitions.
    """
    spark = df.sparkSession
    where = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
        .repartitionByRange(n, "doc_id", "th")
        .sortWithinPartitions("doc_id", "th", "text")
        .select("doc_id", "text")
    )

    def run(batches):
        encoder, keys, sizes, data, held = piece_encoder(where), [], [], [], 0

        def shard():
            ids = np.frombuffer(b"".join(data), "<u4")
            blob = pack(keys, np.array(sizes), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[0]], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([blob], pa.binary())], ["first_doc", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    keys.append(key)
                    sizes.append(len(raw) // 4)
                    data.append(raw)
                    held += sizes[-1]
                    if held >= shard_ids:
                        yield shard()
                        keys, sizes, data, held = [], [], [], 0
        if keys:
            yield shard()

    dealt.mapInArrow(run, "first_doc long, n_docs long, n_ids long, payload binary").withColumn("part", F.monotonically_increasing_id()).write.option(
        "compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store, each with ``start``: the number of ids in all shards before it.

    Only the numbers of ids of the shards meet in one task, a few bytes for each shard.
    """
    all_shards = spark.read.schema(
        "first_doc long, n_docs long, n_ids long, payload binary, part long").parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = all_shards.select("part", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"))
    return all_shards.join(F.broadcast(starts), "part")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it) and ``ids array<long>``."""
    return _per_document(shards(spark, path), "doc_id long, start long, ids array<long>",
                         lambda ids: pa.array(ids.tolist(), pa.int64()), pa.list_(pa.int64()))


def lookup(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """``place, id`` of the places of a table (column ``place``, counted over the whole store from 0); places outside have none.

    Only the shards that hold a place are read, and of these no id but those asked for is put together.
    """
    own = shards(spark, path)
    wanted = places.select(F.col("place").cast("long").alias("place")).where("place IS NOT NULL")
    # bins as wide as a shard is on average: a shard lies in few of them and a bin has few shards
    width = max(1, int(spark.read.schema("n_ids long").parquet(path).agg(F.avg("n_ids")).first()[0] or 1))
    stop = F.col("start") + F.col("n_ids")
    index = own.where("n_ids > 0").select("start", stop.alias("stop"), F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + n_ids - 1) div {width}"))).alias("bin"))
    held = wanted.withColumn("bin", F.when(F.col("place") >= 0, F.expr(f"place div {width}"))).join(index, "bin").where("place >= start AND place < stop")
    asked = held.groupBy("start", F.floor(F.col("place") / _ASKED).alias("piece")).agg(F.collect_set("place").alias("places"))

    def run(batches):
        for batch in batches:
            for start, blob, some in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Shard(blob)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([s.token(p - start) for p in some], pa.int64())], ["place", "id"])

    found = asked.join(own.select("start", "payload"), "start").select("start", "payload", "places").mapInArrow(run, "place long, id long")
    return wanted.join(found, "place", "left")


_ASKED = 1 << 20  # places of a stretch of so many ids are looked up together


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its ids as unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(blob)
                raw = memoryview(s.all().astype("<u4").tobytes())
                ends = s.starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [s.doc_ids, pa.array(s.starts[:-1] + start, pa.int64()),
                     pa.array(np.diff(s.starts), pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards(spark, path).select("start", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _per_document(found: DataFrame, schema: str, value, kind) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(blob)
                ids, ends = s.all(), s.starts.tolist()
                for at in range(0, s.n_docs, 256):
                    to = min(s.n_docs, at + 256)
                    lists = [ids[ends[k] : ends[k + 1]].tolist() for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [s.doc_ids.slice(at, to - at), pa.array(s.starts[at:to] + start, pa.int64()),
                         pa.array(lists, kind)], ["doc_id", "start", "ids"])

    return found.select("start", "payload").mapInArrow(run, schema)


def new_store(spark: SparkSession) -> str:
    return scratch_path(spark, "token-store")
