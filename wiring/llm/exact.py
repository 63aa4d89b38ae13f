"""Exact dedup with a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z.  The index is dealt into shards by the
digest of the normalised text.  A shard is a cuckoo filter of 16-bit marks in buckets of four, and beside
each mark, in the same bucket, the content it stands for: the 256-bit digest with the largest id and the
number of rows.  A mark that is met is only a hint; a hit is one whose stored content is equal.  Digests are
inserted and deleted; where no bucket takes a mark the filter doubles and is laid out anew from its
stored content, so no key is ever lost and there is no limit on their number.

Each task first runs the rows it reads through an index of its own (emptied whenever it holds
``_LOCAL`` keys), so a text that a third of all rows share reaches its shard once a task.

Defined results: a null text counts as empty; a null id is less than any id, and is the one that stays only
where its group has no other; rows that repeat id and text share their result; texts of any length are read
whole; an empty table gives an empty table; of other columns none is carried along by
``exact_duplicates`` and all, whatever their names, by ``dedup``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiring.llm.common import materialise

SLOTS = 4
#: Keys that a task's own index holds before it passes them on, and rows for which a shard is made.
_LOCAL, _SHARD_ROWS = 100_000, 400_000
_KICKS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a row that reaches a shard is there for, in the order in which a shard takes them.
STORED, DELETE, INSERT, LOOKUP = range(4)
_ENTRY = "digest binary, id long, n long"


class CuckooIndex:
    """Digests with an id and a count each."""

    def __init__(self, buckets: int = 64):
        self.live = 0
        self._lay_out(buckets)

    def _lay_out(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.buckets = buckets
        self.marks = array("H", bytes(2 * SLOTS * buckets))  # 0: free
        self.content: list[tuple[bytes, int | None, int] | None] = [None] * (SLOTS * buckets)

    def _home(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:10], "little") or 1, int.from_bytes(digest[:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _find(self, digest: bytes) -> int:
        mark, first = self._home(digest)
        for bucket in (first, self._other(first, mark)):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.marks[slot] == mark and self.content[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> tuple[int | None, int] | None:
        """Id and count of a live digest."""
        slot = self._find(digest)
        return None if slot < 0 else self.content[slot][1:]

    def insert(self, digest: bytes, id_: int | None, n: int = 1) -> None:
        """A live digest keeps the larger id and the sum of the counts."""
        slot = self._find(digest)
        if slot >= 0:
            _, had, count = self.content[slot]
            self.content[slot] = (digest, max((x for x in (had, id_) if x is not None), default=None), count + n)
            return
        self.live += 1
        left = self._place((digest, id_, n))
        if left is not None:
            self._resize([*filter(None, self.content), left])

    def _resize(self, every: list[tuple[bytes, int | None, int]]) -> None:
        """Lay all content out anew in twice the buckets, or as many times twice as it takes."""
        self._lay_out(2 * self.buckets)
        while any(self._place(entry) is not None for entry in every):
            self._lay_out(2 * self.buckets)

    def _place(self, entry: tuple[bytes, int | None, int]) -> tuple[bytes, int | None, int] | None:
        """The entry that is left without a slot, if any."""
        mark, bucket = self._home(entry[0])
        for kick in range(_KICKS):
            for at in (bucket, self._other(bucket, mark)):
                for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                    if not self.marks[slot]:
                        self.marks[slot], self.content[slot] = mark, entry
                        return None
            at = self._other(bucket, mark)
            slot = SLOTS * at + (kick * 7 + mark) % SLOTS
            mark, self.marks[slot] = self.marks[slot], mark
            entry, self.content[slot] = self.content[slot], entry
            bucket = self._other(at, mark)
        return entry

    def delete(self, digest: bytes) -> bool:
        slot = self._find(digest)
        if slot < 0:
            return False
        self.marks[slot], self.content[slot] = 0, None
        self.live -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        return filter(None, self.content)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), 256))


def _shard(digest_col: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest_col), F.lit(shards)).cast("int")


def _batches(entries: Iterator[tuple[bytes, int | None, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = list(entries)
    for at in range(0, len(rows), 10_000):
        digests, ids, counts = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest of a task's rows once, or once for every ``_LOCAL`` different ones."""
    index = CuckooIndex()
    for batch in batches:
        for key, id_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index.insert(key, id_)
            if index.live >= _LOCAL:
                yield from _batches(index.entries(), ["digest", "id", "n"])
                index = CuckooIndex()
    yield from _batches(index.entries(), ["digest", "id", "n"])


def _served(answer: bool):
    """A function over rows in order of shard and kind: what is live in the end, or with ``answer`` the hits of the lookups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, asked, hits = CuckooIndex(), None, set(), []
        for batch in batches:
            for shard, what, key, id_, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if not answer:
                        yield from _batches(index.entries(), ["digest", "id", "n"])
                    index, at, asked = CuckooIndex(), shard, set()
                if what == DELETE:
                    index.delete(key)
                elif what == LOOKUP:
                    found = index.get(key)
                    if found and key not in asked:
                        asked.add(key)
                        hits.append((key, *found))
                else:
                    index.insert(key, id_, n)
            yield from _batches(iter(hits), ["digest", "id", "n"])
            hits = []
        if not answer:
            yield from _batches(index.entries(), ["digest", "id", "n"])

    return run


def _at_shards(parts: list[tuple[int, DataFrame]], shards: int, answer: bool) -> DataFrame:
    rows = None
    for what, df in parts:
        each = df.select(_shard("digest", shards).alias("shard"), F.lit(what).alias("what"), "digest", "id", "n")
        rows = each if rows is None else rows.unionByName(each)
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "what")
    return dealt.mapInArrow(_served(answer), _ENTRY)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, id`` of every row."""
    return df.select(digest(df[text_col]).alias("digest"), df[id_col].cast("long").alias("id"))


def shards_for(keys: DataFrame) -> int:
    """So many shards that one has ``_SHARD_ROWS`` rows at most if none are equal."""
    return max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // _SHARD_ROWS))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _ENTRY)


def update(index: DataFrame, insert: DataFrame | None = None, delete: DataFrame | None = None, shards: int = 64) -> DataFrame:
    """The next state of an index (``digest, id, n``): the digests in ``delete`` go first, the rows of ``insert`` (see ``keyed``) come then."""
    parts = [(STORED, index)]
    if delete is not None:
        gone = delete.select("digest").withColumns({"id": F.lit(None).cast("long")}).mapInArrow(_gathered, _ENTRY)
        parts.append((DELETE, gone))
    if insert is not None:
        parts.append((INSERT, insert.select("digest", "id").mapInArrow(_gathered, _ENTRY)))
    return _at_shards(parts, shards, answer=False)


def lookup(index: DataFrame, keys: DataFrame, shards: int = 64) -> DataFrame:
    """``digest, id, n`` of every different live digest among ``keys``."""
    asked = keys.select("digest", F.lit(None).cast("long").alias("id")).mapInArrow(_gathered, _ENTRY)
    return _at_shards([(STORED, index), (LOOKUP, asked)], shards, answer=True)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` for every row."""
    keys = materialise(keyed(df, id_col, text_col), "digests")
    index = update(empty(df.sparkSession), insert=keys, shards=shards_for(keys))
    groups = index.where("n > 1").select("digest", F.col("id").alias("most"), "n")
    # only groups of several rows need the join; a large one is split among tasks where rows are read again
    both = keys.join(groups.hint("merge"), "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("most"))
    return both.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    gone = exact_duplicates(df, id_col, text_col).where("NOT kept").select(F.col("digest").alias("__gone_digest"), F.col("id").alias("__gone_id")).distinct()
    return df.join(gone, (digest(df[text_col]) == F.col("__gone_digest")) & df[id_col].cast("long").eqNullSafe(F.col("__gone_id")), "left_anti")
