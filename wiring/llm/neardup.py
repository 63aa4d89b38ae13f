"""Near-duplicate documents by b-bit MinHash.

1. A document's set is its distinct word shingles, hashed to 64 bits.  Of ``BANDS * ROWS`` minima the
   lowest two bits are packed into a signature, and each band of ``ROWS`` minima is hashed to a key.
2. Documents with equal sets are one class; only classes go on, each under a number of its own.
3. Each band key names one class as hub: the one whose keys are shared most, as that is nearest the
   middle of its group.  A class is paired with its hubs, so a bucket of n gives n - 1 pairs.  Bit
   counts of signatures, corrected for chance agreement, and the sizes of the sets drop hopeless pairs
   (five standard errors below the threshold).
4. Links are confirmed on full sets: first one pair for each class, then the pairs whose ends are
   still in different components.
5. Buckets that still hold several components are compared member by member through their
   signatures, in blocks.  First each member's likeliest pair across components goes to the full
   sets.  Then the members that still have a hopeful partner across are named, a row for each; their
   full sets are brought to them once and compared inside the bucket, in blocks of bounded bytes,
   and a link comes out only where it joins two components.  So no link between different texts that
   share a band key is lost, and what is written grows with the members, never with their pairs.
6. Components are labelled by hooking and pointer jumping; every round is written in the shared folder.

A pair with similarity 0.8 shares no band key with a chance of (1 - 0.8**6)**40, about 5e-6.

Defined results: a null text is empty; an empty document, or one without words, has no shingles, is
linked with nothing and is kept; a text with fewer words than a shingle has its whole sequence as
one; rows with one id are one document, so their texts' links are joined and they are kept or go
together; each row without an id is a document by itself, a component without any id has a null
``component_id``, and just one of its rows is kept; an empty table gives an empty table; texts of any
length are read whole; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiring.llm.common import discard, materialise

BANDS, ROWS, BITS = 40, 6, 2
MINIMA = BANDS * ROWS
_BLOCK = 4096  # members of a bucket whose signatures are compared at once
_BLOCK_SHINGLES = 1 << 21  # shingles of a block whose sets are compared at once, 16 MB
_U64 = np.uint64


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, MINIMA, dtype=_U64) * _U64(2) + _U64(1), rng.integers(0, 1 << 63, MINIMA, dtype=_U64)


_A, _B = _multipliers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


class Shingler:
    """Sets of shingle hashes; the hashes of words met before are kept."""

    LIMIT = 500_000

    def __init__(self, size: int):
        self.size, self.kept = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the shingles of ``text``."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, _U64)
        kept = self.kept
        if len(kept) > self.LIMIT:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, words), _U64, len(words))
        n = min(self.size, len(h))
        out = np.zeros(len(h) - n + 1, _U64)
        for k in range(n):
            out = out * _U64(0x9E3779B97F4A7C15) + _mix(h[k : len(h) - n + 1 + k] + _U64(k + 1))
        return np.unique(_mix(out + _U64(n)))


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(MINIMA, np.iinfo(_U64).max, _U64)
    for at in range(0, len(shingles), 512):
        np.minimum(best, (shingles[at : at + 512, None] * _A + _B).min(0), out=best)
    return best


def signature(low: np.ndarray) -> np.ndarray:
    """The lowest two bits of each minimum, 32 to a word; unused places are zero."""
    flat = np.zeros(-(-MINIMA // 32) * 32, _U64)
    flat[:MINIMA] = low & _U64((1 << BITS) - 1)
    return (flat.reshape(-1, 32) << (np.arange(32, dtype=_U64) * _U64(BITS))).sum(1, dtype=_U64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=_U64) + _U64(1)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key * _U64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: the share of equal two-bit places, corrected for chance."""
    odd = F.lit(0x5555555555555555)

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))

    total = sum((differing(i) for i in range(1, -(-MINIMA // 32))), differing(0))
    chance = 1 / (1 << BITS)
    return ((1 - total / float(MINIMA)) - chance) / (1 - chance)


def hopeful(threshold: int) -> float:
    """Five standard errors below the threshold, in percent."""
    j, chance = threshold / 100, 1 / (1 << BITS)
    c = chance + (1 - chance) * j
    return j - 5 * (c * (1 - c) / MINIMA) ** 0.5 / (1 - chance)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, th, n, k1, k2, sig, bands``: a hash of the text, the size and hash of its set, and what MinHash makes of it."""

    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(2).to_pylist():
                    s = shingle(text)
                    low = minima(s)
                    rows.append((len(s), *digest(s), signature(low), band_keys(low) if len(s) else []))
                n, k1, k2, sig, bands = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "n", "k1", "k2", "sig", "bands"])

    return _documents(df, id_col, text_col).mapInArrow(run, "id long, th long, n long, k1 long, k2 long, sig array<long>, bands array<long>")


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(shingles.tobytes()))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, set``: the full sets of classes from ``id, text`` of one document of each."""

    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shingle(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets meet the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U64), np.frombuffer(y.as_buffer(), _U64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= threshold * (len(x) + len(y) - same) > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, label`` of every class that has a link now or had one before; a label is a component's least id.

    Each round hooks every label to the least one that a link leads to and jumps pointers, until no
    link joins two labels.  Classes without links are their own component and have no row.
    """
    made: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    links = write(links, "links")
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    before = labels
    if labels is None:
        labels = ends.withColumn("label", F.col("id"))
    else:
        labels = labels.unionByName(ends.join(labels, "id", "left_anti").withColumn("label", F.col("id")))
    labels = write(labels, "labels")
    while True:
        open_links = write(between(links, labels), "open")
        if open_links.isEmpty():
            break
        hooked = (
            open_links.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to"))
            .groupBy("label").agg(F.min("to").alias("to"))
        )
        parents = write(hooked, "parents")
        while True:  # pointer jumping: as many rounds as the depth has binary digits
            up = parents.select(F.col("label").alias("to"), F.col("to").alias("next"))
            jumped = write(parents.join(up, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parents")
            parents = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = write(labels.join(parents, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    for old in (before, *made):  # a round reads only the tables of the last one
        if old is not None and old is not labels:
            discard(old)
    return labels


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels, with them; an end without a row is its own label."""
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    found = pairs.join(la, "a", "left").join(lb, "b", "left")
    return found.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")


def _dealt(members: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """``members`` of each band in ``blocks`` blocks; each two blocks meet in one group ``band, x, y``."""
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *columns)


class _Group:
    """Members of two blocks of a bucket, or of one: who is to be held against whom, and who leaves hope."""

    def __init__(self, key: tuple, table: pa.Table, threshold: int):
        x, y = key[1].as_py(), key[2].as_py()
        self.ids, self.labels, self.n, own = (table.column(c).to_numpy() for c in ("id", "label", "n", "own"))
        self.labels = self.labels.copy()
        self.sig = np.stack(table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)).view(_U64)
        self.single, self.threshold = x == y, threshold
        self.lefts, self.rights = np.flatnonzero(own == x), np.flatnonzero(own == y)
        self.least, self.chance = hopeful(threshold), 1 / (1 << BITS)

    def hopeful(self, i: int, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``rights`` those across components whose sizes and signatures leave hope for a link with ``i``, and the estimates."""
        n = self.n
        rights = rights[self.labels[rights] != self.labels[i]]
        rights = rights[np.minimum(n[rights], n[i]) * 100 >= self.threshold * np.maximum(n[rights], n[i])]
        x = self.sig[rights] ^ self.sig[i]
        same = 1 - np.bitwise_count((x | (x >> _U64(1))) & _U64(0x5555555555555555)).sum(1) / MINIMA
        estimates = (same - self.chance) / (1 - self.chance)
        keep = estimates >= self.least
        return rights[keep], estimates[keep]


def likeliest(members: DataFrame, threshold: int) -> DataFrame:
    """Of each member of a group its likeliest pair ``a, b`` across components, if there is hope.

    ``members`` has ``band, cnt, id, label, n, sig``; no task holds more than two blocks of ``_BLOCK``.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, a, b = _Group(key, table, threshold), [], []
        for i in group.lefts:
            right, estimates = group.hopeful(i, group.rights)
            if len(right):
                j = right[estimates.argmax()]
                a.append(max(group.ids[i], group.ids[j]))
                b.append(min(group.ids[i], group.ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = _dealt(members, F.ceil(F.col("cnt") / _BLOCK).cast("int"), "id", "label", "n", "sig")
    return dealt.groupBy("band", "x", "y").applyInArrow(run, "a long, b long").distinct()


def undecided(members: DataFrame, threshold: int) -> DataFrame:
    """``band, id`` of the members that have a hopeful partner across components; ``members`` as in ``likeliest``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(key, table, threshold)
        open_ends = np.zeros(len(group.ids), bool)
        for i in group.lefts:
            right, _ = group.hopeful(i, group.rights[group.rights > i] if group.single else group.rights)
            open_ends[right] = True
            open_ends[i] |= len(right) > 0
        ids = group.ids[open_ends]
        return pa.table({"band": pa.array(np.full(len(ids), key[0].as_py()), pa.int64()), "id": pa.array(ids, pa.int64())})

    dealt = _dealt(members, F.ceil(F.col("cnt") / _BLOCK).cast("int"), "id", "label", "n", "sig")
    return dealt.groupBy("band", "x", "y").applyInArrow(run, "band long, id long").distinct()


def spanning(members: DataFrame, threshold: int) -> DataFrame:
    """Links ``a, b`` confirmed on full sets that join the components of each group, fewer than its members.

    ``members`` has ``band, id, label, n, sig, set``; a block has ``_BLOCK_SHINGLES`` shingles or one member.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, a, b = _Group(key, table, threshold), [], []
        ids, labels, n = group.ids, group.labels, group.n
        every = np.concatenate([np.frombuffer(s.as_buffer(), _U64) for s in table.column("set").combine_chunks()])
        tokens = np.unique(every, return_inverse=True)[1].astype(np.int32)
        ends = np.cumsum(n)
        marked = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
        for i in group.lefts:
            right, _ = group.hopeful(i, group.rights[group.rights > i] if group.single else group.rights)
            if not len(right):
                continue
            own = tokens[ends[i] - n[i] : ends[i]]
            marked[own] = 1
            theirs = np.concatenate([tokens[ends[j] - n[j] : ends[j]] for j in right])
            same = np.add.reduceat(marked[theirs], np.cumsum(n[right]) - n[right])
            marked[own] = 0
            linked = right[100 * same >= threshold * (n[i] + n[right] - same)]
            joined, first = np.unique(labels[linked], return_index=True)
            for j in linked[first]:
                a.append(max(ids[i], ids[j]))
                b.append(min(ids[i], ids[j]))
            if len(joined):
                labels[np.isin(labels, joined)] = labels[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = members.groupBy("band").agg(F.ceil(F.sum("n") / _BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = _dealt(members.join(sizes, "band"), F.col("blocks"), "id", "label", "n", "sig", "set")
    return dealt.groupBy("band", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _same_ids(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id, from the least class of each."""
    keys = F.struct("k1", "k2")
    several = base.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(keys).alias("low"), F.max(keys).alias("high")).where("low <> high").select("id")
    rows = base.where("n > 0").join(several, "id").select(F.col("id").alias("doc"), "k1", "k2").distinct()
    numbered = rows.join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc", "id")
    least = numbered.groupBy("doc").agg(F.min("id").alias("b"))
    return numbered.join(least, "doc").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``, ``kept`` and ``text_hash``; of a component the document with the least id is kept."""
    base = materialise(sketches(df, id_col, text_col, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # the row that stands for a class: the one with the least id, those without come last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("doc"), "th", "row")).alias("rep")
    classes = base.where("n > 0").groupBy("k1", "k2").agg(first, F.first(F.struct("n", "sig", "bands")).alias("s"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "rep", "s.n", "s.sig", "s.bands"), "classes")

    keys = classes.select("id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    placed = materialise(keys.join(shared.hint("merge"), "band"), "shared-keys")
    middle = placed.groupBy("id").agg(F.sum("cnt").alias("middle"))
    hubs = placed.join(middle.hint("merge"), "id").groupBy("band").agg(F.max(F.struct("middle", (-F.col("id")).alias("back"))).alias("m"))
    buckets = materialise(placed.join(hubs.select("band", (-F.col("m.back")).alias("hub")).hint("merge"), "band"), "buckets")
    known = classes.select("id", "n", "sig")
    stars = buckets.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    ka, kb = (known.select(*[F.col(c).alias(f"{c}_{k}") for c in known.columns]) for k in "ab")
    judged = stars.join(ka.hint("merge"), F.col("a") == F.col("id_a")).join(kb.hint("merge"), F.col("b") == F.col("id_b"))
    judged = judged.withColumn("est", estimate(F.col("sig_a"), F.col("sig_b"))).where(
        (F.col("est") >= hopeful(threshold)) & (F.least("n_a", "n_b") * 100 >= threshold * F.greatest("n_a", "n_b")))
    pairs = materialise(judged.select("a", "b", "est"), "pairs")

    involved = classes.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi").select("id", F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"))
    texts = _documents(df, id_col, text_col).withColumnsRenamed({"id": "doc", "th": "own"})
    # rows without an id are told apart by their text, so that their key is no hot one
    by_text = F.coalesce(F.col("doc"), F.col("own")), F.col("own")
    texts = texts.select(by_text[0].alias("key"), by_text[1].alias("th"), F.col("doc").isNull().alias("none"), "text")
    wanted = involved.select("id", F.coalesce("doc", "th").alias("key"), "th", F.col("doc").isNull().alias("none"))
    sets = materialise(_sets(texts.join(wanted.hint("merge"), ["key", "th", "none"]).select("id", "text"), size).dropDuplicates(["id"]), "sets")
    best = pairs.groupBy("a").agg(F.max_by("b", "est").alias("b"))
    labels = components(None, confirmed(best, sets, threshold).unionByName(_same_ids(base, classes)))
    labels = components(labels, confirmed(between(pairs, labels), sets, threshold))

    def split(*columns: str) -> DataFrame:
        """Members of the buckets that hold several components."""
        named = buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        several = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
        return named.join(several.hint("merge"), "band").join(known.hint("merge"), "id").select(*columns)

    columns = "band", "cnt", "id", "label", "n", "sig"
    labels = components(labels, confirmed(likeliest(split(*columns), threshold), sets, threshold))
    members = materialise(split(*columns), "members")
    open_ends = materialise(undecided(members, threshold), "undecided")
    brought = members.join(open_ends.hint("merge"), ["band", "id"]).join(sets.hint("merge"), "id")
    labels = components(labels, spanning(brought, threshold))

    named = classes.join(labels.hint("merge"), "id", "left").select("k1", "k2", "rep", F.coalesce("label", "id").alias("label"))
    heads = named.groupBy("label").agg(F.min("rep").alias("head"))
    named = named.join(heads.hint("merge"), "label").select("k1", "k2", "head")
    both = base.join(named.hint("merge"), ["k1", "k2"], "left")
    linked = F.col("n") > 0
    done = both.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.col("head.doc")).otherwise(F.col("id")).alias("component_id"),
        F.when(~linked, F.lit(True)).when(F.col("head.doc").isNull(), F.col("row") == F.col("head.row")).otherwise(F.col("id").eqNullSafe(F.col("head.doc"))).alias("kept"),
        F.col("th").alias("text_hash"))
    done = materialise(done, "near-duplicates")
    for table in (sets, placed, buckets, classes, base, pairs, members, open_ends, labels):
        discard(table)
    return done
