"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into parts of at most ``PART`` words; their words are the vocabulary.
   Document frequencies of these words are counted over every passage of the corpus.
2. A randomised SVD of TF-IDF passages gives the latent space.  It is fitted on a bounded sample,
   about ``fit_passages`` passages chosen by a hash, beside all parts of the benchmark, which weigh
   more so that the space keeps them; partial sketches come from the executors.
3. Every document is cut into blocks of ``BLOCK`` words.  A block's latent vector is a sum over its
   words, a window's the sum of two or three neighbouring blocks, wide enough to hold a whole part
   wherever it starts.  Windows and parts with a cosine of at least ``cosine`` are candidates; there
   is no cap on their number.  So is every place where a part stands word by word, whatever its cosine,
   found by the part's rarest word: a short part is diluted in a window.
4. A candidate is confirmed on the words themselves: the longest common subsequence must cover
   ``sure`` of the part, or ``likely`` of it with the answer found too (what follows ``answer:``, whole and
   anywhere in the words that the whole item would span, else the part's last five words).  Parts of fewer than ``SHORT`` words must stand there word by word.

A benchmark of more than ``GROUP`` items is screened in groups, a pass over the documents for each, so
what is broadcast has a fixed bound.

Defined results: null and empty texts have no leaks; items without words are never found; texts are
read whole; rows are kept one to one, repeated ones too; repeated items are each reported; an
empty table on either side gives no leaks; of other columns only those in ``keep`` are carried along.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiring.llm.common import discard, materialise

BLOCK, PART, SHORT, GROUP = 32, 64, 8, 512
_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"\banswer\s*[:=]\s*", re.I)

LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("lcs", T.DoubleType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("answer", T.BooleanType()), T.StructField("word", T.LongType())]))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Part:
    """A run of words of an item, its answer, and how many words of the item before and after the run the answer may lie in."""

    item_id: int | None
    words: list[str]
    answer: list[str]
    before: int = 0
    after: int = 0


def parts_of(items: list[tuple[int | None, str | None]]) -> list[Part]:
    found = []
    for item_id, text in items:
        every = words(text)
        said = _ANSWER.split(text or "", maxsplit=1)
        answer = words(said[1]) if len(said) > 1 else []
        n = max(1, -(-len(every) // PART))
        size = -(-len(every) // n)
        for at in range(0, len(every), max(size, 1)):
            piece = every[at : at + size]
            around = (at, len(every) - at - len(piece)) if answer else (0, 0)
            found.append(Part(item_id, piece, answer or piece[-5:], *around))
    return found


def common_subsequence(masks: dict, size: int, tokens: list) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word in the first sequence."""
    full = (1 << size) - 1
    v = full
    for t in tokens:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(tokens: list) -> dict:
    out: dict = {}
    for k, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << k
    return out


def known_ids(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of several texts in turn, -1 for one not in the vocabulary, and how many words each text has."""
    docs = [words(t) for t in texts]
    lengths = np.array([len(t) for t in docs], np.int64)
    every = itertools.chain.from_iterable(docs)
    return np.fromiter(map(vocabulary.get, every, itertools.repeat(-1)), np.int64, int(lengths.sum())), lengths


class Index:
    """The latent space of a group of items, and the search of a document in it."""

    def __init__(self, parts: list[Part], vocabulary: dict[str, int], idf: np.ndarray, basis: np.ndarray, cosine: float, sure: float, likely: float):
        parts = sorted(parts, key=_span)  # parts that need as wide a window stand together
        self.parts, self.vocabulary, self.cosine, self.sure, self.likely = parts, vocabulary, cosine, sure, likely
        self.projected = (basis * idf[:, None]).astype(np.float32)
        self.ids = [np.array([vocabulary[w] for w in p.words]) for p in parts]
        latent = np.stack([self._sum(ids) for ids in self.ids])
        norms = np.linalg.norm(latent, axis=1)
        self.latent = (latent / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
        self.spans = np.array([_span(p) for p in parts])
        self.masks = [masks_of(ids.tolist()) for ids in self.ids]
        self.answers = [masks_of([vocabulary.get(w, -2) for w in p.answer]) for p in parts]
        # the rarest word of each part: the parts it stands for and its place in them
        self.anchors: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(self.ids):
            place = int(np.argmax(idf[ids]))
            self.anchors.setdefault(int(ids[place]), []).append((k, place))
        self.is_anchor = np.zeros(len(vocabulary) + 1, bool)  # the last is for words not in the vocabulary, -1
        self.is_anchor[list(self.anchors)] = True

    def _sum(self, ids: np.ndarray) -> np.ndarray:
        return self.projected[ids].sum(0)

    def blocks(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The latent vectors of the blocks of words of several documents, zeros between these, and where each begins."""
        gap = int(self.spans.max()) - 1
        sizes = -(-lengths // BLOCK) + gap
        begins = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(begins[:-1], lengths) + (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // BLOCK
        at = np.flatnonzero(ids >= 0)
        out = np.zeros((int(begins[-1]), self.projected.shape[1]), np.float32)
        for k in range(0, len(at), 512):  # so few rows stay in the processor's cache
            some = at[k : k + 512]
            block = place[some]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            out[block[first]] += np.add.reduceat(self.projected.take(ids[some], axis=0), first, axis=0)
        return out, begins

    def exact(self, ids: np.ndarray, lengths: np.ndarray):
        """(document, part, first word) of every place where a part stands word by word."""
        ends = np.cumsum(lengths)
        at = np.flatnonzero(self.is_anchor[ids])
        doc = np.searchsorted(ends, at, "right")
        for d, w, known in zip(doc.tolist(), at.tolist(), ids[at].tolist(), strict=True):
            end = int(ends[d])
            begin = end - int(lengths[d])
            for k, place in self.anchors[known]:
                own, start = self.ids[k], w - place
                if begin <= start and start + len(own) <= end and (ids[start : start + len(own)] == own).all():
                    yield d, k, start - begin

    def candidates(self, ids: np.ndarray, lengths: np.ndarray):
        """(document, part, first block, cosine) of every window near a part or with all its words in turn."""
        blocks, begins = self.blocks(ids, lengths)
        window = blocks
        for span in range(1, int(self.spans.max()) + 1):
            n = max(0, len(blocks) - span + 1)
            if span > 1:  # a window's vector, and so its products, are sums over its blocks
                window = window[:n] + blocks[span - 1 :]
            first, last = np.searchsorted(self.spans, [span, span + 1])
            if first == last or not n:
                continue
            near = blocks @ self.latent[first:last].T
            sims = near[:n].copy()
            for k in range(1, span):
                sims += near[k : k + n]
            norms = np.sqrt(np.einsum("ij,ij->i", window, window))
            found = np.flatnonzero(sims >= np.where(norms > 0, self.cosine * norms, np.inf)[:, None].astype(np.float32))
            w, p = np.divmod(found, last - first)
            doc = np.searchsorted(begins, w, "right") - 1
            yield from zip(doc.tolist(), (first + p).tolist(), (w - begins[doc]).tolist(), (sims[w, p] / norms[w]).tolist(), strict=True)
        for d, k, start in self.exact(ids, lengths):
            at = int(begins[d]) + start // BLOCK
            vector = blocks[at : at + int(self.spans[k])].sum(0)
            yield d, k, start // BLOCK, float(vector @ self.latent[k] / (np.linalg.norm(vector) or 1))

    def confirm(self, k: int, tokens: np.ndarray, start: int) -> tuple[float, bool, bool]:
        """Share of the part in the longest common subsequence of the window at ``start``, whether its answer is there, and the verdict."""
        part = self.parts[k]
        n, end = len(part.words), start + int(self.spans[k]) * BLOCK
        window = tokens[start:end].tolist()
        share = common_subsequence(self.masks[k], n, window) / n
        if n < SHORT and share < 1 or share < min(self.sure, self.likely):
            return share, False, False
        stretch = tokens[max(0, start - part.before) : end + part.after].tolist()
        answer = common_subsequence(self.answers[k], len(part.answer), stretch) >= 0.8 * len(part.answer)
        if n < SHORT:
            own = self.ids[k].tolist()
            leak = any(window[i : i + n] == own for i in range(len(window) - n + 1))
        else:
            leak = share >= self.sure or (share >= self.likely and answer)
        return share, answer, leak

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text the items it leaks, with the window that shows most of each."""
        ids, lengths = known_ids(texts, self.vocabulary)
        begins = np.cumsum(lengths) - lengths
        best: list[dict] = [{} for _ in texts]
        for d, k, block, near in self.candidates(ids, lengths):
            start = block * BLOCK
            share, answer, leak = self.confirm(k, ids[begins[d] : begins[d] + lengths[d]], start)
            item = self.parts[k].item_id
            if leak and (item not in best[d] or share > best[d][item]["lcs"]):
                best[d][item] = {"item_id": item, "lcs": share, "cosine": min(near, 1.0), "answer": answer, "word": start}
        return [[b[i] for i in sorted(b, key=lambda i: (i is not None, i))] for b in best]


def _span(part: Part) -> int:
    """How many blocks hold a part wherever it starts."""
    return -(-(len(part.words) - 1) // BLOCK) + 1


def survey(docs: DataFrame, vocabulary: dict[str, int], fit_passages: int) -> tuple[np.ndarray, int, DataFrame]:
    """What one pass over the texts gives: in how many passages of ``2 * BLOCK`` words each word of the
    vocabulary stands, the number of passages, and a sample of about ``fit_passages`` of them, ``ids array<long>``.

    A document with n passages gives one of them if a number drawn by the hash of its text is below n
    times a share; the share that the numbers of texts and characters suggest is generous, and the sample is
    thinned once the passages are counted.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    some, chars = docs.agg(F.count("text"), F.sum(F.length("text"))).first()
    generous = min(1.0, fit_passages / max(1.0, some, (chars or 0) / _MOST_CHARS))

    def run(batches):
        import xxhash

        known = sent.value
        counts, total = np.zeros(len(known), np.int64), 0
        kinds = [("k", pa.int64()), ("n", pa.int64()), ("place", pa.float64()), ("ids", pa.list_(pa.int64()))]

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                ids, lengths = known_ids(texts, known)
                sizes = -(-lengths // (2 * BLOCK))
                starts = np.cumsum(lengths) - lengths
                inside = np.arange(len(ids)) - np.repeat(starts, lengths)
                passage = np.repeat(np.cumsum(sizes) - sizes, lengths) + inside // (2 * BLOCK)
                total += int(sizes.sum())
                some = ids >= 0
                counts += np.bincount(np.unique(passage[some] * len(known) + ids[some]) % len(known), minlength=len(known))
                places, picked = [], []
                for text, n, start, length in zip(texts, sizes.tolist(), starts.tolist(), lengths.tolist(), strict=True):
                    if not n:
                        continue
                    seed = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                    place = (seed >> 11) * 2.0**-53 / n
                    if place < generous:
                        first = start + 2 * BLOCK * (xxhash.xxh3_64_intdigest(seed.to_bytes(8, "little")) % n)
                        own = ids[first : min(first + 2 * BLOCK, start + length)]
                        places.append(place)
                        picked.append(own[own >= 0].tolist())
                if places:
                    yield rows([[None] * len(places), [None] * len(places), places, picked])
        at = np.flatnonzero(counts)
        yield rows([np.r_[at, -1], np.r_[counts[at], total], [None] * (len(at) + 1), [None] * (len(at) + 1)])

    found = materialise(docs.mapInArrow(run, "k long, n long, place double, ids array<long>"), "survey")
    out, passages = np.zeros(len(vocabulary)), 0
    for r in found.where("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each word of the group
        if r["k"] < 0:
            passages = r["n"]
        else:
            out[r["k"]] = r["n"]
    return out, passages, found.where((F.col("place") < fit_passages / max(1, passages))).select("ids")


#: More characters than a passage has in any usual text.
_MOST_CHARS = 2.0 * BLOCK * 16


def _normal(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(ids, return_counts=True)
    w = tf * idf[at]
    norm = np.linalg.norm(w)
    return at, w / norm if norm else w


def latent_basis(sample: DataFrame, parts: list[Part], vocabulary: dict[str, int], idf: np.ndarray, rank: int, fit_passages: int, tasks: int = 8) -> np.ndarray:
    """An orthonormal basis, words by ``rank``, of the leading right singular vectors of the sampled passages and the parts."""
    size, over = len(vocabulary), 16
    rank = min(rank, size)
    width = min(size, rank + over)
    omega = np.random.default_rng(11).standard_normal((size, width)).astype(np.float32)
    sc = sample.sparkSession.sparkContext
    sent = sc.broadcast(idf)
    sample = sample.repartition(tasks)
    extra = [np.array([vocabulary[w] for w in p.words]) for p in parts]
    weight = (2.0 * fit_passages / rank) ** 0.5

    def summed(matrix: np.ndarray, outer: bool) -> np.ndarray:
        """Sum over the rows a of A of a' (a M), or of (a M)' (a M)."""
        other = sc.broadcast(matrix)

        def run(batches):
            m, weights = other.value, sent.value
            total = np.zeros(m.shape if outer else (m.shape[1], m.shape[1]))
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    at, w = _normal(np.array(ids, np.int64), weights)
                    y = w @ m[at] if len(at) else np.zeros(m.shape[1])
                    if outer:
                        total[at] += np.outer(w, y)
                    else:
                        total += np.outer(y, y)
            used = np.flatnonzero(total.any(axis=1))
            for k in range(0, len(used), 1024):
                some = used[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([v.tobytes() for v in total[some].astype("<f4")], pa.binary())], ["row", "v"])

        out = np.zeros(matrix.shape if outer else (matrix.shape[1], matrix.shape[1]))
        for r in sample.mapInArrow(run, "row long, v binary").toLocalIterator():  # at most ``tasks`` partial sums
            out[r["row"]] += np.frombuffer(r["v"], "<f4")
        for ids in extra:
            at, w = _normal(ids, idf)
            y = (weight * w) @ matrix[at]
            if outer:
                out[at] += weight * np.outer(w, y)
            else:
                out += np.outer(y, y)
        return out

    q, _ = np.linalg.qr(summed(omega, True))
    values, vectors = np.linalg.eigh(summed(q.astype(np.float32), False))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def build(docs: DataFrame, items: list[tuple[int | None, str | None]], text_col: str = "text", rank: int = 256, fit_passages: int = 20_000,
          cosine: float = 0.5, sure: float = 0.8, likely: float = 0.6) -> Index | None:
    """The index of a group of items over the corpus; ``None`` if no item has words."""
    parts = [p for p in parts_of(items) if p.words]
    if not parts:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({w for p in parts for w in p.words}))}
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    df, passages, sample = survey(texts, vocabulary, fit_passages)
    idf = np.log((1 + passages) / (1 + df)) + 0.01
    basis = latent_basis(sample, parts, vocabulary, idf, min(rank, len(parts) + 32), fit_passages)
    discard(sample)
    return Index(parts, vocabulary, idf, basis, cosine, sure, likely)


def screen(df: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_col: str = "text", text_col: str = "text",
           keep: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """The columns in ``keep`` and ``leaks``: per item found, its share in the common subsequence, cosine, answer and word."""
    docs = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"), F.array().cast(LEAKS).alias("leaks"))
    groups = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(item_col).cast("string").alias("t")).orderBy("i", "t")
    group: list[tuple] = []

    def apply(docs: DataFrame, items: list[tuple]) -> DataFrame:
        index = build(df, items, text_col, **settings)
        return docs if index is None else _search(docs, index)

    for r in groups.toLocalIterator():
        group.append((r["i"], r["t"]))
        if len(group) == GROUP:
            docs, group = apply(docs, group), []
    if group:
        docs = apply(docs, group)
    return docs.drop("__text")


def _search(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs", pa.float64()), ("cosine", pa.float64()), ("answer", pa.bool_()), ("word", pa.int64())]))
    names = docs.columns

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts, before = (part.column(len(names) - k).to_pylist() for k in (2, 1))
                found = [(b or []) + f for f, b in zip(own.leaks(texts), before, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], names)

    return docs.mapInArrow(run, docs.schema)
