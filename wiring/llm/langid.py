"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over character n-grams
(naive Bayes log ratios, each language counting alike) says which side a text is on.  Decoding
weighs each bit by how well its classifier did on the sample, adds up the logistic loss of every
codeword and chooses the nearest; a text whose second-nearest codeword is about as near is flagged.

Learning takes a bounded sample, about ``per_language`` documents of each language
present, chosen by a hash of the id.  Prediction sees the whole text and nothing else.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if
there is nothing to learn from; a single language is always predicted; rows are kept one to one,
repeated ones too; an empty table gives an empty table; of other columns only those named in
``keep`` are carried along, so clashing names do no harm.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: Odd multipliers that spread the n-grams of one to three letters over the table.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages.

    Up to seven languages: every way to part them in two.  More: of 200 seeded random codes the one
    whose nearest two rows are furthest apart.  ``bits`` grow with the logarithm of ``n``, 63 at least.
    """
    bits = bits or max(63, math.ceil(10.5 * math.log2(max(n, 2))))
    if n <= 7:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and min(c) == -1]
        return np.array(columns, np.float64).T.reshape(n, -1)
    best, apart = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        differ = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if differ.min() > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, differ.min()
    return best


def grams(text: str, log2: int) -> np.ndarray:
    """Hashes of the n-grams of one to three letters; every run of other characters is one blank."""
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32)
    one = points * _MIX[0]
    two = one[:-1] + points[1:] * _MIX[1]
    three = two[:-1] + points[2:] * _MIX[2]
    mixed = np.concatenate([one[1:-1], two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - log2)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, their codewords, and a column of n-gram log ratios for each bit."""

    languages: list[str]
    log2: int = 15
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    #: N-grams of three lengths overlap, so their log ratios count for about a third each.
    SCALE, LIMIT = 1 / 3, 30.0
    #: Least mean loss, in nats a bit, between the two nearest codewords; below it a text is ambiguous.
    CLEAR = 0.15

    def margins(self, text: str) -> np.ndarray:
        counts = np.bincount(grams(text, self.log2), minlength=1 << self.log2).astype(np.float32)
        return np.clip(counts @ self.ratios * self.SCALE, -self.LIMIT, self.LIMIT)

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """The nearest codeword, its share of the likelihood, and whether another is about as near."""
        loss = np.logaddexp(0, -self.code * margins) @ self.weights
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        clear = len(order) < 2 or loss[order[1]] - loss[order[0]] >= self.CLEAR * self.weights.sum()
        return int(order[0]), float(1 / share.sum()), not clear

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        k, score, ambiguous = self.decode(self.margins(text))
        return self.languages[k], score, ambiguous


def learn(samples: list[tuple[str, str]], log2: int = 15, smooth: float = 0.5) -> Model:
    """The model of (language, text) pairs."""
    samples = sorted((lang, text) for lang, text in samples if has_letter(text))
    languages = sorted({lang for lang, _ in samples})
    model = Model(languages, log2)
    if len(languages) < 2:
        return model
    counts = np.zeros((len(languages), 1 << log2))
    for lang, text in samples:
        found = np.bincount(grams(text, log2), minlength=1 << log2)
        counts[languages.index(lang)] += np.sqrt(found)  # a text that repeats itself says little more
    share = counts + smooth
    share /= share.sum(1, keepdims=True)
    code = codewords(len(languages))
    sides = [(share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])]
    model.code = code
    model.ratios = np.stack([np.log(a / b) for a, b in sides], 1).astype(np.float32)
    hits = np.zeros(code.shape[1])
    for lang, text in samples:
        hits += np.sign(model.margins(text)) == code[languages.index(lang)]
    error = (len(samples) - hits + 1) / (len(samples) + 2)
    model.weights = np.clip(np.log((1 - error) / error), 0.05, 5.0)
    model.weights /= model.weights.mean()
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> Model:
    """Learn every language present from a sample of its rows whose id is not held out.

    The sample has about ``per_language`` different rows of each language, by a hash of id and text, whatever the
    number of rows, of one id or of equal ones: a bound on what the driver reads.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return learn([])
    # the share of a language's rows that gives about per_language
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts}
    wanted = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    found = rows.select("id", "lang", "text", place.alias("place")).where(F.col("place") < F.coalesce(F.try_element_at(wanted, F.col("lang")), F.lit(0.0)) * float(1 << 30))
    return learn([(r["lang"], r["text"]) for r in found.dropDuplicates(["lang", "id", "place"]).select("lang", "text").toLocalIterator()])


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``lang_pred``, ``score`` and ``ambiguous`` of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size hangs on log2 and the bits, not on the data
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    names = schema.fieldNames()

    def run(batches):
        own = sent.value
        for batch in batches:
            told = [own.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([x[k] for x in told], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    return source.mapInArrow(run, schema)
