"""Document fingerprints by consistent weighted sampling.

DataFrame functions only.  A text's terms are its pairs of neighbouring words, with a mark before
the first and after the last word; a term weighs as often as it occurs.  For each of ``samples`` draws
a term gets, from its hash alone, r and c by Gamma(2, 1) and b uniform in [0, 1); with weight w it
becomes t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the term with the least ln a is
the sample (term, t).  Two texts draw the same sample with a chance equal to the generalised Jaccard
similarity of their weights, the sum of minima over the sum of maxima, so the share of equal samples
estimates it.

Of most terms the logarithms need not be taken.  With r = -ln x and c = -ln y, x and y products of two
uniforms, c >= 1 - y; and exp(-r (t - b + 1)) is at least x / w, and for w = 1, where it is x**(1 - b),
at least x / (1 - b + b x), the harmonic mean of x and 1.  A term whose bound exceeds ``_SURE`` over
the text's total weight is passed over.  The least a of a text exceeds that with a chance of
exp(-_SURE); the few texts where it does in some sample are drawn again with every term, so the
samples are just those of all terms.

A min over packed numbers (ln a in the high bits, a hash of (term, t) in the low ones) finds each
sample, so a text's rows meet in one hash aggregation buffer and no list is collected.

Defined results: a null text counts as empty; texts without words have one term, the two marks, and
so likeness 1 with each other; texts of any length are read whole; repeated rows
each stay, and the next document is the one with the next greater id; an empty table gives an empty
table; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.llm.common import discard, materialise

SAMPLES = 64
#: White space between words.
SPACE = "[ \t\n\u000b\f\r]+"
#: ln a is moved into the positive numbers and kept to 2**-24.
_SHIFT, _FINE, _LOW = 96.0, float(1 << 24), 31
#: Terms surely above this, over the total weight, are passed over at first.
_SURE = 13.0
_MOST = (1 << 63) - 1
_GROUP = 16


def term_hashes(text: Column, side: int) -> Column:
    """A hash for each pair of neighbouring words, ends marked; the lowest bit is ``side``."""
    words = F.array_remove(F.split(text, SPACE), "")
    mark = F.array(F.lit(""))

    def pair(a: Column, b: Column) -> Column:
        h = F.xxhash64(a, b)
        return h.bitwiseOR(F.lit(1).cast("long")) if side else h.bitwiseAND(F.lit(-2).cast("long"))

    return F.zip_with(F.concat(mark, words), F.concat(words, mark), pair)


def _uniform(bits: Column, shift: int) -> Column:
    """24 of the 64 bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(0.5)) * F.lit(2.0**-24)


def draw(term: Column, weight: Column, k: Column, limit: Column | None = None) -> Column:
    """Sample ``k`` of one weighted term: the packed pair of ln a and a hash of (term, t); NULL if a surely exceeds ``limit``."""
    one, two = F.xxhash64(term, k * 2), F.xxhash64(term, k * 2 + 1)
    x, y = (_uniform(bits, 0) * _uniform(bits, 24) for bits in (one, two))
    b = (F.shiftrightunsigned(one, 48) * F.lit(65536) + F.shiftrightunsigned(two, 48)) * F.lit(2.0**-32)
    r = -F.log(x)
    t = F.when(weight == 1, F.lit(0).cast("long")).otherwise(F.floor(F.log(weight) / r + b))
    # uniforms of 24 bits keep ln a above -17 - 35 - ln w, so the shift keeps it positive
    place = ((F.log(-F.log(y)) - r * (t - b + F.lit(1.0)) + F.lit(_SHIFT)) * F.lit(_FINE)).cast("long")
    mark = F.shiftrightunsigned(one, 8).bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << _LOW) - 1))
    packed = F.shiftleft(place, _LOW).bitwiseOR(mark)
    if limit is None:
        return packed
    # b counts only where the weight is 1: then the bound is x / (1 - b + b x), else x / w
    return F.when((F.lit(1.0) - y) * x <= limit * weight * F.when(weight == 1, F.lit(1.0) - b + b * x).otherwise(F.lit(1.0)), packed)


def signatures(rows: DataFrame, keys: list[str], first: str, second: str, samples: int = SAMPLES, sure: float | None = _SURE) -> DataFrame:
    """``keys``, ``first_signature``, ``second_signature`` (``array<long>``) of two texts and ``whole``, one row per key.

    ``whole`` is false where some sample did not come below ``sure`` over the texts' mean weight, so a
    term passed over may be the sample; with ``sure`` None every term is drawn and all rows are whole.

    Occurrences are counted inside each row: the hashes of both texts' terms are sorted together, the
    lowest bit telling the text, so equal ones stand together and a new one starts a run.  A term that
    occurs as often in both texts goes on as one row and is drawn once.
    """

    h, at, value, count = (F.col(c) for c in ("h", "at", "value", "count"))
    step = rows.select(*keys, F.sort_array(F.concat(term_hashes(F.col(first), 0), term_hashes(F.col(second), 1))).alias("h"))
    limit = F.lit(2.0 * (sure or 0)) / F.size(h)
    keys = [*keys, "limit"]
    step = step.select(*keys[:-1], limit.alias("limit"), "h", F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.get(h, i).eqNullSafe(F.get(h, i - 1))).alias("at"))
    ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(h)))
    step = step.select(*keys, F.transform(at, lambda i: F.get(h, i)).alias("value"), F.zip_with(ends, at, lambda e, s: e - s).alias("count"))

    def moved(c: Column, kind: str, by: int) -> Column:
        none = F.array(F.lit(None).cast(kind))
        return F.concat(F.slice(c, F.lit(2), F.size(c)), none) if by > 0 else F.concat(none, F.slice(c, F.lit(1), F.size(c) - 1))

    step = step.select(*keys, F.explode(F.arrays_zip(
        value, count, moved(value, "long", 1).alias("next_value"), moved(count, "int", 1).alias("next_count"),
        moved(value, "long", -1).alias("last_value"), moved(count, "int", -1).alias("last_count"))).alias("one"))
    second_side = F.col("one.value").bitwiseAND(F.lit(1).cast("long")) == 1

    def twin(name: str) -> Column:  # the same term, as often, in the other text
        same = F.col(f"one.{name}_value").bitwiseXOR(F.lit(1).cast("long")).eqNullSafe(F.col("one.value"))
        return same & F.col(f"one.{name}_count").eqNullSafe(F.col("one.count"))

    step = step.select(*keys, F.col("one.value").alias("value"), F.col("one.count").alias("count"), second_side.alias("second"),
                       (~second_side & twin("next")).alias("both"), (second_side & twin("last")).alias("told")).where("NOT told")
    away, here = F.lit(_MOST), F.lit(0).cast("long")
    drawn = step.select(
        *keys, F.shiftright("value", 1).alias("term"), F.col("count").cast("double").alias("weight"),
        F.when(F.col("second"), away).otherwise(here).alias("not_first"), F.when(F.col("second") | F.col("both"), here).otherwise(away).alias("not_second"))
    # the samples are dealt in groups of _GROUP: as many as generated code can hold in methods that are compiled
    groups = -(-samples // _GROUP)
    drawn = drawn.withColumn("g", F.explode(F.array(*[F.lit(_GROUP * g) for g in range(groups)])))
    values = [draw(F.col("term"), F.col("weight"), F.col("g") + j, None if sure is None else F.col("limit")) for j in range(_GROUP)]
    found = drawn.groupBy(*keys, "g").agg(
        *[F.coalesce(F.min(v.bitwiseOR(F.col("not_first"))), away).alias(f"a{j}") for j, v in enumerate(values)],
        *[F.coalesce(F.min(v.bitwiseOR(F.col("not_second"))), away).alias(f"b{j}") for j, v in enumerate(values)])
    low = F.lit((1 << 16) - 1)
    below = F.shiftleft(((F.log("limit") + F.lit(_SHIFT)) * F.lit(_FINE)).cast("long") - 4, _LOW)
    whole = F.lit(True) if sure is None else F.greatest(*[F.col(f"{c}{j}") for c in "ab" for j in range(_GROUP)]) <= below
    part = F.struct(F.col("g"), *[F.array(*[F.col(f"{c}{j}").bitwiseAND(low) for j in range(_GROUP)]).alias(c) for c in "ab"], whole.alias("whole"))
    parts = F.sort_array(F.collect_list(part))  # one for each group of samples
    found = found.groupBy(*keys).agg(parts.alias("parts"))
    return found.select(*keys[:-1], *[F.slice(F.flatten(F.col(f"parts.{c}")), 1, samples).alias(f"{name}_signature")
                                      for c, name in (("a", "first"), ("b", "second"))], F.forall("parts", lambda x: x["whole"]).alias("whole"))


def written(signature: Column) -> Column:
    """The fingerprint: four hexadecimal digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))))
    return same / float(samples)


def following(docs: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the next greater one, the least after the greatest.

    Keys are dealt by range and written, so each range is ordered by itself; only the first keys of
    the ranges, one row for each, meet in one task.
    """
    ranged = docs.select(key).distinct().repartitionByRange(key)
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first"))
    order = Window.orderBy("range")
    least = F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("range", F.coalesce(F.lead("first").over(order), least).alias("after"))
    inside = ranged.withColumn("inside", F.lead(key).over(Window.partitionBy("range").orderBy(key)))
    return inside.join(F.broadcast(after), "range").select(key, F.coalesce("inside", "after").alias("next_key"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, order: DataFrame | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row with its edited text, and the order of the ids; with ``only`` the rows of its ``key`` and ``th``.

    The last ``floor(n / share)`` code points give way to the first as many of the next document.
    The texts are dealt by id once; what is sent on is the beginning that the document before needs.
    Of rows that share an id the one with the least text hash ``th`` is the next document.
    """
    least = F.lit(-(1 << 63))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), least).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.monotonically_increasing_id().alias("row"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = following(docs, "key") if order is None else order
    own, after = docs, docs
    if only is not None:
        # written, so that their sizes are known and the texts need not be dealt again for a few keys
        order = materialise(order.join(only, "key", "left_semi"), "order")
        own = docs.join(only, ["key", "th"], "left_semi")
        after = docs.join(order.select(F.col("next_key").alias("key")), "key", "left_semi")
    sizes = own.select("key", (F.length("text") / share).cast("long").alias("need")).groupBy("key").agg(F.max("need").alias("need"))
    wanted = order.join(sizes, "key").select(F.col("key").alias("before"), F.col("next_key").alias("key"), "need")
    sent = after.join(wanted.hint("merge"), "key").select(
        F.col("before").alias("key"), F.struct(F.col("th"), F.col("row"), F.substring(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head")).alias("sent"))  # the same columns as below, so the texts are dealt once
    heads = sent.groupBy("key").agg(F.min("sent").alias("sent")).select("key", F.col("sent.head").alias("head"))
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    both = own.join(heads.hint("merge"), "key").select(
        "key", "th", "row", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut)).alias("edited"))
    return both, order


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    both, order = edited(df, id_col, text_col)
    keys = ["key", "th", "row", "n_chars", "edited_sha256"]
    prints = ["fingerprint", "edited_fingerprint"]

    def drawn(texts: DataFrame, sure: float | None) -> DataFrame:
        texts = texts.select(*keys[:4], F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
        found = signatures(texts, keys, "text", "edited", samples, sure)
        return found.select(*keys, written(F.col("first_signature")).alias(prints[0]), written(F.col("second_signature")).alias(prints[1]), "whole")

    found = materialise(drawn(both, _SURE), "fingerprints")
    again = materialise(found.where("NOT whole").select("key", "th").distinct(), "again")
    if not again.isEmpty():
        every = drawn(edited(df, id_col, text_col, order=order, only=again)[0], None)
        every = every.groupBy("key", "th").agg(*[F.min(p).alias(f"all_{p}") for p in prints])
        most = found
        found = materialise(found.join(every, ["key", "th"], "left").withColumns({p: F.when(F.col("whole"), F.col(p)).otherwise(F.col(f"all_{p}")) for p in prints}).select(*keys, *prints), "fingerprints")
        discard(most)
    discard(again)
    after = found.groupBy("key").agg(F.min_by("fingerprint", "th").alias("next_print"))
    after = order.join(after, order["next_key"] == after["key"]).select(order["key"].alias("before"), "next_print")
    done = found.join(after, found["key"] == after["before"])
    return done.select(
        F.when(F.col("key") != -(1 << 63), F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print"), samples).alias("near_next"))
