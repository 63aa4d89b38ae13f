"""Line dedup by winnowing over line hashes: runs of lines that stand earlier in the corpus go.

DataFrame functions only.  A window is a least run of lines that are not blank with ``min_words`` words: one begins
at every line, one ends at every line, a line of ``min_words`` words is a window by itself, and two such lines in
turn are one.  Any run of ``min_words`` words is covered by the windows inside it.

1. Winnowing.  Each two neighbouring lines have a fingerprint, the hash of both; a window selects the least one
   in it, the first of equal ones (a window of one line selects that line's hash).  The choice hangs on the window's
   lines alone, so two copies of a window always select the same fingerprint at the same line: no repeated run is
   missed.  Neighbouring windows mostly select the same place, so few places are kept.
2. Selected places are joined by fingerprint; those whose fingerprint stands at one place only go.
3. A match is extended both ways from its place: of the windows that selected it, from the one that ends there to
   the one that begins there, each is held against all earlier ones by the 128-bit hash of its lines in
   turn.  The lines from first to last of every window that is not the first place of its content, by (id, text
   hash, line), are the repeated runs; later ones go.

So a line goes only where an equal one stands earlier (but for collisions of 128 bits), and the first of its kind
always stays.  No key's rows are collected, and the joins on fingerprints and contents are left to be split where
one has many rows.  Lines are hashed once; their hashes, the selected places and the windows with a shared
fingerprint are written, and deleted when the runs are known.

Defined results: a null text stays null and has no lines; blank lines never make a run and go only
inside one; rows that repeat id and text count as one document and share its fate; lines compare
without white space at their ends; texts of any length are read whole; an empty table gives an empty
table; of other columns only those named in ``keep`` are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.llm.common import discard, materialise

MIN_WORDS = 50
_DOC = ["id", "th"]


def _keys(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(df[text_col]).alias("th")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used and in whatever loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Of each document's lines that are not blank the places, words (``min_words`` at most) and two hashes."""

    def one(line: Column, pos: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
        words = F.least(F.size(F.split(bare, r"\s+")), F.lit(min_words))
        return F.when(bare != "", F.struct(pos.alias("pos"), words.alias("words"), F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g")))

    found = df.where(df[text_col].isNotNull()).select(*_keys(df, id_col, text_col), F.array_compact(F.transform(F.split(df[text_col], "\n"), one)).alias("lines"))
    return found.select(*_DOC, "lines.pos", "lines.words", "lines.h", "lines.g")


def _windows(min_words: int) -> Column:
    """The windows of a row of ``line_hashes``: ``first`` and ``last`` line, the line ``at`` which it selects its fingerprint ``fp``."""

    def build(owner: Column) -> Column:  # the line of each word
        start = F.filter(F.transform(owner, lambda line, k: F.when((k == 0) | (F.get(owner, k - 1) != line), k)), lambda k: k.isNotNull())
        return _with(F.struct(owner.alias("owner"), start.alias("start"), pairs.alias("pairs")), each)

    pairs = F.transform("h", lambda h, k: F.xxhash64(h, F.get("h", k + 1)))

    def each(s: Column) -> Column:
        def ends(first: Column) -> Column:
            return F.get(s["owner"], F.get(s["start"], first) + min_words - 1)

        def begins(last: Column) -> Column:
            return F.get(s["owner"], F.coalesce(F.get(s["start"], last + 1), F.size(s["owner"])) - min_words)

        def window(first: Column, last: Column) -> Column:
            inside = F.slice(s["pairs"], first + 1, last - first)
            several = F.struct(first.alias("first"), last.alias("last"), (first + F.array_position(inside, F.array_min(inside)).cast("int") - 1).alias("at"), F.array_min(inside).alias("fp"))
            single = F.struct(first.alias("first"), last.alias("last"), first.alias("at"), F.get("h", first).alias("fp"))
            return F.when(last > first, several).when(last == first, single)

        lines = F.sequence(F.lit(0), F.size("words") - 1)
        ahead = F.transform(lines, lambda k: window(k, ends(k)))
        behind = F.transform(lines, lambda k: F.when(ends(begins(k)) != k, window(begins(k), k)))
        # blank lines between two long ones go with both
        both = F.transform(lines, lambda k: F.when((F.get("words", k) >= min_words) & (F.get("words", k + 1) >= min_words), window(k, k + 1)))
        return F.array_compact(F.concat(ahead, behind, both))

    owner = F.flatten(F.transform("words", lambda n, k: F.array_repeat(k, n)))
    return _with(owner, build)


def selected(hashes: DataFrame, min_words: int) -> DataFrame:
    """``id, th, at, fp``: the places that the windows of each document select; a place may come twice."""

    def fresh(windows: Column) -> Column:
        return F.filter(windows, lambda w, k: (k == 0) | (F.get(windows, k - 1)["at"] != w["at"]) | (F.get(windows, k - 1)["fp"] != w["fp"]))

    return hashes.select(*_DOC, F.explode(_with(_windows(min_words), fresh)).alias("w")).select(*_DOC, "w.at", "w.fp")


def shared_windows(hashes: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """``id, th, first, last`` and content key ``k1, k2`` of the windows whose fingerprint stands at several places."""
    place = F.xxhash64(*_DOC, "at")
    several = places.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp")
    marked = places.join(several.hint("merge"), "fp").groupBy(*_DOC).agg(F.sort_array(F.collect_set("at")).alias("marks"))
    # a flag for each line, by filling the gaps between the marks
    mark = F.col("marks")
    flags = F.flatten(F.transform(mark, lambda at, k: F.concat(F.array_repeat(F.lit(False), at - F.coalesce(F.get(mark, k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    near = _with(flags, lambda flag: F.filter(_windows(min_words), lambda w: F.coalesce(F.get(flag, w["at"]), F.lit(False))))

    def content(w: Column) -> Column:
        size = w["last"] - w["first"] + 1
        return F.struct(F.get("pos", w["first"]).alias("first"), F.get("pos", w["last"]).alias("last"),
                        F.xxhash64(F.slice("h", w["first"] + 1, size)).alias("k1"), F.xxhash64(F.slice("g", w["first"] + 1, size)).alias("k2"))

    rows = hashes.join(marked.hint("merge"), _DOC)
    return rows.select(*_DOC, F.explode(F.transform(near, content)).alias("w")).select(*_DOC, "w.*")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, th, first, last`` (line numbers from 0) and ``src_id`` of every window that stands earlier too."""
    hashes = materialise(line_hashes(df, id_col, text_col, min_words), "line-hashes")
    places = materialise(selected(hashes, min_words), "places")
    windows = materialise(shared_windows(hashes, places, min_words), "windows")
    discard(hashes)
    discard(places)
    key = ["k1", "k2"]
    first = windows.groupBy(*key).agg(F.min(F.struct("id", "th", "first")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "src")
    first = materialise(first, "first-places")  # a table of its own, so that the join deals a hot content among tasks
    again = windows.join(first.hint("merge"), key).where(F.struct("id", "th", "first") != F.col("src"))
    runs = materialise(again.select(*_DOC, "first", "last", F.col("src.id").alias("src_id")).distinct(), "runs")
    discard(windows)
    discard(first)
    return runs


def _stretches(runs: DataFrame) -> DataFrame:
    """``runs`` of each document, those that touch made one."""
    order = Window.partitionBy(*_DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > F.col("reach") + 1, F.lit(True)).cast("int")
    dealt = runs.withColumn("reach", reach).withColumn("stretch", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = dealt.groupBy(*_DOC, "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return each.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          min_words: int = MIN_WORDS) -> DataFrame:
    """The columns in ``keep``, ``text`` without repeated runs, ``n_lines`` and ``n_removed``."""
    runs = _stretches(repeated_runs(df, id_col, text_col, min_words))
    docs = df.select(*_keys(df, id_col, text_col), df[text_col].cast("string").alias("__text"), *[df[c].alias(f"__keep_{c}") for c in keep])
    both = docs.join(runs.hint("merge"), _DOC, "left").withColumn("__lines", F.split("__text", "\n"))
    lines = F.col("__lines")

    def before(run: Column, i: Column) -> Column:  # the lines between a run and the one before
        begin = F.coalesce(F.get(F.col("runs"), i - 1)["last"], F.lit(-1)) + 1
        return F.slice(lines, begin + 1, run["first"] - begin)

    end = F.element_at("runs", -1)["last"] + 1
    kept = F.concat(F.flatten(F.transform("runs", before)), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))
    text = F.when(F.col("runs").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
    done = both.select(*[F.col(f"__keep_{c}").alias(c) for c in keep if c != text_col], text.alias("text"),
                       F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                       F.when(F.col("runs").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_removed"))
    return done
