"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only.  A pattern puts marks around its matches; the pieces between the marks
give every match and, by their lengths, its place in code points.  Patterns are written so that a
match attempt never reads a run of characters twice.

Base kinds (``email``, ``ip``, ``card``, ``phone``) stay whatever their score; further kinds
(``iban`` with mod 97, ``ssn``, ``key``) are added where their score reaches ``least``.

Defined results: a null text counts as empty and has no spans; texts of any length are read whole;
rows are kept one to one, repeated ones too; an empty table gives an empty table; of other columns
only those named in ``keep`` are carried along, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _PLAIN = "\u0001", "\u0002", "�"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.coalesce((F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0), F.lit(False))


def mod97(match: Column) -> Column:
    """Whether a string of capitals and digits has remainder 1 after its first four characters go to the end."""
    bare = F.regexp_replace(match, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.coalesce((F.length(moved) > 4) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), add) == 1), F.lit(False))


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, "[.]"), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(part, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _card(match: Column) -> Column:
    return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def _ssn(match: Column) -> Column:
    area = F.substring(match, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")


@dataclass(frozen=True)
class Kind:
    """A pattern, its validator, the score a valid match starts with and words that speak for it."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    words: str
    base: bool = False


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?=\.{_LABEL})(?:(?!\.(?!{_LABEL}))[A-Za-z0-9.-])++", None, 0.9, "mail|contact|write|contacto|correo|courriel|kontakt", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, 0.7, r"\bip\b|address|host|server|dirección|adresse", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", _card, 0.8, "card|visa|credit|debit|tarjeta|carte|karte", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.7, r"phone|call|\btel\b|mobile|fax|teléfono|téléphone|telefon", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.8, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, 0.4, r"\bssn\b|social|security|tax"),
    Kind("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", None, 0.9, "key|secret|token|access"),
)

SPAN = "array<struct<start:int,end:int,match:string>>"


_CHUNK = 256  # matches that are put in order at once


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: start and end in code points, end exclusive, and the string.

    Matches are placed in chunks and the chunks are placed in turn, so no array grows by one element
    at a time and the work stays near the number of matches.
    """
    plain = F.translate(text, _OPEN + _CLOSE, _PLAIN * 2)
    pieces = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def chunk(k: Column) -> Column:  # from 0 on, and how far its pieces reach
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

        def add(held: Column, piece: Column) -> Column:
            match = F.substring_index(piece, _CLOSE, 1)
            one = F.struct(held["at"].alias("start"), (held["at"] + F.length(match)).alias("end"), match.alias("match"))
            return F.struct((held["at"] + F.length(piece) - 1).alias("at"), F.concat(held["found"], F.array(one)).alias("found"))

        return F.aggregate(F.slice(pieces, k * _CHUNK + 2, F.lit(_CHUNK)), start, add)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / _CHUNK).cast("int")), chunk)
    first = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def join(held: Column, part: Column) -> Column:
        moved = F.transform(part["found"], lambda m: F.struct((m["start"] + held["at"]).alias("start"), (m["end"] + held["at"]).alias("end"), m["match"].alias("match")))
        return F.struct((held["at"] + part["at"]).alias("at"), F.concat(held["found"], F.array(moved)).alias("found"))

    return F.when(F.size(pieces) > 1, F.flatten(F.aggregate(chunks, first, join)["found"])).otherwise(F.array().cast(SPAN))


_BLOCK = 4096  # code points of a block of text


def blocks_of(text: Column) -> Column:
    """The text in blocks, so that what stands at a place is found without counting from the beginning."""
    return F.when(F.length(text) <= _BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))


def stretch(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` code points, at most a block's, from ``start`` on, counted from 0."""
    k = F.floor(start / _BLOCK).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit(""))), start - k * _BLOCK + 1, length)


def find(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), near: int = 40, least: float = 0.5) -> DataFrame:
    """The columns in ``keep`` and ``spans``: an array of kind, start, end, match, score and base, by kind, then start.

    A valid match starts with the score of its kind; a word that speaks for the kind within ``near``
    characters adds 0.2, its lack in a kind below 0.5 takes 0.1.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    rows = rows.select(*keep, *[_proposed(text, kind).alias(f"__{kind.name}") for kind in KINDS], blocks_of(text).alias("__blocks"))
    blocks = F.col("__blocks")

    def judged(kind: Kind) -> Column:
        def one(m: Column) -> Column:
            around = F.lower(F.concat_ws(" ", stretch(blocks, F.greatest(m["start"] - near, F.lit(0)), F.least(m["start"], F.lit(near))), stretch(blocks, m["end"], F.lit(near))))
            score = F.lit(kind.score) + F.when(around.rlike(kind.words), 0.2).otherwise(-0.1 if kind.score < 0.5 else 0.0)
            return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"),
                            F.least(F.round(score, 3), F.lit(1.0)).alias("score"), F.lit(kind.base).alias("base"))

        found = F.transform(F.col(f"__{kind.name}"), one)
        return found if kind.base else F.filter(found, lambda s: s["score"] >= least)

    return rows.select(*keep, F.concat(*[judged(kind) for kind in KINDS]).alias("spans"))


def _proposed(text: Column, kind: Kind) -> Column:
    found = matches(text, kind.pattern)
    found = F.filter(found, lambda m: kind.valid(m["match"])) if kind.valid else found
    sign = {"email": "@", "phone": "+", "key": "AKIA"}.get(kind.name)
    return F.when(F.instr(text, sign) > 0, found).otherwise(F.array().cast(SPAN)) if sign else found


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> Column:
    """The text with each span of the array replaced by ``[KIND]``; of spans that overlap the first counts.

    Every block of the text is read once and keeps what no span covers; a span's sign stands in the block where it begins.
    """
    spans = F.array_sort(F.transform(df[spans_col], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ends = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("kept"))

    def choose(held: Column, s: Column) -> Column:
        one = F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))
        return F.when(s["start"] < held["at"], held).otherwise(F.struct(s["end"].cast("int").alias("at"), F.concat(held["kept"], F.array(one)).alias("kept")))

    chosen = F.aggregate(spans, ends, choose)["kept"]

    def block(text: Column, k: Column) -> Column:
        low = k * _BLOCK
        own = F.filter(chosen, lambda s: (s["end"] > low) & (s["start"] < low + _BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def add(held: Column, s: Column) -> Column:
            sign = F.when(s["start"] >= low, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
            said = F.concat(held["out"], F.substring(text, held["at"] + 1, F.greatest(s["start"] - low - held["at"], F.lit(0))), sign)
            return F.struct(F.least(s["end"] - low, F.lit(_BLOCK)).alias("at"), said.alias("out"))

        done = F.aggregate(own, start, add)
        return F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(_BLOCK)))

    return F.array_join(F.transform(blocks_of(F.coalesce(df[text_col], F.lit(""))), block), "")
