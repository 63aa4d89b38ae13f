"""Fingerprints against brute-force generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

import numpy as np

from wiring.llm import cws, queries


def similarity(a, b):
    def bag(text):
        w = [x for x in re.split("[ \t\n\x0b\f\r]+", text) if x]
        return Counter(zip(["", *w], [*w, ""], strict=True))

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op6_weighted_sampling(spark, sf).collect()}
    assert len(got) == len(docs)
    edited_off, next_off = [], []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        other = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        edited_off.append(r.near_edited - similarity(text, other))
        next_off.append(r.near_next - similarity(text, after))
    for off in (edited_off, next_off):
        assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.32 and np.std(off) < 0.09


def test_equal_texts_repeated_rows_and_odd_rows(spark):
    words = " ".join(f"w{k % 37}" for k in range(300))
    rows = [(5, words), (5, words), (9, words), (1, None), (2, ""), (3, " \n "), (None, "a b"), (7, "é💡 x" * 50)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = cws.fingerprints(df).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[5] == prints[9] and len(prints[5]) == 1 and prints[1] == prints[2] == prints[3] != prints[5]
    assert {r.doc_id: r.n_chars for r in got}[7] == 200
    assert next(r for r in got if r.doc_id == 1).near_next == 1.0
    assert cws.fingerprints(df.limit(0)).count() == 0
    alone = cws.fingerprints(df.where("doc_id = 9")).first()
    assert alone.near_next == 1.0


def test_terms_passed_over_change_nothing(spark, monkeypatch):
    """With a bound that many samples miss, the texts concerned are drawn again with every term."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).unionByName(
        spark.createDataFrame([(-7, "a a a b", "x", "y", 7), (-7, "a b " * 300, "x", "y", 7)], "doc_id long, text string, lang string, source string, n_chars long"))

    def prints(sure):
        monkeypatch.setattr(cws, "_SURE", sure)
        return sorted(cws.fingerprints(docs).select("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_next").collect())

    assert prints(0.7) == prints(60.0)
