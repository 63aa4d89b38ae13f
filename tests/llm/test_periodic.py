"""Periodic runs against a search by definition."""

import hashlib
import random
import zlib

import pytest

from wiring.llm import periodic


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words):
    n, found = len(words), set()
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = smallest_period(words[s:e])
            if e - s >= max(6, 4 * q) and not (s and words[s - 1] == words[s - 1 + q]) and not (e < n and words[e] == words[e - q]):
                found.add((s, e - s, q))
    return sorted(found)


def test_equals_the_definition():
    random.seed(4)
    for trial in range(300):
        words = random.choices("ab" if trial % 2 else "abc", k=random.randint(0, 34))
        if trial % 3 == 0:
            unit = random.choices("abcd", k=random.randint(1, 5))
            words = words[:5] + unit * random.randint(2, 6) + unit[:1] + words[5:12]
        found = periodic.runs(words)
        assert found == brute(words), words
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert periodic.collapsed(words, found) == [w for i, w in enumerate(words) if i not in gone]


def by_lag(words):
    """Every lag on its own, word by word."""
    found = {}
    for lag in range(1, len(words) // 4 + 1):
        start = 0
        for i in range(len(words) - lag + 1):
            if i == len(words) - lag or words[i] != words[i + lag]:
                if i - start + lag >= max(6, 4 * lag) and i > start:
                    found.setdefault((start, i - start + lag), lag)
                start = i + 1
    return sorted((s, length, lag) for (s, length), lag in found.items())


@pytest.mark.parametrize("long", [0, 10**9])
def test_long_texts_and_every_lag(monkeypatch, long):
    monkeypatch.setattr(periodic, "_LONG", long)  # offsets asked first for all texts, and for none
    random.seed(5)
    for n in (200, 1500):
        words = random.choices([f"w{k}" for k in range(40)], k=n)
        for _ in range(4):
            p, at = random.randint(1, n // 12), random.randint(0, n // 2)
            length = min(n - at, p * 5 + random.randint(0, p))
            words[at : at + length] = [words[at + k % p] for k in range(length)]
        assert periodic.runs(words) == by_lag(words)
    assert periodic.runs(["x"] * 5000) == [(0, 5000, 1)]
    assert periodic.runs(["x"] * 5) == [] and periodic.runs([]) == []


def test_a_very_long_text_is_quick():
    import time

    random.seed(6)
    words = random.choices([f"w{k}" for k in range(5000)], k=200_000)
    words[1000:41_000] = [words[1000 + k % 9000] for k in range(40_000)]
    began = time.time()
    assert (1000, 40_000, 9000) in [(s, length, q) for s, length, q in periodic.runs(words)]
    assert time.time() - began < 60


def naive(i, text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    found = by_lag(words)
    best = min(((-length, s, q) for s, length, q in found), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (i, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
    return (*head, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_rows_of_the_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \t\r\n"), (-4, "a " * 9), (-5, "x y z " * 5), (-6, "x\x0by\x1cz " * 5), (-4, "a " * 9)]
    rows += [(i, "one two three four five six seven eight nine ten " * 3) for i in range(1000, 1060)]
    df = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, key string, runs string").repartition(4)
    got = periodic.summary(periodic.find(df, change=periodic.planted)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((naive(i, t) for i, t in rows), key=str)


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b " * 5), (None, None)], "doc_id long, text string")
    got = sorted((r.collapsed, len(r.runs)) for r in periodic.find(df, change=periodic.planted).collect())
    assert got == [("", 0), ("a b", 1)]
    assert periodic.summary(periodic.find(df.limit(0))).count() == 0
