"""Decontamination: exact leaks against brute force, paraphrases, answers and clean texts."""

import itertools
import random

import pytest

from wiring.llm import decontam


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_bit_parallel_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 40)) for _ in "ab")
        assert decontam.common_subsequence(decontam.masks_of(a), len(a), b) == brute_lcs(a, b)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(900)]
    common = ["the", "of", "and", "to"]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(prose(rng.randint(16, 60)))) for k in range(20)]
    items += [(20, "Question " + " ".join(prose(30)) + " Answer: v1 v2 v3"), (21, None), (22, ""), (23, " ".join(prose(150))), (24, "v5 v6 v7")]
    docs = [(k, " ".join(prose(rng.choice([5, 40, 400, 3000])))) for k in range(150)]
    planted = set()
    for k in range(0, 60, 2):
        item = items[rng.randrange(20)]
        at = docs[k][1].split(" ")
        place = rng.randint(0, len(at))
        docs[k] = (k, " ".join(at[:place] + [item[1]] + at[place:]))
        planted.add((k, item[0]))
    return items, docs, planted


def run(spark, items, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, x.item_id): x for r in decontam.screen(df, bench, fit_passages=500).collect() for x in r.leaks}


def test_every_exact_leak_is_found_and_nothing_else(spark, world):
    items, docs, planted = world
    got = set(run(spark, items, docs))
    exact = {(i, k) for (i, t), (k, x) in itertools.product(docs, items) if x and x in t}
    assert planted | exact <= got
    assert {p for p in got - exact - planted if p[1] != 23} == set()


def test_paraphrases_long_items_answers_and_odd_rows(spark, world):
    items, docs, _ = world
    clean = [w for w in docs[101][1].split(" ")]
    base = items[3][1].split(" ")
    paraphrase = [w if k % 6 else f"other{k}" for k, w in enumerate(base)]
    long = items[23][1].split(" ")
    more = [(1000, " ".join(clean[:30] + paraphrase + clean[30:])), (1001, " ".join(clean + long[20:140])), (1002, None), (1003, ""),
            (1004, items[20][1]), (1005, items[5][1].upper().replace(" ", "\n"))]
    got = run(spark, items, docs[60:] + more)
    assert {(1000, 3), (1001, 23), (1004, 20), (1005, 5)} <= set(got)
    assert got[1004, 20].answer and not any(i in (1002, 1003) for i, _ in got)


def test_exact_copies_of_short_items_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(2, 18)))) for k in range(120)]
    docs, planted = [], set()
    for k, (item, text) in enumerate(items):
        at = rng.choices(vocabulary, k=rng.choice([60, 300]))
        place = rng.randint(0, len(at))
        docs.append((k, " ".join(at[:place] + [text] + at[place:])))
        planted.add((k, item))
    got = run(spark, items, docs)
    exact = {(i, k) for (i, t), (k, x) in itertools.product(docs, items) if f" {x} " in f" {t} "}
    assert planted <= exact <= set(got)
    assert all(got[p].lcs == 1 for p in exact)


def test_paraphrases_are_found_and_little_else(spark):
    """240 items with words changed, moved or inserted, each put into a document of its own, beside 240 documents without any."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(1500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for k in range(240)]

    def changed(w):
        for i in rng.sample(range(len(w)), max(1, len(w) * 15 // 100)):
            w[i] = f"new{rng.randrange(10**6)}"
        return w

    def moved(w):
        n = max(1, len(w) // 8)
        i = rng.randrange(len(w) - n)
        cut, rest = w[i : i + n], w[:i] + w[i + n :]
        j = rng.randint(0, len(rest))
        return rest[:j] + cut + rest[j:]

    def inserted(w):
        for _ in range(max(1, len(w) * 15 // 100)):
            w.insert(rng.randint(0, len(w)), f"more{rng.randrange(10**6)}")
        return w

    docs, planted = [], {}
    for k, (item, text) in enumerate(items):
        prose = rng.choices(vocabulary, k=rng.choice([40, 200, 1500]))
        kind = (changed, moved, inserted)[k % 3]
        at = rng.randint(0, len(prose))
        docs += [(2 * k, " ".join(prose[:at] + kind(text.split(" ")) + prose[at:])), (2 * k + 1, " ".join(rng.choices(vocabulary, k=rng.choice([40, 200, 1500]))))]
        planted[2 * k, item] = kind.__name__
    got = set(run(spark, items, docs))
    for kind in ("changed", "moved", "inserted"):
        own = {p for p, name in planted.items() if name == kind}
        assert len(own & got) >= 0.9 * len(own), (kind, len(own & got), len(own))
    assert len(got & set(planted)) >= 0.9 * len(got)


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(400)]
    item = " ".join(rng.choices(vocabulary, k=30))
    long = rng.choices(vocabulary, k=300_000)
    docs = [(1, item), (1, item), (2, " ".join([*long, item])), (None, item), (3, "x" * 1_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "v1")], "item_id long, text string")
    rows = sorted((r.doc_id or 0, [(x.item_id, x.lcs) for x in r.leaks if x.item_id == 7]) for r in decontam.screen(df, bench, fit_passages=500).collect())
    assert [(i, bool(leaks)) for i, leaks in rows] == [(0, True), (1, True), (1, True), (2, True), (3, False)]


def test_the_whole_answer_is_sought_where_the_whole_item_would_stand(spark):
    rng = random.Random(7)
    body, answer = [f"q{k}" for k in range(100)], [f"a{k}" for k in range(24)]
    items = [(1, " ".join([*body, "Answer:", *answer]))]
    # 70% of the first of two parts; of the second, little but the answer
    kept = [w if k % 10 < 7 else f"other{k}" for k, w in enumerate(body[:63])] + [f"new{k}" for k in range(38)]
    clean = [f"c{rng.randrange(500)}" for _ in range(200)]
    docs = [(1, " ".join(clean[:64] + kept + answer + clean[64:])), (2, " ".join(clean[:64] + kept + clean[64:])),
            (3, " ".join(clean[:64] + kept + clean[64:] + clean + answer)), (4, " ".join(clean[:64] + kept + answer[:16] + clean[64:]))]
    got = run(spark, items, docs)
    assert set(got) == {(1, 1)} and got[1, 1].answer


def test_empty_sides(spark, world):
    items, docs, _ = world
    assert run(spark, [(1, None)], docs[:3]) == {}
    assert run(spark, items[:3], []) == {}
