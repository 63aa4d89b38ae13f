"""Near duplicates against all pairs."""

import random
import re
import string

import pytest

from wiring.llm import neardup, queries


def shingles(text, size):
    lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size):
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def run(spark, docs, size):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, label double")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size=size).collect()}


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(7)
    docs, n = [], 0
    for g in range(12):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            docs.append((n, " ".join(edited(base, rng.choice([0, 0, 1, 2, 4, 6]), rng))))
            n += 1
    chain = [f"c{k}" for k in range(200)]
    for _ in range(12):  # each is near the one before only
        docs.append((n, " ".join(chain)))
        chain = chain[8:] + [f"d{n}_{k}" for k in range(8)]
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "One two"), (n + 4, "one\ttwo"), (n + 5, "É one two three"), (n + 6, "é one two three")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("size", [4, 5])
def test_components_are_those_of_all_pairs(spark, size):
    docs = corpus()
    assert run(spark, docs, size) == brute(docs, size)


def test_estimate_follows_the_similarity():
    rng = random.Random(1)
    base = [f"w{k}" for k in range(600)]
    cut = neardup.Shingler(5)
    a, b = cut(" ".join(base)), cut(" ".join(edited(base, 20, rng)))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    same = (neardup.minima(a) & 3 == neardup.minima(b) & 3).mean()
    assert abs((same - 0.25) / 0.75 - true) < 0.12


def test_repeated_ids_are_one_document_and_rows_without_id_each_one(spark):
    rng = random.Random(3)
    a, b, c, d = ([f"{k}{i}" for i in range(150)] for k in "abcd")
    near = lambda w: " ".join(edited(w, 2, rng))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (7, ""), (None, near(a)), (None, " ".join(c)), (None, " ".join(c)), (None, near(c)),
            (None, "lonely words"), (None, None), (None, ""), (9, " ".join(d)), (9, " ".join(d)), (8, near(d)), (None, " ".join(d))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    full = sorted({(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles and r.doc_id is not None})
    assert full == [(5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (9, 8, False)]
    none = [(r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles > 1]
    assert sorted(none, key=str) == [(5, False), (8, False), (None, False), (None, False), (None, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles < 2] == [(None, True)] * 3
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 7 and not r.n_shingles] == [(7, True)]


def test_a_large_group_across_the_threshold_gives_fewer_links_than_members(spark):
    """Documents about as like each other as the threshold: thousands of hopeful pairs, few links."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, " ".join(edited(base, rng.choice([2, 3, 4, 5]), rng))) for i in range(160)]
    assert run(spark, docs, 4) == brute(docs, 4)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_near_duplicates(spark, sf).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs], 4)
