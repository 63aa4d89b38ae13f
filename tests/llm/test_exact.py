"""The cuckoo-filter index and the dedup that rests on it."""

import hashlib
import random

from wiring.llm import exact


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_behaves_like_a_dictionary_while_it_grows():
    random.seed(1)
    index, want = exact.CuckooIndex(1), {}
    for step in range(20_000):
        k = key(random.randrange(4000))
        if random.random() < 0.3:
            assert index.delete(k) == (want.pop(k, None) is not None)
        else:
            had = want.get(k, (-1, 0))
            want[k] = (max(had[0], step), had[1] + 1)
            index.insert(k, step)
        assert index.live == len(want)
    assert {k: (i, n) for k, i, n in index.entries()} == want
    assert all(index.get(k) == v for k, v in want.items())
    assert not any(index.get(key(i)) for i in range(4000, 9000))


def test_marks_that_collide_are_told_apart_by_content_and_overflow_resizes():
    # equal first bytes: one bucket pair and one mark for all, until the filter has grown
    same = [i.to_bytes(8, "little") + b"\7\7" + bytes(22) for i in range(0, 64 * 16, 64)]
    index = exact.CuckooIndex(16)
    for n, k in enumerate(same):
        index.insert(k, n)
    assert index.buckets > 16
    assert [index.get(k) for k in same] == [(n, 1) for n in range(len(same))]
    twin = same[0][:10] + b"\1" * 22
    assert index.get(twin) is None and not index.delete(twin)
    assert index.delete(same[0]) and index.get(same[0]) is None and index.get(same[1]) == (1, 1)


def test_index_without_any_id():
    index = exact.CuckooIndex()
    index.insert(key(1), None)
    index.insert(key(1), None)
    assert index.get(key(1)) == (None, 2)
    index.insert(key(1), -5)
    assert index.get(key(1)) == (-5, 3)


def brute(rows):
    groups = {}
    for i, t in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(text, []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in df.collect()), key=str)


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "_LOCAL", 7)  # tasks pass their keys on again and again
    random.seed(2)
    rows = [(i, random.choice(["a", "A", "B b", "b B", "É", "é", "ÀZ", "àz", "", None, " ", "🙂K", "🙂k", "k" * 5])) for i in range(200)]
    rows += [(None, "a"), (None, "only"), (None, "ONLY"), (7, "seven"), (7, "seven"), (7, "other"), (-1, "x" * 300_000), (-2, "X" * 300_000)]
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    assert result(exact.exact_duplicates(df)) == brute(rows)
    left = exact.dedup(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for (i, t) in rows if (i, t) in {
        (r[0], x) for r in brute(rows) if r[3] for x in {y for j, y in rows if j == r[0] and hashlib.sha256("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in y or "").encode()).hexdigest() == r[4]}}), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(df).count() == 0 and exact.dedup(df).count() == 0


def test_a_kept_index_takes_insertions_and_deletions(spark):
    def frame(rows):
        return exact.keyed(spark.createDataFrame(rows, "doc_id long, text string"))

    index = exact.update(exact.empty(spark), insert=frame([(1, "a"), (2, "A"), (3, "b"), (4, "c")]), shards=3)
    index = exact.update(index, insert=frame([(9, "b"), (5, "d")]), delete=frame([(0, "a"), (0, "nowhere")]), shards=3)
    live = {r.digest.hex(): (r.id, r.n) for r in index.collect()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "abcd"}
    assert live == {sha["b"]: (9, 2), sha["c"]: (4, 1), sha["d"]: (5, 1)}
    hits = exact.lookup(index, frame([(70, "a"), (71, "B"), (72, "b"), (73, "d"), (74, "z")]), shards=3).collect()
    assert sorted((r.digest.hex(), r.id, r.n) for r in hits) == sorted([(sha["b"], 9, 2), (sha["d"], 5, 1)])
    # deletions come before insertions: a text taken out and brought again is new
    again = exact.update(index, insert=frame([(1, "b")]), delete=frame([(0, "b")]), shards=3)
    assert {r.digest.hex(): (r.id, r.n) for r in again.collect()}[sha["b"]] == (1, 1)
