"""Line dedup against a brute-force search for repeated runs."""

import random

from wiring.llm import lines

T = 6


def brute(docs, least=T):
    """Lines of (id, text) pairs deleted: those in a run of equal lines of ``least`` words that stands earlier."""
    table = []
    for i, text in sorted(docs):
        rows = [(p, x.strip()) for p, x in enumerate(text.split("\n")) if x.strip()]
        table.append((i, rows))
    gone = {i: set() for i, _ in docs}
    for a, (i, mine) in enumerate(table):
        for b in range(a + 1):
            theirs = table[b][1]
            for s in range(len(mine)):
                for t in range(len(theirs)):
                    if a == b and t >= s:
                        continue
                    k = 0
                    while s + k < len(mine) and t + k < len(theirs) and mine[s + k][1] == theirs[t + k][1]:
                        k += 1
                    if sum(len(x.split()) for _, x in mine[s : s + k]) >= least:
                        gone[i] |= set(range(mine[s][0], mine[s + k - 1][0] + 1))
    return {i: "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[i]) for i, text in docs}


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "src") for i, t in docs], "doc_id long, text string, h string")
    return {r.doc_id: r.text for r in lines.dedup(df, min_words=T).collect()}


def test_repeated_runs_go_and_first_places_stay(spark):
    random.seed(3)
    pool = [" ".join(random.choices("abcdefgh", k=random.randint(1, 4))) for _ in range(12)] + ["", "a b c d e f g"]
    for _ in range(3):
        docs = [(i, "\n".join(random.choices(pool, k=random.randint(0, 12)))) for i in range(14)]
        got, want = run(spark, docs), brute(docs)
        everything = {x.strip() for _, t in docs for x in t.split("\n")}
        assert {x.strip() for t in got.values() for x in t.split("\n")} | {""} == everything | {""}
        for i, text in docs:
            # every line that goes is in a repeated run
            assert len(got[i]) >= len(want[i]), (i, text, got[i], want[i])
        distinct = [(i, f"{i} start {i}\n" + "one two three\nfour five six seven\n" + f"{i} end") for i in range(5)]
        assert run(spark, distinct) == brute(distinct)


def test_runs_with_common_lines_inside_are_found(spark):
    """Each line of a repeated passage also stands alone in earlier documents of its own."""
    passage = ["a b", "c d", "e f", "g h"]
    docs = [(4 * k + n, f"only {k} {n}\n{line}\nalone {k} {n}") for n, line in enumerate(passage) for k in range(12)]
    docs += [(k, "\n".join([f"top {k}", *passage, f"tail {k}"])) for k in (100, 101, 102)]
    got = run(spark, docs)
    assert got == brute(docs)
    assert got[101] == "top 101\ntail 101"


def test_equals_brute_force(spark):
    random.seed(8)
    pool = [" ".join(random.choices("abc", k=random.choice([1, 1, 2, 3, 5, 6, 7, 9]))) for _ in range(7)] + ["", " "]
    for _ in range(4):
        docs = [(i, "\n".join(random.choices(pool, k=random.randint(0, 14)))) for i in range(40)]
        assert run(spark, docs) == brute(docs)


def test_long_line_copies_and_odd_rows(spark):
    long = "w1 w2 w3 w4 w5 w6 w7"
    docs = [(1, f"a\n{long}\nb"), (2, f"{long}"), (3, None), (4, ""), (5, f"x\n\n{long}  \n\ny"), (6, f"{long}\n{long}\n{long}"), (7, "one two"), (8, "one two")]
    got = run(spark, docs)
    assert got == {1: f"a\n{long}\nb", 2: "", 3: None, 4: "", 5: "x\n\n\ny", 6: "", 7: "one two", 8: "one two"}
    many = [(i, "p q r\ns t u v\nend of it") for i in range(300)]
    assert [t for t in run(spark, many).values() if t] == ["p q r\ns t u v\nend of it"]


def test_repeated_rows_and_rows_without_id(spark):
    run_of = "a b c\nd e f g"
    rows = [(None, f"x\n{run_of}"), (None, f"x\n{run_of}"), (2, f"{run_of}\nq"), (2, f"{run_of}\nq"), (2, f"other\n{run_of}"), (3, None), (None, None)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=T).collect()
    # without an id comes first; rows that repeat id and text share its fate
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(0, f"x\n{run_of}")] * 2 + [(2, "q")] * 2 + [(2, "other"), (3, ""), (0, "")])


def test_one_document_that_repeats_a_line_and_one_with_many_runs(spark):
    line = "p q r s t u v"
    single = [" ".join(f"w{k}_{j}" for j in range(7)) for k in range(10_000)]
    mixed = [x for k, y in enumerate(single) for x in (y, f"own {k}")]
    docs = [(1, "\n".join([line] * 50_000)), (2, "\n".join(single)), (3, "\n".join(mixed))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert lines.selected(lines.line_hashes(df, "doc_id", "text", T), T).count() < 250_000
    got = {r.doc_id: r for r in lines.dedup(df, min_words=T).collect()}
    assert got[1].text == line and got[1].n_removed == 49_999
    assert got[2].n_removed == 0 and got[3].text == "\n".join(f"own {k}" for k in range(10_000))


def test_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_are_few_and_those_of_copies_agree(spark):
    random.seed(11)
    body = [" ".join(random.choices("abcdefghij", k=random.randint(2, 6))) for _ in range(400)]
    docs = [(1, "\n".join(body)), (2, "\n".join([*random.sample(body, 60), *body[100:180], "an end"]))]
    hashes = lines.line_hashes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 40)
    every = lines.selected(hashes, 40).distinct().collect()
    mine = {(r["at"], r.fp) for r in every if r.id == 1}
    assert len(mine) < 0.5 * len(body)  # windows are ten lines long
    inside = {(r["at"] - 60 + 100, r.fp) for r in every if r.id == 2 and 70 <= r["at"] < 130}
    assert inside and inside <= mine


def test_equals_brute_force_on_many_small_corpora(spark):
    """Twenty corpora in one job: documents of different corpora share no line."""
    docs = []
    for corpus in range(20):
        random.seed(100 + corpus)
        pool = [" ".join(f"{w}{corpus}" for w in random.choices("abc", k=random.choice([1, 1, 2, 2, 3, 5, 7, 9]))) for _ in range(8)] + ["", " "]
        docs.append([(1000 * corpus + i, "\n".join(random.choices(pool, k=random.randint(0, 16)))) for i in range(25)])
    got = run(spark, [d for corpus in docs for d in corpus])
    for corpus in docs:
        assert {i: got[i] for i, _ in corpus} == brute(corpus)
