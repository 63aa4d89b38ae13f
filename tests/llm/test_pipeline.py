"""The pipeline, stage by stage, against brute force on the small table."""

import hashlib

import pytest

import corpus_pipeline as pipeline
from tests.llm import test_neardup
from wiring.llm import bpe, langid
from wiring.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]

    def rows(df):
        assert df.columns == list(pipeline.COLUMNS)
        return {r.doc_id: r for r in df.collect()}

    before = rows(docs.select(*pipeline.COLUMNS))
    named = rows(stages["language ID"](spark, docs, SF))
    gone = set(before) - set(named)
    assert len(gone) <= 0.02 * len(before) and all(named[i] == before[i] for i in named)
    assert all(i in gone for i, r in before.items() if not langid.has_letter(r.text))

    lined = rows(stages["line dedup"](spark, docs, SF))
    for i, r in lined.items():
        kept = r.text.split("\n")
        every = iter(before[i].text.split("\n"))
        assert all(line in every for line in kept)  # in order

    near = rows(stages["MinHash near-dedup"](spark, docs, SF))
    want = test_neardup.brute([(r.doc_id, r.text) for r in before.values()], 5)
    assert set(near) == {i for i, (_, _, kept) in want.items() if kept}

    clean = rows(stages["benchmark decontamination"](spark, docs, SF))
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, r in before.items() if any(x in r.text for x in items)}
    assert leaks.isdisjoint(clean) and len(set(before) - set(clean) - leaks) <= 0.01 * len(before)

    coded = {r.doc_id: r for r in stages["byte-level BPE"](spark, docs, SF).collect()}
    enc = bpe.encoding(*bpe._paths(None, None))
    for i, r in before.items():
        assert coded[i].ids == enc.encode_ordinary(r.text)
        assert coded[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, SF), "test-stage")
    got = {(r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.n_tokens) for r in docs.collect()} and got


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and repeated rows, rows without id, an empty table and columns of other names."""
    docs = table(spark, SF, "documents").limit(60)
    words = "the old house stood by the river and " * 30
    odd = spark.createDataFrame(
        [(None, words + "one", "en", "s", 1), (None, words + "one", "en", "s", 1), (None, None, None, None, None), (10**9, None, "en", "s", None), (10**9 + 1, "", None, None, 0),
         (10**9 + 2, words + "two", None, "s", None), (10**9 + 2, words + "two", None, "s", None), (10**9 + 3, "x" * 200_000, "en", None, 5)], docs.select(*pipeline.COLUMNS).schema)
    extra = docs.select(*pipeline.COLUMNS).unionByName(odd).selectExpr("*", "doc_id AS id", "text AS th", "1 AS key", "2 AS kept", "3 AS label")
    for name, stage in pipeline.STAGES:
        out = stage(spark, extra, SF)
        rows = out.collect()
        assert len(rows) <= 68 and (name == "byte-level BPE" or out.columns == list(pipeline.COLUMNS)), name
        assert stage(spark, extra.limit(0), SF).count() == 0, name
    near = pipeline.near_dedup(spark, extra, SF).collect()
    assert sum(r.doc_id is None and bool(r.text) for r in near) + sum(r.doc_id == 10**9 + 2 for r in near) == 2  # one document, of two rows
    assert sum(r.doc_id is None and r.text is None for r in near) == 1


def test_only_scratch_tables_are_discarded(spark, tmp_path):
    from wiring.llm.common import discard, materialise

    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3
    made = materialise(spark.range(3).toDF("n"), "three")
    assert made.count() == 3
    discard(made)
