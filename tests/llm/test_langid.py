"""Language identification: held-out accuracy, decoding and odd rows."""

import math

import numpy as np

from wiring.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (1 if n == 2 else code.shape[1] / 4) and all(len(set(c)) == 2 for c in code.T)


def test_an_error_in_one_bit_is_corrected():
    model = langid.Model(list("abcd"), code=langid.codewords(4), weights=np.ones(7))
    for k, word in enumerate(model.code):
        for bit in range(7):
            margins = word * 2.0
            margins[bit] *= -1
            assert model.decode(margins)[0] == k
    assert model.decode(np.zeros(7))[2]


def test_decoding_is_the_least_weighted_loss_of_all_codewords():
    rng = np.random.default_rng(5)
    for n in (2, 3, 5, 9):
        code = langid.codewords(n)
        weights = rng.uniform(0.1, 3, code.shape[1])
        model = langid.Model([f"l{k}" for k in range(n)], code=code, weights=weights)
        for _ in range(50):
            margins = rng.normal(0, 3, code.shape[1])
            losses = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(weights, row, margins, strict=True)) for row in code]
            best, score, unsure = model.decode(margins)
            order = sorted(losses)
            assert losses[best] == order[0] and math.isclose(score, 1 / sum(math.exp(order[0] - x) for x in losses), rel_tol=1e-9)
            assert unsure == (order[1] - order[0] < model.CLEAR * weights.sum())


def test_very_long_texts_are_read_whole(spark):
    model = langid.learn([("en", "the cat sat on the mat"), ("fr", "le chat est sur le tapis")])
    late = "le chat est sur le tapis " * 100 + "the cat sat on the mat " * 20_000
    df = spark.createDataFrame([(1, late), (2, "the mat " + "le chat " * 100_000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()] == ["en", "fr"]


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (3, None, "en"), (4, "123 !?", "fr"), (5, "", None), (6, "the mat", None), (6, "the mat", None)]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows for _ in range(1)], "doc_id long, text string, lang string, score double")
    model = langid.learn([("en", "the cat sat on the mat"), ("fr", "le chat est sur le tapis")])
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert langid.fit(df.limit(0)).languages == [] and langid.predict(df, langid.fit(df.limit(0))).first().lang_pred == "und"
    assert langid.learn([("en", "the")]).predict("le chat")[0] == "en"
    assert langid.predict(df.limit(0), model).count() == 0


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(3)
    rows, pools = [], {}
    for k in range(70):
        pools[f"l{k:02}"] = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)]
    for k, (lang, pool) in enumerate(pools.items()):
        for _ in range(20 - k // 5):
            rows.append((len(rows), " ".join(rng.choice(pool, 30)), lang))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(pools) and model.code.shape[1] > 63
    assert sum(model.predict(" ".join(rng.choice(pool, 30)))[0] == lang for lang, pool in pools.items()) >= 69
