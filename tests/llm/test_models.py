"""Language identification and quality scores on held-out rows of small tables."""

import numpy as np
import pandas as pd
import zlib


def tables(spark, tmp_path, n=600):
    rng = np.random.default_rng(11)
    stems = {"en": ["the", "ing", "tion", "wh", "th"], "fr": ["eau", "é", "ment", "que", "ou"], "de": ["sch", "ung", "ä", "ei", "keit"]}
    rows, labels = [], []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        words = ["".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(5, 300)))]
        good = i % 4 != 0
        if not good:
            at = int(rng.integers(0, len(words)))
            words[at:] = [w.upper() + "!!#" for w in words[at:]] + ["A!!#"] * 10
        rows.append((i, " ".join(words), lang if i % 7 else None, "s"))
        labels.append((i, int(good)))
    rows += [(n, None, "en", "s"), (n + 1, "", None, "s"), (n + 2, "123 !!", "en", "s"), (n + 3, "the thing " * 20000, None, "s"), (5, rows[5][1], "fr", "s"), (None, "thing", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels] + [(9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "s"]), dict(labels)


def test_models(spark, tmp_path):
    from tickloom.llm import language_id as L
    from tickloom.llm import quality_mil as M

    docs, quality = tables(spark, tmp_path)
    got = L.op9_language_id(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    truth = {i: ["en", "fr", "de"][i % 3] for i in quality}
    known = got[got.doc_id.isin(truth)]
    assert ((known.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1)) == known.held_out).all()
    test = known[known.held_out]
    assert (test.lang_pred == test.doc_id.map(truth)).mean() > 0.97
    by = got.set_index("doc_id").lang_pred
    assert [by[600], by[601], by[602], by[603]] == ["und", "und", "und", "en"]
    got = M.op4_quality_mil(spark, str(tmp_path)).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    test = got[got.held_out & got.doc_id.isin(quality)]
    y = test.doc_id.map(quality)
    a, b = test.score[y == 1].to_numpy(), test.score[y == 0].to_numpy()
    assert (a[:, None] > b[None]).mean() > 0.97


def test_nothing_to_learn_and_empty(spark):
    from tickloom.llm import language_id as L
    from tickloom.llm import quality_mil as M

    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(df, L.fit(df)).collect()] == ["und", "und"]
    model = M.fit(df.select("doc_id", "text"), df.select("doc_id").withColumn("quality", df.doc_id.cast("int")).limit(0))
    assert M.score(df.select("doc_id", "text"), model).count() == 2
    model = L.train([b"abc abc", b"xyz xyz"], ["a", "b"], epochs=2)
    assert L.identify(df.limit(0), model).count() == 0


def test_prediction_equals_plain_convolution():
    from tickloom.llm import language_id as L

    model = L.train([b"the thing " * 30, b"eau que " * 30], ["en", "fr"], epochs=3)
    text = b"the eau"
    rows, _ = L.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    features = []
    for w in L.WIDTHS:
        conv = [sum(model.embed[rows[0, i + j]] @ model.filters[w][j] for j in range(w)) for i in range(L.WINDOW - w + 1)]
        features.append(np.max(conv, axis=0))
    z = np.maximum(np.concatenate(features) + model.bias, 0) @ model.dense + model.offset
    want = z - np.log(np.exp(z).sum())
    assert np.allclose(L.Predictor(model).log_probabilities(rows)[0], want, atol=1e-4)
