"""The pipeline on a small corpus with planted cases, and every registered query's shape."""

import hashlib

import numpy as np


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    stems = {"en": ["the", "ing", "tion", "wh", "th", "er"], "fr": ["eau", "é", "ment", "que", "ou", "ai"]}
    word = lambda lang: "".join(rng.choice(stems[lang], rng.integers(2, 6)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    docs = {i: (text("en" if i % 2 else "fr", 80), "en" if i % 2 else "fr") for i in range(200)}
    passage, item = text("en", 60), text("en", 30)
    docs[300] = (docs[7][0], "en")  # an exact copy
    w = docs[9][0].split()
    w[5] = w[40] = "changed"
    docs[301] = (" ".join(w), "en")  # a near copy
    docs[302], docs[303] = (text("en", 100) + " " + passage, "en"), (passage + " " + text("en", 100), "en")
    docs[304] = (text("en", 40) + " " + item + " " + text("en", 40), "en")
    docs[305], docs[306] = ("123 456 !!", "en"), (None, "en")
    rows = [(i, t, lang, "src", len(t or "")) for i, (t, lang) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, text("fr", 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs) - {300, 301, 304, 305, 306}
    for i in range(200):
        assert got[i].decoded_sha256 == hashlib.sha256(docs[i][0].encode()).hexdigest()
    assert got[303].decoded_sha256 == hashlib.sha256(docs[303][0][len(passage) :].encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Null and repeated doc_ids keep their own columns, in every stage; empty tables pass; no session option stays."""
    import corpus_pipeline

    rng = np.random.default_rng(22)
    stems = {"en": ["the", "ing", "tion", "wh", "th", "er"], "fr": ["eau", "é", "ment", "que", "ou", "ai"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang], rng.integers(2, 6))) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr", 60), "en" if i % 2 else "fr", f"s{i}") for i in range(80)]
    passage = text("en", 40)
    odd = [(None, text("en", 50), "en", "n1"), (None, text("fr", 50), "fr", "n2"), (500, text("en", 50), "en", "r1"), (500, text("en", 50) + passage, "en", "r2"), (500, None, None, "r3"), (3, passage, "en", "p"), (600, text("en", 9000) + " " + passage, "en", "long")]
    odd += [(700, t := text("fr", 40), "fr", "c1"), (700, t, "fr", "c2")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, spans string, leaks string, class_id string, kept string"
    df = spark.createDataFrame([(*r, len(r[1] or ""), "w", "x", "y", "z", "k") for r in rows + odd], schema)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text("en", 30)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r.doc_id, r.source)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = {key(r): r for r in stage(spark, docs, str(tmp_path)).collect()}
        assert set(got) == {(r[0], r[3]) for r in rows + odd if name != "language_id" or r[1]}, name
        for r in rows + odd:
            if (r[0], r[3]) in got and name != "passage_dedup":
                assert got[r[0], r[3]].text == r[1] and got[r[0], r[3]].lang == r[2], name
        if name == "passage_dedup":
            assert got[500, "r1"].text == odd[2][1] and got[500, "r3"].text in (None, "") and got[500, "r2"].text == odd[3][1][: -len(passage)]
            assert got[600, "long"].text == odd[6][1][: -len(passage)] and got[600, "long"].n_chars == len(got[600, "long"].text)
            assert got[None, "n1"].text == odd[0][1] and got[700, "c1"].text == got[700, "c2"].text == t
    spark.conf.unset(corpus_pipeline.BATCHES)
    before = spark.conf.get(corpus_pipeline.BATCHES)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows + odd) - 1
    assert spark.conf.get(corpus_pipeline.BATCHES) == before
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= names
