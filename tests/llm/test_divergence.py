"""The source audit against DuckDB's plain sums over all terms, on odd rows too."""

import random

import duckdb
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string"


def compared(spark, rows, monkeypatch, **settings):
    import tempfile

    from tickloom.llm import divergence as d

    for k, v in settings.items():
        monkeypatch.setattr(d, k, v)
    path = tempfile.mkdtemp()
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, d.source_divergence(docs).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.sql(d.OP12_SQL).fetchall())
    return got


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 2, "SALTS": 3, "STRETCH": 200}])
def test_against_all_terms(spark, monkeypatch, settings):
    rng = random.Random(12)
    words = ["Ärger", "ärger", "é", "the", "The", "a1b", "x_y", "naïve", "中文"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        source = rng.choice(["s0", "s0", "s0", "s1", "S1", "é", None, "z" * 30])
        text = rng.choice([None, "", "123 !?"]) if i % 9 == 0 else " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 40)))
        rows.append((i, text, rng.choice(["en", "en", None, "de"]), source, 1, "clash"))
    rows += [(999, "the\x00the", "en", "lone", 1, None), (1000, "zz", "xx", "only", 1, None), (1001, None, "xx", "other", 1, None), (1002, "the " * 60_000, "en", "long", 1, None)]
    rows += rows[:50]
    got = compared(spark, rows, monkeypatch, **settings)
    assert ("xx", "only", "pair", "other", 0, 1) in got
    assert any(r[2] == "term" and r[5] == 10 for r in got)


def test_empty(spark, monkeypatch):
    assert compared(spark, [], monkeypatch) == []
