"""Decontamination against alignment of all pairs, and Smith-Waterman against plain dynamic programming."""

import numpy as np


def plain(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(words, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
        best = max(best, *row)
    return best


def test_alignment():
    from tickloom.llm.decontaminate import smith_waterman

    rng = np.random.default_rng(12)
    for _ in range(300):
        a = rng.integers(0, 8, rng.integers(1, 25)).astype(np.uint64)
        b = rng.integers(0, 8, rng.integers(0, 60)).astype(np.uint64)
        score, first, last = smith_waterman(a, b)
        assert score == plain(a.tolist(), b.tolist())
        if score:
            assert 0 <= first <= last < len(b) and plain(a.tolist(), b[first : last + 1].tolist()) == score


def test_leaks(spark, monkeypatch):
    from tickloom.llm import decontaminate as d

    rng = np.random.default_rng(13)
    vocabulary = [f"w{i}" for i in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = {i * 10: text(int(n)) for i, n in enumerate(rng.integers(9, 60, 30))}
    docs = {}
    for i in range(300):
        w = text(int(rng.integers(0, 150))).split()
        kind = i % 6
        item = items[int(rng.integers(0, 30)) * 10].split()
        if kind == 0:
            w[len(w) // 2 : len(w) // 2] = item
        elif kind == 1:  # an edited copy
            item = [x if rng.random() > 0.12 else str(rng.choice(vocabulary)) for x in item]
            w[len(w) // 3 : len(w) // 3] = item
        elif kind == 2:
            w += items[0].upper().split()  # an item that is everywhere
        docs[i] = " ".join(w)
    rows = [(i, t, "x") for i, t in docs.items()] + [(1000, None, "x"), (1001, "", "x"), (0, docs[0], "x"), (None, items[10], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([*items.items(), (5, None), (6, "two words"), (None, "q w e r t")], "item_id long, text string")
    want = {}
    for i, t, _ in rows:
        for k, v in items.items():
            a, b = v.split(), [x.lower() for x in (t or "").split()]
            s = plain(a, b) if set(a) & set(b) else 0
            if s >= max(0.5 * len(a), min(8, len(a))):
                want[i, k] = s / len(a)
    for bits in (1 << 26, 64):  # a bitmap that tells nothing apart loses nothing
        monkeypatch.setattr(d, "BITS", bits)
        out = d.with_leaks(df, bench).collect()
        assert len(out) == len(rows)
        got = {(r.doc_id, x.item_id): x.score for r in out for x in r.leaks}
        missed = {k for k in want if k not in got}
        assert len(missed) <= 0.02 * len(want) and all(want[k] < 0.75 for k in missed), missed  # an edit in every three words leaves no seed
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got if want.get(k, 0) >= 0.5) and set(got) <= set(want)
    assert sorted(str(r.doc_id) for r in d.without_leaks(df, bench).collect()) == sorted(str(r.doc_id) for r in out if not r.leaks)
    assert d.with_leaks(df.limit(0), bench).count() == 0 and d.without_leaks(df, bench.limit(0)).count() == len(rows)
    assert all(r.leaks == [] for r in d.with_leaks(df, bench.limit(0)).collect())


def test_copies_of_an_item_that_is_everywhere(spark):
    """A partial and an edited copy are found though a third of the documents hold the item in full."""
    from tickloom.llm import decontaminate as d

    rng = np.random.default_rng(14)
    item = [f"i{i}" for i in range(40)]
    edited = [f"e{i}" if i in (2, 5, 8) else w for i, w in enumerate(item)]
    filler = lambda: [f"w{x}" for x in rng.integers(0, 5000, 30)]
    texts = [filler() + (item if i % 3 == 0 else []) + filler() for i in range(300)]
    texts += [filler() + item[10:] + filler(), filler() + edited + filler()]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: round(r.leaks[0].score, 9) for r in d.with_leaks(df, bench).collect() if r.leaks}
    assert got == {**{i: 1.0 for i in range(0, 300, 3)}, 300: 0.75, 301: 0.85}
