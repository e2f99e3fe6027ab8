"""Near-duplicate classes against all pairs of a small fixture, and the alignment against plain dynamic programming."""

import re
import zlib

import numpy as np
import pytest


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def words(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def test_alignment():
    from tickloom.llm.order_minhash import aligned

    rng = np.random.default_rng(7)
    for _ in range(400):
        a = rng.integers(0, rng.integers(2, 40), rng.integers(0, 60)).astype("<u4")
        b = list(a)
        for _ in range(rng.integers(0, 14)):
            i = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5:
                b.insert(i, rng.integers(0, 40))
            elif i < len(b):
                b.pop(i)
        b = np.array(b, "<u4")
        m = lcs(a.tolist(), b.tolist())
        want = m / max(len(a), len(b)) if len(a) + len(b) else 0
        assert aligned(a, b) == pytest.approx(want if want >= 0.8 else 0)


def test_bounds_lose_no_pair(spark):
    """Every pair that aligns and has different roots stays a candidate, whatever its lengths and edits; most others go."""
    from tickloom.llm import order_minhash as op

    rng = np.random.default_rng(11)
    texts = []
    for size, n in ((90, 120), (12, 60), (700, 40)):
        base = rng.integers(0, 900, size)
        for _ in range(n):
            w = base.copy()
            for _ in range(int(rng.integers(0, size // 3))):
                w[int(rng.integers(0, len(w)))] = rng.integers(0, 900)
            texts.append(w[: len(w) - int(rng.integers(0, 1 + size // 15))].astype("<u4"))
    texts += [rng.integers(0, 900, int(n)).astype("<u4") for n in rng.integers(1, 200, 100)]
    words = spark.createDataFrame([(i, w.tobytes()) for i, w in enumerate(texts)], "doc_id long, words binary")
    root = [0 if i < 40 else i // 2 for i in range(len(texts))]
    cells = spark.createDataFrame([(7, i, 100 - i, root[i]) for i in range(len(texts))], "s long, doc_id long, met long, root long")
    got = {(r.a, r.b) for r in op.may_align(cells, words).collect()}
    near = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and root[i] != root[j] and op.aligned(x, y)}
    assert len(near) > 500 and near <= got
    assert len(got) < 0.2 * len(texts) ** 2 / 2


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_classes(spark):
    from tickloom.llm.order_minhash import near_duplicates

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
        return " ".join(w)

    base = [text(int(n)) for n in rng.integers(40, 200, 39)] + [text(150)]
    texts = [*base, *[edit(base[i], 1) for i in range(20)], *[base[i] for i in range(5)], base[7].upper() + "!!", *[edit(base[39], 2) for _ in range(70)]]
    shared = text(30)
    texts += [f"{shared} {text(60)}" for _ in range(90)]  # one passage in many texts makes no class
    texts += ["", None, "...", "one", "One.", "a b", "x " * 300, "x " * 299]
    ids = [int(i) for i in rng.permutation(len(texts)) * 5]
    df = spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, class_id string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    w = {i: words(t) for i, t in zip(ids, texts, strict=True)}
    h = {i: [zlib.crc32(x.encode()) for x in v] for i, v in w.items()}
    near = [(a, b) for a in ids for b in ids if a < b and w[a] and min(len(w[a]), len(w[b])) >= 0.8 * max(len(w[a]), len(w[b])) and len(set(h[a]) & set(h[b])) >= 0.3 * len(set(h[a])) and lcs(h[a], h[b]) >= 0.8 * max(len(w[a]), len(w[b]))]
    want = classes(near, ids)
    bad = [(a, b, len(w[a]), len(w[b]), lcs(h[a], h[b])) for a, b in near if got[a] != got[b]]
    assert not bad, [(x, w[x[0]][:12], w[x[1]][:12]) for x in bad[:4]]
    assert got == want


def test_defined_cases(spark):
    from tickloom.llm.order_minhash import near_duplicates

    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A, b c d e f"), (9, None), (8, ""), (20, long), (21, "other " + long), (21, "x y z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id) for r in near_duplicates(df).collect())
    assert got == [("1", 1), ("20", 20), ("21", 20), ("21", 20), ("3", 1), ("3", 1), ("8", 8), ("9", 9), ("None", None)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    from tickloom.llm.graph import components

    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (80, 2))] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k != 500}


def test_crowded_buckets_are_verified(spark):
    """Every pair of a crowded bucket that aligns is linked, however many texts share the bucket."""
    from tickloom.llm import order_minhash as op

    passage = "this passage of eight words is in all"
    texts = {4 * i + j: f"{passage} own{i} more{i} {w}{i}" for i in range(70) for j, w in enumerate(("left", "right"))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sketch = {r.doc_id: r.sketch[0] for r in op.sketches(df, count=1, ordered=1).collect()}
    crowd = max(map(list(sketch.values()).count, set(sketch.values())))
    assert crowd > 24
    near = [(a, a + 1) for a in texts if a % 4 == 0 and sketch[a] == sketch[a + 1]]
    got = {r.doc_id: r.class_id for r in op.near_duplicates(df, count=1, ordered=1).collect()}
    assert all(got[a] == got[b] for a, b in near)
    assert all(got[a] in (a, a - a % 4) for a in texts)


def edited(rng, n, edits):
    a = rng.integers(1, 1 << 62, n).astype(np.uint64)
    b = a.copy()
    b[rng.choice(n, edits, replace=False)] = rng.integers(1, 1 << 62, edits).astype(np.uint64)
    return a, b


def meet(op, a, b):
    cells, sizes = op._cells(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), op.WORDS, op.SKETCHES, op.ORDERED, 0.8)
    return bool(set(cells[: sizes[0]].tolist()) & set(cells[sizes[0] :].tolist()))


def test_sketches_meet_pairs_at_the_threshold():
    """Two texts that align to just 0.8, with edits scattered, agree on a sketch; no third text helps them."""
    from tickloom.llm import order_minhash as op

    rng = np.random.default_rng(15)
    for n, edits, least in ((16, 3, 0.9), (24, 4, 0.9), (40, 8, 0.9), (60, 12, 0.85), (100, 20, 0.88), (200, 40, 0.88), (500, 100, 0.9), (100, 10, 0.99)):
        pairs = [edited(rng, n, edits) for _ in range(200)]
        assert all(op.aligned(a, b) == pytest.approx(1 - edits / n) for a, b in pairs)
        assert sum(meet(op, a, b) for a, b in pairs) >= least * len(pairs), n


def test_short_texts_always_meet():
    """Texts of at most 15 words meet if they align to 0.8, and by what is left of them only then."""
    from tickloom.llm import order_minhash as op

    rng = np.random.default_rng(16)
    some = 0
    for _ in range(1500):
        a = rng.integers(0, 9, int(rng.integers(1, 16))).astype(np.uint64)
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.integers(0, len(b) + 1))
            b = [b[:i] + [int(rng.integers(0, 9))] + b[i:], b[:i] + b[i + 1 :], b[:i] + [int(rng.integers(0, 9))] + b[i + 1 :]][int(rng.integers(0, 3))][:15]
        if not b:
            continue
        b = np.array(b, np.uint64)
        near = lcs(a.tolist(), b.tolist()) >= 0.8 * max(len(a), len(b)) - 1e-9
        x, y = (set(op._left_over(t[None, :], 0.8).ravel().tolist()) for t in (a, b))
        assert bool(x & y) == near
        assert not near or meet(op, a, b)
        some += near
    assert some > 300


def test_recall_on_all_pairs(spark):
    """Of all pairs of distinct texts of documents that align to 0.8, found without sketches, at least 0.95 are in one class."""
    from pyspark.sql import functions as F
    from tickloom.llm import order_minhash as op

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    digest = op.sketches(docs, count=1).where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    words = op._words(docs).join(digest.select("doc_id"), "doc_id")
    one_bucket = digest.select(F.lit(0).alias("s"), "doc_id", F.lit(0).alias("met"), F.col("doc_id").alias("root"))
    near = [(r.a, r.b) for r in op.verify(op.may_align(one_bucket, words), words).collect()]
    got = {r.doc_id: r.class_id for r in op.near_duplicates(docs).collect()}
    assert len(near) > 20
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
