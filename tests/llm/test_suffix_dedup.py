"""Suffix-array dedup against a dictionary of all 50-byte strings."""

import hashlib
import zlib

import numpy as np


def brute(rows, n=50):
    first = {}
    for d, t in rows:
        for i in range(len(t) - n + 1):
            k = t[i : i + n]
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i + 1 : i + n + 1] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1 : len(t) + 1]])
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def compare(spark, texts, tmp_path, name="documents"):
    from tickloom.llm.suffix_dedup import op8_suffix_dedup

    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    rng = np.random.default_rng(3)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    spark.createDataFrame([(d, t, "x") for d, t in shuffled], "doc_id long, text string, bucket string").repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_dedup(spark, str(tmp_path / name)).collect()}
    want = brute([(d, (t or "").encode()) for d, t in rows])
    assert got == want, [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:5]
    return sum(x[1] for x in want.values())


def test_against_brute_force(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé "), rng.integers(2, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words, n))
    shared = [sentence(int(n)) for n in rng.integers(5, 30, 12)]
    texts = ["", None, "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 100, "x" * 49 + "y", sentence(40), sentence(40)]
    for _ in range(120):
        parts = [sentence(int(rng.integers(0, 15))) if rng.random() < 0.5 else str(rng.choice(shared)) for _ in range(rng.integers(1, 6))]
        t = " ".join(parts)
        if rng.random() < 0.3 and len(t) > 20:  # a slice, so that passages begin anywhere
            a = int(rng.integers(0, 15))
            t = t[a : len(t) - int(rng.integers(0, 5))]
        texts.append(t)
    texts += [texts[20], texts[20], texts[30] + "!", "!" + texts[30]]
    texts += [f"{i} {shared[0]} {shared[1]} {i * 7}" for i in range(60)]
    assert compare(spark, texts, tmp_path) > 1000


def test_hot_grams_slices_and_edges(spark, tmp_path, monkeypatch):
    import tickloom.llm.suffix_dedup as s

    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    texts = [base[:1500] + "".join(rng.choice(list("abc"), 500)) + base[1000:]] + [base[int(a) : int(a) + 200] + str(i) for i, a in enumerate(rng.integers(0, 2800, 40))]
    hot = "".join(rng.choice(list("abcdefgh "), 90))
    texts += ["".join(rng.choice(list("xyz "), 40)) + hot + "".join(rng.choice(list("xyz "), 40)) for _ in range(1300)]
    assert compare(spark, texts, tmp_path) > 10_000
    offsets = np.array([0, len(base)])
    data = np.frombuffer(base.encode(), np.uint8)
    whole = np.concatenate([p[3] for p in s._text_places(data, offsets, np.array([1]))])
    monkeypatch.setattr(s, "SLICE", 500)
    cut = np.concatenate([p[3] for p in s._text_places(data, offsets, np.array([1]))])
    assert set(whole) == set(cut)


def test_defined_cases(spark):
    from tickloom.llm.suffix_dedup import remove_repeats

    t = "".join(np.random.default_rng(6).choice(list("abcdefgh"), 120))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, len(r.kept)) for r in remove_repeats(df).collect())
    assert got == [(-1, 0, 0), (-1, 120, 120), (1, 120, 120), (1, 120, 120), (2, 120, 0)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark, monkeypatch):
    """Each row is judged by its own text against smaller doc_ids only, in the hot route and in the other."""
    import tickloom.llm.suffix_dedup as s

    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    a, b, c = text(90), text(90), text(70)
    rows = [(7, a + c), (7, b + c), (7, a + c), (3, c), (-9, b[10:80]), (9, text(30) + a), (9, b + text(30)), (9, text(40)), (1 << 60, a), (2, "")]
    rows += [(100 + i // 2, text(30) + c[5:65] + text(20)) for i in range(40)]
    far = [((1 << 63) - 1, a), (-(1 << 63), c), (5 * 10**18, b), (5 * 10**18, text(30) + c)]  # no room for a number beside such ids
    for hot, more in ((1024, []), (4, far)):
        rows = rows + more
        monkeypatch.setattr(s, "HOT", hot)
        got = sorted((r.doc_id, r.n_bytes, r.text_crc32, bytes(r.kept)) for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
        first = {}
        for d, t in rows:
            for i in range(len(t) - 49):
                first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
        want = []
        for d, t in rows:
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 49):
                gone[i : i + 50] |= first[t[i : i + 50]] < d
            raw = np.frombuffer(t.encode(), np.uint8)
            want.append((d, len(t), zlib.crc32(raw.tobytes()), raw[~gone].tobytes()))
        assert got == sorted(want)
    assert s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), once=True).count() == len(set(rows))


def test_contexts_do_not_depend_on_slices(monkeypatch):
    """Near copies that differ by a byte near a seam: each gram, context and place as in the text uncut."""
    import tickloom.llm.suffix_dedup as s

    base = np.random.default_rng(7).choice(np.frombuffer(b"abcdefgh ", np.uint8), 3000)
    whole = {}
    for shift in range(-60, 61, 3):
        data = base.copy()
        data[1000 + shift] = ord("X")
        monkeypatch.setattr(s, "SLICE", 4 << 20)
        uncut = {x for p in s._text_places(data, np.array([0, 3000]), np.array([1])) for x in zip(*(v.tolist() for v in p), strict=True)}
        monkeypatch.setattr(s, "SLICE", 500)
        cut = [x for p in s._text_places(data, np.array([0, 3000]), np.array([1])) for x in zip(*(v.tolist() for v in p), strict=True)]
        assert set(cut) == uncut
        whole[shift] = uncut
    assert len(set(map(frozenset, whole.values()))) > 1


def test_memory_of_round_two():
    """Places beyond one piece are named a piece at a time, hot ones as well, and those of a document settle as before."""
    import tracemalloc

    import pyarrow as pa

    import tickloom.llm.suffix_dedup as s

    rng = np.random.default_rng(9)
    keys, n = np.arange(4), 30_000
    text = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 31 * n // 2)
    at = np.arange(n // 2, dtype="<u4") * 30 + 100
    at = at[at + 100 < len(text)]
    texts = pa.table({"blob": pa.array([_packed([(1, text), (2, text)])], pa.binary())})
    doc, place = np.repeat(np.array([1, 2], "<i8"), len(at)), np.tile(at, 2)
    peaks, rows = {}, {}
    for kind in (s.OPEN, s.OPEN_HOT):
        flags = pa.table({"kind": pa.array([kind], pa.int8()), "blob": pa.array([s._pack(doc, place)], pa.binary())})
        tracemalloc.start()
        rows[kind] = s._open_contexts(keys, 1)((pa.scalar(0),), texts, flags)
        peaks[kind] = tracemalloc.get_traced_memory()[1] / len(doc)
        tracemalloc.stop()
    windows = [s._unpack(b, "<u8", "<u8", "<i8", "<u4") for k, b in zip(rows[s.OPEN_HOT]["kind"].to_pylist(), rows[s.OPEN_HOT]["blob"].to_pylist(), strict=True) if k == s.WINDOW]
    assert {int(d) for w in windows for d in w[2]} == {1}  # all of the second document settle in the bucket
    covered = np.zeros(len(text), bool)
    for b in (b for k, b in zip(rows[s.OPEN_HOT]["kind"].to_pylist(), rows[s.OPEN_HOT]["blob"].to_pylist(), strict=True) if k == s.SETTLED):
        docs, starts, _ = s._unpack(b, "<i8", "<u4", "<u4")
        assert set(docs.tolist()) == {2}
        covered[starts] = True
    assert covered[np.unique(at[:, None].astype(int) - s.SPAN + np.arange(s.SPAN + 1))].all()
    tracemalloc.start()
    done = list(s._rank_open(keys, 1)(iter(rows[s.OPEN].to_batches())))
    peaks["rank"] = tracemalloc.get_traced_memory()[1] / len(doc)
    tracemalloc.stop()
    assert {int(d) for b in done for x in b.column(2).to_pylist() for d in s._unpack(x, "<i8", "<u4", "<u4")[0]} == {2}
    assert peaks[s.OPEN] < 1200 and peaks["rank"] < 2000 and peaks[s.OPEN_HOT] < 4000, peaks  # bytes a place


def _packed(rows):
    import zstandard

    raw = np.array([d for d, _ in rows], "<i8").tobytes() + np.array([len(t) for _, t in rows], "<u4").tobytes() + b"".join(t.tobytes() for _, t in rows)
    return len(rows).to_bytes(8, "little") + zstandard.compress(raw, 1)


def test_memory_of_sampling():
    """A long text is sampled in slices whose hashes stay small."""
    import tracemalloc

    import tickloom.llm.suffix_dedup as s

    data = np.random.default_rng(10).integers(97, 105, 3 << 20).astype(np.uint8)
    tracemalloc.start()
    places = sum(len(p[0]) for p in s._text_places(data, np.array([0, len(data)]), np.array([1])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places > len(data) // 20 and peak < 60 << 20, peak
