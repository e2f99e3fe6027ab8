"""Token output, sharding, byte-level BPE, WARC and quality rules against plain versions."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

ODD = ["", None, "a", "  \n\n b\n\n\nc  ", "don't  stop now  x", "\x1cab\x1d cd\x85e", "<|endoftext|> x<|startoftext|>", "É é ß 日本語 🙂🙂 ｱ", "a" * 5000, " " * 300 + "x", "x\r\n\ty", "same", "same", "ΣΑΣ. ΣΑΣ", "é ́a"]


def docs(spark, texts, extra=False):
    rows = [(i, t, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string" if extra else "doc_id long, text string, lang string")


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    from tickloom.llm.byte_bpe import digests, encode

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    alphabet = list("ab c\n\n  é.,'s12🙂\t")
    texts = ODD + ["".join(rng.choice(alphabet, 900)) for _ in range(20)] + ["".join(rng.choice(alphabet, 900))] * 2
    for chunk, overlap in ((1 << 16, 1 << 10), (100, 30), (50, 5)):
        got = {r.doc_id: r for r in digests(encode(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = enc.encode_ordinary(t or "")
            want = struct.pack(f"<{len(ids)}I", *ids)
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(want).hexdigest()), (chunk, t[:80] if t else t)
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode(docs(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_orc_ids_equal_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tickloom.llm.common import shared_path
    from tickloom.llm.orc_tokens import document_index, read_orc, write_orc

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = shared_path(spark, "t")
    write_orc(docs(spark, ODD).repartition(3), path, P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in document_index(spark, path).collect()}
    assert len(got) == len(ODD)
    start = 0
    for i, t in enumerate(ODD):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), repr(t)
        start += len(ids)
    assert read_orc(spark, path).where("doc_id = 3").count() == 1
    import pyarrow.orc as orc

    files = list(__import__("pathlib").Path(path.removeprefix("file:").replace("//", "/")).glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == len(ODD)
    empty = shared_path(spark, "t")
    write_orc(docs(spark, []), empty, P.path("word_bpe_49k.json"))
    assert document_index(spark, empty).count() == 0


def test_orc_index_reads_the_ids_once_in_small_batches(spark, monkeypatch):
    import public_tokenizers as P

    import tickloom.llm.orc_tokens as o
    from tickloom.llm.common import shared_path

    path, seen = shared_path(spark, "orc-batches"), []
    monkeypatch.setattr(o, "BATCH_ROWS", 3)
    before, put = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), getattr(o, "written", None)

    def digests(df, name):
        seen.append((spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), name))
        return put(df, name)

    monkeypatch.setattr(o, "written", digests, raising=False)
    o.write_orc(docs(spark, ODD), path, P.path("word_bpe_49k.json"))
    index = o.document_index(spark, path)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and " orc " not in plan  # the ids were read at the call, and only their digests are left
    assert seen == [("3", "orc-index")] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert index.count() == len(ODD)


def test_orc_special_tokens_count_in_their_case():
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tickloom.llm.orc_tokens import encode_texts

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|endoftext|>Y <|STARTOFTEXT|>", "plain <", "| words", None, "<|"]
    rng = np.random.default_rng(3)
    alphabet = list("abcXYZ  12.,'!<|>ßéÿÀª²µ\xa0\x85\x1c\tsΣ日")
    texts += ["".join(rng.choice(alphabet, int(k))) for k in rng.integers(0, 40, 3000)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for end_id, end in ((None, []), (2, [2])):
        assert encode_texts(pa.array(texts), P.path("word_bpe_49k.json"), end_id).to_pylist() == [[*x, *end] for x in want]
    usual = [i for i, t in enumerate(texts) if t and t.isascii() and "<|" not in t and "\x1c" not in t]  # none of these goes whole
    assert encode_texts(pa.array([texts[i] for i in usual]), P.path("word_bpe_49k.json"), 2).to_pylist() == [[*want[i], 2] for i in usual]


def test_orc_other_rules_encode_whole_texts(tmp_path):
    """A tokenizer file whose pattern is another one gets no shortcut by words."""
    import json

    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tickloom.llm.orc_tokens import _vocabulary, encode_texts

    file = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[^a]+|a+"}
    path = str(tmp_path / "other.json")
    json.dump(file, open(path, "w", encoding="utf-8"))
    assert _vocabulary(P.path("word_bpe_49k.json")).by_word and not _vocabulary(path).by_word
    tok, texts = Tokenizer.from_file(path), ["some banana words", None, "x"]
    assert encode_texts(pa.array(texts), path, 2).to_pylist() == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_orc_repeated_ids_and_long_texts(spark):
    """Rows that share a doc_id, or have none, keep their place in the files; a very long text is whole."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tickloom.llm.common import shared_path
    from tickloom.llm.orc_tokens import document_index, read_orc, write_orc

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(5, "some words"), (5, "other words here"), (None, "no id"), (5, "some words"), (7, "word " * 1_200_000 + "é")]
    path = shared_path(spark, "t")
    write_orc(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    got = sorted(document_index(spark, path).collect(), key=lambda r: r.start)
    want = {zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)): len(ids) for ids in ([*tok.encode(t, add_special_tokens=False).ids, 2] for _, t in rows)}
    assert [r.doc_id for r in got] == [None, 5, 5, 5, 7] and all(want[r.ids_crc32] == r.n_tokens for r in got)
    stored = [(r.doc_id, zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in read_orc(spark, path).coalesce(1).collect()]
    assert [x for x in stored if x[0] == 5] == [(r.doc_id, r.ids_crc32) for r in got if r.doc_id == 5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]


def test_rendezvous(spark, tmp_path):
    from pyspark.sql import functions as F

    from tickloom.llm.sharding import op3_rendezvous, shard

    texts = ODD + [f"t{i}" for i in range(3000)]
    docs(spark, texts, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op3_rendezvous(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24
    # weights: a shard of twice the weight gets about twice the keys, and a new weight moves keys only to it
    keys = spark.range(20000).withColumnRenamed("id", "k")
    both = shard(shard(keys, "k", [1, 2, 1], "a"), "k", [1, 4, 1], "b").collect()
    n = Counter(r.a for r in both)
    assert 1.85 < n[1] / n[0] < 2.15 and all(r.b in (r.a, 1) for r in both)
    assert shard(spark.createDataFrame([(None,), (None,)], "k long"), "k", [1, 1]).select(F.countDistinct("shard")).first()[0] == 1
    with pytest.raises(ValueError):
        shard(keys, "k", [1, 0])


def test_warc_round_trip(spark, tmp_path):
    from tickloom.llm.warc import WarcError, archive, frames, op6_warc, parse_record, read_archives, record_bytes

    html = ["<p>" + "x" * 200] * 4 + ["short"] * 3 + [None, "", "é" * 60, "é" * 60, "a\r\n\r\nWARC/1.1\r\n" + "b" * 90]
    html += [f"<html>{i} " + "common words " * 20 for i in range(300)]
    ids = list(range(len(html)))[::-1]
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i % 7 else None, h, "clash") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, record_type string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op6_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(ids)
    first = {}
    for i, h in sorted(zip(ids, html, strict=True)):
        raw = (h or "").encode()
        other = first.setdefault(raw, i) if len(raw) >= 100 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if other == i else ("revisit", other))
    where = archive(pages.limit(0))
    assert spark.read.parquet(where + "/_list").count() == 0 and read_archives(spark, where).count() == 0
    payloads = {r.page_id: r.payload for r in read_archives(spark, archive(pages)).where("record_type = 'response'").collect()}
    assert payloads[ids[300]] == html[300].encode()
    good = record_bytes("response", "u", b"abc", "d", 3, "urn:page:1")
    assert parse_record(good)[1] == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(WarcError):
            parse_record(bad)
    import zstandard

    z = zstandard.ZstdCompressor().compress(good)
    assert list(frames(z + z)) == [good, good]
    for bad in (z[:-3], z + b"junk", struct.pack("<II", 0x184D2A5D, 99) + z):
        with pytest.raises((WarcError, zstandard.ZstdError)):
            list(frames(bad))


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_rules(spark):
    from tickloom.llm.quality_rules import Rule, quality_rules

    rng = np.random.default_rng(2)
    texts = ODD + [" ".join(rng.choice(["the", "of", "a\n", "b", "ü#", "\x0b", "c"], n)) for n in (3, 30, 60, 400)] + ["x y z w v\n" * 9, "l\n \nl\n\t\nl", "The cat and the dog of a house went to the sea with it."] + ["  a b"]
    rows = quality_rules(docs(spark, texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert [r.kept for r in rows if texts[r.doc_id] and texts[r.doc_id].startswith("The cat")] == [True]
    plan = quality_rules(docs(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality_rules(docs(spark, texts), rules=(Rule("none", "n_words", "n_words", low=2000),)).where("kept").count() == 0
    assert quality_rules(docs(spark, [])).count() == 0
