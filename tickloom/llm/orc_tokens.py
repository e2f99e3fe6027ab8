"""Token ids in ORC: files in document order with integer run-length encoding, row indexes and Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, row_chunks, setting, shared_path, text_buffers, written

#: Words whose ids a Python worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 200_000
SLICE_BYTES = 4 << 20
#: Rows that go to a Python worker at once, so that a few long ones fill neither it nor the JVM's buffers.
BATCH_ROWS = 2000
SYMBOLS = ".,;:!?*#$%&+-=()[]{}/"
#: The parts of a tokenizer file with which a text's words can be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
_tokenizers: dict = {}


class _Vocabulary:
    """The library's tokenizer, ids of words seen before, and whether words can be encoded one by one."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (file.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and split[0].get("pattern") == {"Regex": PATTERN} and split[0].get("invert") is True
            and len(split) == 2 and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
            and file.get("post_processor") is None and file.get("truncation") is None
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout")
            and all(x["content"].startswith("<|") and not x["normalized"] for x in file["added_tokens"])
        )
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for s, i in model["vocab"].items() if s.endswith(WORD_END)]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of each of ``words``, which are encoded once and remembered."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        names, known = words.to_numpy(zero_copy_only=False).tolist(), self.known
        new = np.array([w not in known for w in names], bool)
        letters = new & np.asarray(pc.utf8_is_alpha(words))
        self._learn_letters([names[i] for i in np.flatnonzero(letters).tolist()])
        other = [names[i] for i in np.flatnonzero(new & ~letters).tolist()]
        known.update(zip(other, (x.tobytes() for x in self.encode(other)), strict=True))
        return _lists([known[w] for w in names])

    def _learn_letters(self, words: list[str]) -> None:
        """Encode words of letters, many in one text: each is one match of the pattern and ends with an id that says so."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if ends and len(ends) == len(group) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.known.update(zip(group, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
            else:
                self.known.update((w, x.tobytes()) for w, x in zip(group, self.encode(group), strict=True))


def _vocabulary(path: str) -> _Vocabulary:
    if path not in _tokenizers:
        _tokenizers[path] = _Vocabulary(path)
    return _tokenizers[path]


def _lists(raw: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _ends(words: pa.StringArray, stems: pa.StringArray) -> pa.StringArray:
    """What ``words`` have after ``stems``."""
    n = (np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(stems))).astype(np.int64)
    data, offsets = text_buffers(words)
    upto = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(offsets[1:] - upto[1:], n) + np.arange(upto[-1])
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def _concatenated(lists: pa.ListArray, at: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Rows of the lists numbered ``at``, put together from rows[i] to rows[i + 1]."""
    taken = lists.take(pa.array(at))
    offsets = np.asarray(taken.offsets)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0])[rows].astype(np.int32)), taken.flatten())


def _word_ids(words: pa.StringArray, vocabulary: _Vocabulary) -> pa.ListArray:
    """The ids of distinct words.

    Letters and a run of symbols after them are tokens apart to the vocabulary's pattern, so a word
    with such an end is put together from its two parts.
    """
    stems = pc.utf8_rtrim(words, SYMBOLS)
    stems = pc.if_else(pc.utf8_is_alpha(stems), stems, words)
    stem, end = stems.dictionary_encode(), _ends(words, stems).dictionary_encode()
    lists = vocabulary.ids(pa.concat_arrays([stem.dictionary, end.dictionary]))
    both = np.stack([np.asarray(stem.indices), np.asarray(end.indices) + len(stem.dictionary)], 1)
    return _concatenated(lists, both.ravel(), 2 * np.arange(len(words) + 1))


def encode_texts(column: pa.Array, path: str, end_id: int | None = None) -> pa.ListArray:
    """The library's ids of every text, and ``end_id`` after them if there is one; nulls are empty.

    The vocabulary's pattern never crosses white space and letters count in lower case, so each
    lower-case word of a text is encoded once by the library and remembered. That holds for texts
    of Latin-1 characters, whose composition, case and white space are the same to Arrow and to the
    library; any other text goes to the library whole, and so does one with the start of a special
    token, which the library finds in its case as written. With a tokenizer file of other rules
    than PATTERN and NORMALIZERS all texts go whole.
    """
    vocabulary = _vocabulary(path)
    data, offsets = text_buffers(column)
    odd = (data >= 0xC4) | (data - np.uint8(0x1C) < 4)  # past Latin-1, or white space to Arrow alone
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    whole = np.zeros(len(column), bool)
    whole[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
    if not vocabulary.by_word:
        whole[:] = True
    column = pc.fill_null(column, "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(whole), "", column)))
    counts = np.asarray(lists.offsets)
    words = lists.values.slice(int(counts[0]), int(counts[-1] - counts[0])).dictionary_encode()
    counts = counts[1:] - counts[0]
    texts = vocabulary.encode([column[i].as_py() for i in np.flatnonzero(whole).tolist()])
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    # What can stand in a row: each distinct word, then each whole text, then nothing, then the end.
    lists = pa.concat_arrays([_word_ids(words.dictionary, vocabulary), _lists([*(x.tobytes() for x in texts), b"", end])])
    last = np.full(len(column), len(lists) - 1, np.int32)
    text = last - 1
    text[whole] = len(words.dictionary) + np.arange(len(texts))
    tails = np.stack([text, last], 1) if len(texts) else last[:, None]
    at = np.insert(np.asarray(words.indices), np.repeat(counts, tails.shape[1]), tails.ravel())
    return _concatenated(lists, at, np.concatenate([[0], counts + tails.shape[1] * np.arange(1, len(counts) + 1)]))


def encode(docs: DataFrame, path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, ids_crc32) of every row; a null text counts as empty, and has only the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_chunks(text_buffers(batch.column(1))[1], SLICE_BYTES):
                part = batch.slice(low, high - low)
                ids = encode_texts(part.column(1), path, end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _checksums(ids)], names=["doc_id", "ids", "ids_crc32"])

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("ids_crc32", T.LongType())])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def _checksums(ids: pa.ListArray) -> pa.Array:
    """The crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    stops = np.asarray(ids.offsets).tolist()
    values = np.asarray(ids.values).astype("<u4", copy=False)
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.int64())


def write_orc(docs: DataFrame, target: str, tokenizer: str, end_id: int | None = 2, stripe_mb: int = 16, compress: str = "LZ4") -> None:
    """Encode ``docs`` (doc_id, text) and write ``target`` as ORC files that follow one another in doc_id order.

    The texts are dealt into doc_id ranges first and encoded in place, so they move once and are
    encoded once. Each stripe has row indexes, and Bloom filters on doc_id. Rows without doc_id come
    first; rows that share one are all written, in the order of their checksums. An empty table
    makes files without rows.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange(parts(docs.sparkSession), "doc_id")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        encoded = encode(ranged, tokenizer, end_id).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids_crc32", F.size("ids")).drop("ids_crc32")
        (encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
            .option("orc.create.index", "true").option("orc.row.index.stride", "2000").option("orc.stripe.size", str(stripe_mb << 20)).option("compression", compress.lower()).orc(target))


def read_orc(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, ids) of the files; filters on doc_id, of type ``kind``, skip stripes and row groups by index and Bloom filter."""
    return spark.read.schema(f"doc_id {kind}, ids array<int>").orc(path)


def document_index(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Per document of the files below ``path``: start, n_tokens and the crc32 of its ids.

    The files follow one another in doc_id order, so ``start`` is a prefix sum in two levels: over
    the files, of which only the totals meet, and within each file, in the order of write_orc. The
    files are read at the call, BATCH_ROWS rows at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            n = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _checksums(ids), batch.column(2)], names=["doc_id", "n_tokens", "ids_crc32", "_file"])

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("_file")
    rows = read_orc(spark, path, kind).select("doc_id", "ids", part).mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, _file int")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        rows = written(rows, "orc-index")  # the ids are read once, and the digests by both branches below
    totals = rows.groupBy("_file").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("_file", (F.sum("n").over(Window.orderBy("_file")) - F.col("n")).alias("_before"))
    order = Window.partitionBy("_file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_upto", F.sum("n_tokens").over(order)).join(totals, "_file")
    return placed.select("doc_id", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op2_orc_tokens(spark, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``documents``, read back from the ORC files; end id 2."""
    import public_tokenizers

    target = shared_path(spark, "orc-tokens")
    write_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, public_tokenizers.path("word_bpe_49k.json"))
    return document_index(spark, target)
