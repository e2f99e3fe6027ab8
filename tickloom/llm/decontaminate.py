"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman alignment scores the pairs.

Of every stretch of an item the n-gram that fewest texts have is a seed. Seeds and items are tables of any size: the
n-grams of texts that may be seeds, told by a bitmap of bounded size, are joined to them, and each text and item that meet
are aligned around the places where they do, unless too few of the item's words are there for any alignment to count.
Equal texts are taken once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, parts, row_chunks, shingles, text_buffers, word_hashes

SEED = 3  # words of a seed
#: An item is found if its alignment (+1 a match, -1 a mismatch or gap) reaches this share of its words, and LEAST_SCORE or all of them.
THRESHOLD, LEAST_SCORE = 0.5, 8
#: N-grams in a stretch of an item at most; fewer in short items, so that all have this many seeds as far as they go.
STRETCH, LEAST_SEEDS = 4, 8
#: Bits of a bitmap of n-grams, a power of two.
BITS = 1 << 26
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of ``item`` in ``words``, and the first and last aligned word of ``words``.

    A cell takes the best of a match or mismatch, a gap in either text, or a new start; gaps along
    a row are a running maximum.
    """
    n = len(words)
    steps = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), steps.copy()  # where each cell's alignment began
    best = (0, 0, 0)
    for w in item.tolist():
        hit = np.where(words == w, 1, -1)
        new, start = np.zeros(n + 1, np.int64), steps.copy()
        diagonal = row[:-1] + hit
        up = row[1:] - 1
        take_up = up > diagonal
        value = np.where(take_up, up, diagonal)
        where = np.where(take_up, begin[1:], begin[:-1])
        keep = value > 0
        new[1:][keep], start[1:][keep] = value[keep], where[keep]
        reach = np.maximum.accumulate(new + steps)
        left = reach - steps
        longer = left > new
        if longer.any():
            source = np.maximum.accumulate(np.where(new + steps == reach, steps, 0))
            start[longer] = start[source[longer]]
            new = np.maximum(new, left)
        row, begin = new, start
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at - 1)
    return best


class Bitmap:
    """Tells of most n-grams that they aren't in a set; those it doesn't may be."""

    def __init__(self, grams: DataFrame):
        """Of ``gram``; a number for each 64 bits of which one is set is collected, BITS / 64 at most."""
        self.shift = 64 - BITS.bit_length() + 1
        place = F.shiftrightunsigned("gram", self.shift)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {self.shift}) & 63 as int))")
        rows = grams.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.words = np.zeros(max(1, BITS >> 6), U64)
        self.words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(U64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Indexes into ``grams`` of those that may be in the set."""
        place = grams >> U64(self.shift)
        return np.flatnonzero(self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1))


def _text_grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(pc.utf8_lower(column))
    for low, high in row_chunks(offsets):
        words, starts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        yield (low, high, words, starts, *shingles(words, starts, SEED))


def _item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words, grams): word hashes of each item that has an n-gram, and its n-grams in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words, starts, grams, at in _text_grams(batch.column("text")):
                long = np.flatnonzero(np.diff(starts) >= SEED)
                own = [[x[a[i] : a[i + 1]].view(np.int64) for i in long] for x, a in ((words, starts), (grams, at))]
                kind = pa.list_(pa.int64())
                some = batch.slice(low, high - low).take(pa.array(long))
                yield pa.RecordBatch.from_arrays([some.column("item"), some.column("item_id"), pa.array(own[0], kind), pa.array(own[1], kind)], names=["item", "item_id", "words", "grams"])

    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(run, "item bigint, item_id bigint, words array<bigint>, grams array<bigint>")


def _counts(texts: DataFrame, known: Bitmap) -> DataFrame:
    """(gram, n): in how many texts each n-gram is that may be known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, grams, at in _text_grams(batch.column("text")):
                hits = known.find(grams)
                doc = np.searchsorted(at, hits, "right") - 1
                both = np.unique(np.stack([grams[hits], doc.astype(U64)]), axis=1)[0] if len(hits) else grams[:0]
                gram, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _hits(texts: DataFrame, known: Bitmap) -> DataFrame:
    """(digest, text, hits) of texts with n-grams that may be known: each with its place. A text that a batch has twice is taken once."""
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(np.array(batch.column("digest").to_pylist(), object), return_index=True) if batch.num_rows else (None, np.zeros(0, np.int64))
            batch = batch.take(pa.array(np.sort(first)))
            for low, _, _, _, grams, at in _text_grams(batch.column("text")):
                hits = known.find(grams)
                doc = np.searchsorted(at, hits, "right") - 1
                some, sizes = np.unique(doc, return_counts=True)
                pairs = pa.StructArray.from_arrays([pa.array(grams[hits].view(np.int64)), pa.array((hits - at[doc]).astype(np.int64))], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)
                rows = batch.take(pa.array(low + some))
                yield pa.RecordBatch.from_arrays([rows.column("digest"), rows.column("text"), lists], names=["digest", "text", "hits"])

    return texts.mapInArrow(run, "digest binary, text string, hits array<struct<gram:bigint,at:bigint>>")


def _align(item: np.ndarray, words: np.ndarray, begins: np.ndarray) -> tuple[float, int, int] | None:
    """(share, first word, last word) of the best alignment of an item around the places where it may begin, if it counts."""
    m = len(item)
    need = max(THRESHOLD * m, min(LEAST_SCORE, m))
    best = None
    for group in np.split(begins, np.flatnonzero(np.diff(begins) > m) + 1):
        a, b = max(int(group[0]) - m // 2, 0), min(int(group[-1]) + m + m // 2 + 1, len(words))
        if np.isin(item, words[a:b]).sum() < need:  # a score is no more than the words that match
            continue
        score, first, last = smith_waterman(item, words[a:b])
        if score >= need and (best is None or score > best[0]):
            best = (score, a + first, a + last)
    return best and (best[0] / m, best[1], best[2])


def _aligned(pairs: DataFrame) -> DataFrame:
    """(digest, leak) of the pairs of text and item that align; rows of one text follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = None, None
        for batch in batches:
            out = []
            columns = {c: batch.column(c) for c in ("digest", "text", "item_id", "words", "begins")}
            for i in range(batch.num_rows):
                digest = columns["digest"][i].as_py()
                if digest != own:
                    own, (_, _, words, *_) = digest, next(iter(_text_grams(columns["text"].slice(i, 1))))
                begins = np.unique(columns["begins"][i].values.to_numpy())
                if found := _align(columns["words"][i].values.to_numpy().view(U64), words, begins):
                    out.append((digest, dict(zip(("item_id", "score", "first_word", "last_word"), (columns["item_id"][i].as_py(), *found), strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([x for _, x in out], ARROW_LEAK.value_type)], names=["digest", "leak"])

    near = pairs.repartition(parts(pairs.sparkSession), "digest", "item").sortWithinPartitions("digest")
    return near.select("digest", "text", "item_id", "words", "begins").mapInArrow(run, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("leak", LEAK.elementType)]))


def _digest() -> Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def seeds(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item, gram, place): of every stretch of an item's n-grams the one that fewest of the texts have, if any has one."""
    size = F.greatest(F.lit(1), F.least(F.lit(STRETCH), F.call_function("div", F.size("grams"), F.lit(LEAST_SEEDS))))
    grams = items.select("item", size.alias("stretch"), F.posexplode("grams").alias("place", "gram"))
    distinct = grams.select("gram").distinct()
    counts = _counts(texts, Bitmap(distinct)).join(distinct, "gram", "left_semi")
    rarest = Window.partitionBy("item", F.call_function("div", F.col("place"), F.col("stretch"))).orderBy("n", "place")
    return grams.join(counts, "gram").withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select("item", "gram", "place")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, leaks) of each different text that holds an item; ``digest`` names a text by its first 128 bits of SHA-256."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select(_digest().alias("digest"), "text").where("text <> ''")
    known = scratch.write(_item_words(items))
    seed = scratch.write(seeds(texts, known))
    found = scratch.write(_hits(texts, Bitmap(seed.select("gram").distinct())))
    hits = found.select("digest", F.inline("hits")).join(seed, "gram").select("digest", "item", (F.col("at") - F.col("place")).alias("begin")).distinct()
    met = scratch.write(hits.groupBy("digest", "item").agg(F.collect_list("begin").alias("begins")))
    own = found.select("digest", "text").join(met.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    pairs = met.join(known.select("item", "item_id", "words"), "item").join(own, "digest")
    return _aligned(pairs).groupBy("digest").agg(F.array_sort(F.collect_list("leak")).alias("leaks"))


def with_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``: the items found in each text, with score and the words of the text that align.

    ``items`` has item_id and text; items of fewer than SEED words, without id or of null text are never found; of items that
    share an id each is found for itself. A score is 1 for a whole copy. Null and empty texts have no leaks; rows are
    judged each by itself, equal texts alike; all other columns are kept, but for one named ``leaks``, which is replaced.
    An item with an edit in every few words may have no seed in a text.
    """
    found = leaks(docs, items).withColumnRenamed("digest", "_digest").withColumnRenamed("leaks", "_leaks")
    docs = docs.drop("leaks")
    out = docs.withColumn("_digest", _digest()).join(found, "_digest", "left")
    return out.select(*docs.columns, F.coalesce("_leaks", F.array().cast(LEAK)).alias("leaks"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, see ``with_leaks``."""
    held = leaks(docs, items).select(F.col("digest").alias("_digest"))
    return docs.withColumn("_digest", _digest()).join(held, "_digest", "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): every document that holds a test item, and which."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
