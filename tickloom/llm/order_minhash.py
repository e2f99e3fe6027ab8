"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its windows of five words, each labelled by how often it came before in the
text. For each of SKETCHES hash functions the ORDERED least k-mers are put back in text order and
hashed together. Two texts agree on such a sketch when they share those k-mers in the same order,
which is likely in proportion to their edit similarity. Texts that agree on one are candidates; a
banded alignment of their words decides. Where many texts agree on a sketch and are not one class,
bounds that lose no pair choose which of them are aligned.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, U64, Scratch, mix, row_chunks, shingles, text_buffers, word_hashes
from .graph import components

#: Two of 100 words with 20 scattered substitutions (0.8) agree on one of 80 sketches of 2 ordered k-mers with a chance of 0.92.
WORDS, SKETCHES, ORDERED, SIMILARITY = 5, 80, 2, 0.8
#: Texts of at most SHORT words meet by what is left when words are deleted, those of at most BRIEF also by sketches of shorter k-mers.
SHORT, BRIEF, BRIEF_WORDS, BRIEF_SKETCHES = 15, 40, 3, 48
#: Rounds in which each bucket's texts are aligned with one of them.
ROUNDS = 2
#: Bits of the bitmap that bounds from below in how many words two texts differ: a power of two, twice as many as words, within these.
LEAST_BITS, MOST_BITS = 256, 16_384
MISSING = U64(0xFFFFFFFFFFFFFFFF)


def _sketch(words: np.ndarray, starts: np.ndarray, k: int, sketches: int, ordered: int) -> np.ndarray:
    """One row of sketches for each row of words; zeros for a row without words."""
    grams, at = shingles(words, starts, k)
    n = np.diff(at)
    out = np.zeros((len(n), sketches), U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begin, n = at[:-1][some], n[some]
    row = np.repeat(np.arange(len(some)), n)
    keyed = grams ^ mix(row.astype(U64) + BASE)
    order = np.argsort(keyed, kind="stable")
    same = np.concatenate([[False], keyed[order][1:] == keyed[order][:-1]])
    place = np.arange(len(order))
    label = np.empty(len(order), U64)  # how often a k-mer came before in its text
    label[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    grams = mix(grams + label * BASE)
    for t in range(sketches):
        h = (grams ^ mix(np.array([t + 1], U64) * BASE)) * U64(0xD1342543DE82EF95)
        h ^= h >> U64(31)
        found = np.zeros((ordered, len(some)), np.int64)
        for i in range(ordered):
            least = np.minimum.reduceat(h, begin)
            hits = np.flatnonzero(h == np.repeat(least, n))
            first = hits[np.searchsorted(hits, begin)]
            found[i] = np.where(n > i, first, -1)
            h[first] = MISSING
        found.sort(axis=0)  # text order
        value = np.full(len(some), U64(t))
        for i in range(ordered):
            value = value * BASE + np.where(found[i] >= 0, grams[np.maximum(found[i], 0)], U64(0))
        out[some, t] = mix(value)
    return out


def _left_over(words: np.ndarray, least: float) -> np.ndarray:
    """A row of names for each row of ``words``: of the words that are left when each few of them are deleted.

    So many are deleted as may be unaligned. Two texts that align to ``least`` have their aligned words in common, which
    are what is left of both; and texts that have a name in common align to it.
    """
    n = words.shape[1]
    out = []
    for gone in range(int(n * (1 - least) + 1e-9) + 1):
        kept = np.array(list(itertools.combinations(range(n), n - gone)), np.int64)
        value = np.full((len(words), len(kept)), U64(n - gone))
        for i in range(n - gone):
            value = value * BASE + words[:, kept[:, i]]
        out.append(mix(value + BASE))
    return np.concatenate(out, axis=1)


def _cells(words: np.ndarray, starts: np.ndarray, k: int, count: int, ordered: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """What each row meets others by, and how many of them: sketches, and for short rows more."""
    n = np.diff(starts)
    parts = [(np.repeat(np.arange(len(n)), count), _sketch(words, starts, k, count, ordered).ravel())]
    brief = np.flatnonzero((n > 0) & (n <= BRIEF))
    if len(brief):
        own = np.concatenate([words[starts[i] : starts[i + 1]] for i in brief])
        few = _sketch(own, np.concatenate([[0], np.cumsum(n[brief])]), BRIEF_WORDS, BRIEF_SKETCHES, ordered)
        parts.append((np.repeat(brief, BRIEF_SKETCHES), mix(few + BASE).ravel()))
    for size in range(1, SHORT + 1):
        rows = np.flatnonzero(n == size)
        for low in range(0, len(rows), 256):
            some = rows[low : low + 256]
            names = _left_over(words[starts[some][:, None] + np.arange(size)[None, :]], least)
            parts.append((np.repeat(some, names.shape[1]), names.ravel()))
    row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return value[order], np.bincount(row, minlength=len(n))


def sketches(docs: DataFrame, k: int = WORDS, count: int = SKETCHES, ordered: int = ORDERED, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, same, n, sketch) of every row: a digest of its words, how many, and what it meets others by; no words, no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(pc.utf8_lower(batch.column(1)))
            for low, high in row_chunks(offsets):
                words, starts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                cells, sizes = _cells(words, starts, k, count, ordered, least)
                n = np.diff(starts)
                digest = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(cells.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(digest, pa.string()), pa.array(n.astype(np.int32)), values], names=["doc_id", "same", "n", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, same string, n int, sketch array<bigint>")


def _words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): 32-bit hashes of the words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(pc.utf8_lower(batch.column(1)))
            for low, high in row_chunks(offsets):
                words, starts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                words = (words >> U64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([words[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(run, "doc_id bigint, words binary")


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned words over the longer text's words, in the best alignment within the band that ``least`` leaves; 0 if below ``least``.

    For that many words to align, no aligned pair can lie further off the diagonal than the longer
    text has words over. Rows of the band are the bits of one integer.
    """
    na, nb = len(a), len(b)
    n, short = max(na, nb), min(na, nb)
    if not n or short < least * n:
        return 0.0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    common = head + tail
    a, b = a[head : na - tail], b[head : nb - tail]
    enough = least * n
    if len(a) and len(b):
        if enough > common:  # no alignment has more pairs than the texts have words in common
            x, nx = np.unique(a, return_counts=True)
            y, ny = np.unique(b, return_counts=True)
            where = np.minimum(np.searchsorted(x, y), len(x) - 1)
            if np.minimum(nx[where], ny)[x[where] == y].sum() < enough - common - 1e-9:
                return 0.0
        band = int(n - enough) + 1
        at: dict[int, int] = {}
        for j, w in enumerate(a.tolist()):
            at[w] = at.get(w, 0) | 1 << j
        full = (1 << len(a)) - 1
        row, window = full, (1 << (2 * band + 1)) - 1
        for i, w in enumerate(b.tolist()):
            hit = at.get(w)
            if hit:
                hit &= window << (i - band) if i >= band else window >> (band - i)
                u = row & hit
                row = ((row + u) | (row - u)) & full
        common += len(a) - row.bit_count()
    return common / n if common >= enough - 1e-9 else 0.0


def verify(pairs: DataFrame, words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs`` whose texts ``a`` and ``b`` align; any other columns go with them."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [aligned(np.frombuffer(p.as_py(), "<u4"), np.frombuffer(q.as_py(), "<u4"), least) > 0 for p, q in zip(x, y, strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    left = words.select(F.col("doc_id").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("doc_id").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(*names, "x", "y").mapInArrow(run, pairs.schema)


def _fits(n: str, m: str, least: float) -> Column:
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, k: int = WORDS, count: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest doc_id among the texts it is linked to.

    Words are runs of letters and digits in lower case; texts of equal words are one class. Two
    texts are linked if they agree on a sketch and the words that align are at least ``least`` of the
    longer text's. Texts of at most SHORT words that align so always meet. Rows without words (null and empty texts too) and
    rows without doc_id are a class by themselves. Rows that share a doc_id are one document: the
    classes of their texts are one.

    Copies fall together first. Then, in ROUNDS rounds, the texts of each bucket of a sketch are
    aligned with one text of the bucket, unless they are linked to it already: first with the one that
    meets most others, which in a group of copies is close to what they were copied from. Texts of
    buckets that are still not one class are compared within their buckets by ``may_align``, which
    loses no pair, and aligned. Nothing depends on how many texts a bucket has.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession, "order-minhash")
    all_rows = scratch.write(sketches(rows, k, count, ordered, least))
    with_words = all_rows.where("doc_id IS NOT NULL AND same IS NOT NULL")
    texts = with_words.groupBy("same").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("t")).select("same", "t.*")
    cells = texts.select("doc_id", "n", F.explode("sketch").alias("s"))
    several = cells.groupBy("s").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = F.sum("size").over(Window.partitionBy("doc_id"))  # a window of one text's rows, some hundreds at most
    members = scratch.write(cells.join(several, "s").withColumn("met", met).drop("size"))
    words = scratch.write(_words(rows.join(members.select("doc_id").distinct(), "doc_id", "left_semi")))

    links = [_one_document(with_words, texts)]
    now = members.withColumn("root", F.col("doc_id"))
    for i in range(ROUNDS):
        found = scratch.write(verify(_lead(now, least, i), words, least))
        links.append(found.select("a", "b"))
        before, now = now, scratch.write(_still_apart(now, found))
        scratch.drop(before if i else members)
    pairs = scratch.write(may_align(now, words, least))
    links.append(verify(pairs, words, least).select("a", "b"))
    roots = components(functools.reduce(DataFrame.unionAll, links)).withColumnRenamed("node", "rep")
    classes = texts.select("same", F.col("doc_id").alias("rep")).join(roots, "rep", "left").select("same", F.coalesce("root", "rep").alias("class_id"))
    found = all_rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(classes, "same", "left")
    out = scratch.write(found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))
    scratch.drop(all_rows, words, now, pairs)
    return out


def _one_document(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the first documents of the texts of a doc_id that has several."""
    several = rows.groupBy("doc_id").agg(F.min("same").alias("one"), F.max("same").alias("other")).where("one <> other").select("doc_id", F.col("one"))
    both = rows.join(several, "doc_id").select("one", "same").where("one <> same").distinct()
    first = texts.select(F.col("same").alias("one"), F.col("doc_id").alias("a"))
    return both.join(first, "one").join(texts.select("same", F.col("doc_id").alias("b")), "same").select("a", "b")


def _lead(cells: DataFrame, least: float, turn: int) -> DataFrame:
    """(a, ra, b, rb): the texts of each bucket with the bucket's leader, and their roots, if they are not linked yet.

    The leader is the text that meets most others, and in later turns one by a hash.
    """
    rank = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("met")
    lead = cells.groupBy("s").agg(F.max(F.struct(rank.alias("rank"), "doc_id", "n", "root")).alias("lead"))
    pairs = cells.join(lead, "s").where("root <> lead.root").where(_fits("n", "lead.n", least))
    one, two = F.struct("doc_id", "root"), F.struct("lead.doc_id", "lead.root")
    pairs = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return pairs.select(F.col("x.doc_id").alias("a"), F.col("x.root").alias("ra"), F.col("y.doc_id").alias("b"), F.col("y.root").alias("rb"))


def _still_apart(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells of the buckets that hold several components, with their roots after ``links`` between earlier roots."""
    roots = components(links, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("under"))
    rooted = cells.join(roots, "root", "left").withColumn("root", F.coalesce("under", "root")).drop("under")
    apart = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
    return rooted.join(apart, "s")


def _bitmaps(words: DataFrame) -> DataFrame:
    """(doc_id, n, map, half): how many words a text has, a bitmap of them, and the one of half as many bits.

    Each word, with how often it came before, flips one bit. So the bits in which two bitmaps differ
    are no more than the words, occurrences counted, that only one of the texts has. A bitmap's upper half
    laid over its lower one is the bitmap of half as many bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps, halves = [], [], []
            for text in batch.column("words"):
                w = np.sort(np.frombuffer(text.as_py(), "<u4")).astype(U64)
                place = np.arange(len(w))
                first = np.where(np.concatenate([[True], w[1:] != w[:-1]]), place, 0)[: len(w)]
                value = mix(w * BASE + (place - np.maximum.accumulate(first)).astype(U64))
                bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(w) - 1).bit_length())) if len(w) else LEAST_BITS
                odd = np.packbits((np.bincount((value % U64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).view("<i8")
                counts.append(len(w))
                maps.append(odd)
                halves.append(odd[: len(odd) // 2] ^ odd[len(odd) // 2 :])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(maps, kind), pa.array(halves, kind)], names=["doc_id", "n", "map", "half"])

    return words.select("doc_id", "words").mapInArrow(run, "doc_id bigint, n int, map array<bigint>, half array<bigint>")


def may_align(cells: DataFrame, words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): the texts of one bucket of ``cells`` (s, doc_id, met, root) with different roots that may align to ``least``.

    Words that align are common to both, and at least ``least`` of the longer text's. So lengths
    bound the pairs, and bitmaps differ in at most all words but twice as many bits; neither
    loses one. Texts whose lengths fit have bitmaps of equal size, or one of twice the other's. In each bucket only
    texts outside the class of the one that meets most look for others, so a large class costs no pairs within itself.
    Texts that share several buckets are a pair in the first of them alone.
    """
    own = cells.groupBy("doc_id").agg(F.collect_list("s").alias("own"))
    marked = cells.select("s", "doc_id", "root").join(_bitmaps(words.join(own.select("doc_id"), "doc_id", "left_semi")), "doc_id").join(own, "doc_id")
    marked = marked.withColumn("own", F.filter("own", lambda x: x < F.col("s")))
    base = cells.groupBy("s").agg(F.max_by("root", F.struct("met", "doc_id")).alias("base"))
    all_texts = marked.join(base, "s")
    one, two = all_texts.where("root <> base").alias("one"), all_texts.alias("two")
    once = (F.col("two.root") == F.col("two.base")) | (F.col("one.doc_id") < F.col("two.doc_id"))
    size = lambda c: F.size(f"{c}.map")
    x = F.when(size("one") > size("two"), F.col("one.half")).otherwise(F.col("one.map"))
    y = F.when(size("two") > size("one"), F.col("two.half")).otherwise(F.col("two.map"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    near = differ <= F.col("one.n") + F.col("two.n") - F.lit(2 * least) * F.greatest("one.n", "two.n") + F.lit(1e-6)
    pairs = one.join(two, (F.col("one.s") == F.col("two.s")) & (F.col("one.root") != F.col("two.root")) & once & _fits("one.n", "two.n", least) & near & ~F.arrays_overlap("one.own", "two.own"))
    return pairs.select(F.least("one.doc_id", "two.doc_id").alias("a"), F.greatest("one.doc_id", "two.doc_id").alias("b")).distinct()


def op1_order_minhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, class_id) of every row of ``documents``, with five-word k-mers and a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
