"""Ranked lexical search: an inverted index in compressed posting blocks, searched by Block-Max WAND."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import Scratch, row_chunks, shared_path, text_buffers
from .terms import ALNUM, beginnings, counted

#: Bytes of text in one segment of the index. A segment has its own document numbers and posting lists.
SEGMENT = 16 << 20
#: Postings in a block.
BLOCK = 128
#: Items that meet a segment's postings in one group.
QUERIES = 512
#: One segment in so many is searched first, for thresholds that hold everywhere.
PRIME = 16
#: Document numbers that a run of windows may cover before the threshold is taken anew.
RUN = 1024


class Scoring:
    """Whole-number BM25: the part of a score that a posting gives before its term's weight."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, max(1, terms)

    def impacts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        counts, lengths = counts.astype(np.int64), lengths.astype(np.int64)
        norm = 50 + 50 * lengths * self.documents // self.terms
        return 1_000_000_000 * counts // (1000 * counts + 20 * norm)


def weight(documents: int, df: Column) -> Column:
    """``floor(1000 ln((2 N + 2) / (2 df + 1)))`` in doubles."""
    return F.floor(F.lit(1000.0) * F.ln((F.lit(2.0 * documents + 2.0)) / (F.lit(2.0) * df.cast("double") + F.lit(1.0)))).cast("bigint")


def terms(text: Column) -> Column:
    """The distinct terms of a text, A-Z lower-cased; none if it is null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        documents = total = 0
        for low, high in row_chunks(offsets, SEGMENT):
            first = beginnings(ALNUM[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
            found = np.diff(np.concatenate([[0], np.cumsum(first, dtype=np.int32)])[offsets[low : high + 1] - offsets[low]])
            documents, total = documents + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [total]})


def scoring(docs: DataFrame, text: str = "text") -> Scoring:
    """Documents with a term, and terms with repeats, over all of ``docs``."""
    sums = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_sizes, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return Scoring(sums[0] or 0, sums[1] or 0)


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the fewest whole bytes that hold the largest value."""
    top = int(values.max())
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def pack(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """One block of ascending document numbers and their counts: the first number apart, the others as gaps.

    Each array is kept in as few whole bytes an entry as its largest needs; two bytes before them say how many.
    """
    gaps, counts = _narrow(np.diff(numbers, prepend=numbers[:1])), _narrow(counts)
    return bytes((gaps.itemsize, counts.itemsize)) + gaps.tobytes() + counts.tobytes()


def unpack(payload: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a block whose first document number is ``first``."""
    a, b = payload[0], payload[1]
    n = (len(payload) - 2) // (a + b)
    gaps = np.frombuffer(payload, f"<u{a}", n, 2)
    return first + np.cumsum(gaps, dtype=np.int64), np.frombuffer(payload, f"<u{b}", n, 2 + n * a).astype(np.int64)


#: The blocks of a single posting, by its count.
ALONE = [bytes((1, 1, 0, c)) for c in range(256)]
INDEX = "segment bigint, term string, df bigint, firsts array<int>, lasts array<int>, maxima array<bigint>, blocks array<binary>, lengths array<int>, ids array<{id}>"


def _index_rows(segment: int, score: Scoring, lengths: np.ndarray, codes: np.ndarray, rows: np.ndarray, counts: np.ndarray, dictionary: pa.Array, ids: pa.Array, schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """One row for the documents of a segment (its term is null), and one for each of its terms."""
    lists = lambda values, sizes, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))
    none = lambda n: [pa.nulls(n, schema.field(i).type) for i in range(len(schema))]
    head = none(1)
    head[0], head[7] = pa.array([segment], pa.int64()), lists(lengths.astype(np.int32), [len(lengths)], pa.int32())
    head[8] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(head, schema, strict=True)], schema=schema)
    if not len(codes):
        return
    impact = score.impacts(counts, lengths[rows])
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    df = np.diff(np.append(starts, len(codes)))
    n_blocks = (df + size - 1) // size
    within = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = np.repeat(starts, n_blocks) + within * size
    high = np.minimum(low + size, np.repeat(starts + df, n_blocks))
    maxima = np.maximum.reduceat(impact, low)
    payloads = [ALONE[c] if b - a == 1 and c < 256 else pack(rows[a:b], counts[a:b]) for a, b, c in zip(low.tolist(), high.tolist(), counts[low].tolist(), strict=True)]
    of = none(len(starts))
    of[0], of[1], of[2] = pa.array(np.full(len(starts), segment)), dictionary.take(pa.array(codes[starts])), pa.array(df.astype(np.int64))
    of[3], of[4], of[5], of[6] = (lists(v, n_blocks, t) for v, t in ((rows[low].astype(np.int32), pa.int32()), (rows[high - 1].astype(np.int32), pa.int32()), (maxima, pa.int64()), (payloads, pa.binary())))
    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(of, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, score: Scoring, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of every term of every row: a row for each segment and term, and one for a segment's documents.

    Nothing is shuffled: a task makes segments of the rows it reads, a number of bytes of text each. A
    block's largest impact stands beside it, so a search can pass over it without unpacking it.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ddl = INDEX.format(id=kind)
    schema, size, block = to_arrow_schema(_parse_datatype_string(ddl)), SEGMENT, BLOCK

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high, *found in counted(batch.column(1), ALNUM, size):
                yield from _index_rows(segment, score, *found, batch.column(0).slice(low, high - low), schema, block)
                segment += 1

    return rows.mapInArrow(segments, ddl)


class Postings:
    """The blocks of one term in one segment; a block is unpacked when a search first needs it."""

    def __init__(self, firsts: np.ndarray, lasts: np.ndarray, maxima: np.ndarray, blocks: pa.Array, df: int, weight: int, size: int):
        self.size = size
        self.firsts, self.lasts, self.maxima, self.blocks, self.weight = firsts, lasts, maxima * weight, blocks, weight
        self.numbers, self.scores = np.zeros(df, np.int32), np.zeros(df, np.int64)
        self.open = np.zeros(len(firsts), bool)

    def between(self, low: int, high: int, lengths: np.ndarray, score: Scoring) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the documents from ``low`` to ``high``, without ``high``."""
        a, b = int(np.searchsorted(self.lasts, low)), int(np.searchsorted(self.firsts, high))
        if a >= b:
            return self.numbers[:0], self.scores[:0]
        for i in range(a, b):
            if not self.open[i]:
                numbers, counts = unpack(self.blocks[i].as_py(), int(self.firsts[i]))
                at = slice(i * self.size, i * self.size + len(numbers))
                self.numbers[at], self.scores[at] = numbers, self.weight * score.impacts(counts, lengths[numbers])
                self.open[i] = True
        at = slice(a * self.size, min(b * self.size, len(self.numbers)))
        x, y = np.searchsorted(self.numbers[at], (low, high))
        return self.numbers[at][x:y], self.scores[at][x:y]


class Best:
    """The ``k`` best documents so far, by score and then by ``order``; ``least`` is what another one must reach."""

    def __init__(self, k: int, order: np.ndarray, least: int):
        self.k, self.order, self.least = k, order, max(1, least)
        self.numbers, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, numbers: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least
        if not some.any():
            return
        self.numbers, self.scores = np.concatenate([self.numbers, numbers[some]]), np.concatenate([self.scores, scores[some]])
        if len(self.numbers) > self.k:
            best = np.lexsort((self.order[self.numbers], -self.scores))[: self.k]
            self.numbers, self.scores = self.numbers[best], self.scores[best]
            self.least = max(self.least, int(self.scores[-1]))


def block_max_wand(lists: list[Postings], lengths: np.ndarray, order: np.ndarray, score: Scoring, k: int, least: int = 1, run: int = RUN) -> Best:
    """The ``k`` best documents of a segment for a query's terms.

    The blocks' first and last documents cut the segment into windows in which the sum of the largest impacts
    is one number. Pointers move from window to window by these sums alone; the next pivot is the first window
    whose sum reaches the threshold. Only there are blocks unpacked and documents scored. Without a threshold to
    start with, the windows with the largest sums come first, until ``k`` documents are known.
    """
    best = Best(k, order, least)
    edges = np.concatenate([x for p in lists for x in (p.firsts, p.lasts + 1)])
    step = np.concatenate([x for p in lists for x in (p.maxima, -p.maxima)])
    cuts, place = np.unique(edges, return_inverse=True)
    bound = np.zeros(len(cuts), np.int64)
    np.add.at(bound, place, step)
    bound = np.cumsum(bound)[:-1]
    done = np.zeros(len(bound), bool)

    def look(a: int, b: int) -> None:
        low, high = int(cuts[a]), int(cuts[b])
        sums = np.zeros(high - low, np.int64)
        for p in lists:
            numbers, scores = p.between(low, high, lengths, score)
            sums[numbers - low] += scores
        hit = np.flatnonzero(sums)
        best.add(hit + low, sums[hit])
        done[a:b] = True

    for w in np.argsort(-bound, kind="stable").tolist() if least <= 1 else ():
        if len(best.numbers) >= k or bound[w] < best.least:
            break
        look(w, w + 1)
    w, n = 0, len(bound)
    while w < n:
        reach = (bound[w:] >= best.least) & ~done[w:]
        pivot = int(np.argmax(reach))
        if not reach[pivot]:
            break
        w, stop = w + pivot, w + pivot + 1
        while stop < n and bound[stop] >= best.least and not done[stop] and cuts[stop + 1] - cuts[w] <= run:
            stop += 1
        look(w, stop)
        w = stop
    return best


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each row's values start among them."""
    column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _found(table: pa.Table, score: Scoring, k: int, schema: pa.Schema, size: int, run: int) -> pa.Table:
    """(item, id, score): the best documents of one segment for each item of one block of queries."""
    empty = pa.Table.from_batches([], schema)
    head, rows = table.filter(pc.is_null(table.column("term"))), table.filter(pc.is_valid(table.column("term")))
    if not len(rows) or not len(head):
        return empty
    lengths = _lists(head.column("lengths"))[0].to_numpy()
    ids = _lists(head.column("ids"))[0]
    order = np.empty(len(ids), np.int64)
    order[pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy()] = np.arange(len(ids))
    (firsts, at), lasts, maxima, blocks = _lists(rows.column("firsts")), *(_lists(rows.column(c))[0] for c in ("lasts", "maxima", "blocks"))
    firsts, lasts, maxima = (x.to_numpy() for x in (firsts, lasts, maxima))
    weights, df = rows.column("weight").to_pylist(), rows.column("df").to_pylist()
    postings = [Postings(firsts[a:b], lasts[a:b], maxima[a:b], blocks.slice(a, b - a), n, w, size) for a, b, n, w in zip(at[:-1].tolist(), at[1:].tolist(), df, weights, strict=True)]
    asked, at = _lists(rows.column("items"))
    term_of = np.repeat(np.arange(len(rows)), np.diff(at))
    items = asked.field("item").dictionary_encode(null_encoding="encode")
    codes, least = items.indices.to_numpy(), asked.field("least").to_numpy()
    by_item = np.argsort(codes, kind="stable")
    out = []
    for each in np.split(by_item, np.flatnonzero(np.diff(codes[by_item])) + 1):
        best = block_max_wand([postings[t] for t in term_of[each]], lengths, order, score, k, int(least[each[0]]), run)
        out.append((np.full(len(best.numbers), codes[each[0]]), best.numbers, best.scores))
    code, number, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.Table.from_arrays([items.dictionary.take(pa.array(code)).cast(schema.field(0).type), ids.take(pa.array(number)).cast(schema.field(1).type), pa.array(scores, pa.int64())], schema=schema)


def _by_segment(index: DataFrame, asked: DataFrame, blocks: int, score: Scoring, k: int) -> DataFrame:
    """(item, id, score) of each segment's best documents; ``asked``: (qblock, term, weight, items)."""
    hits = index.where("term IS NOT NULL").join(asked, "term").drop("lengths", "ids", "prime")
    heads = index.where("term IS NULL").select("segment", "lengths", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qblock"))
    ddl = f"item {asked.schema['items'].dataType.elementType['item'].dataType.simpleString()}, id {index.schema['ids'].dataType.elementType.simpleString()}, score bigint"
    schema, size, run = to_arrow_schema(_parse_datatype_string(ddl)), BLOCK, RUN
    return hits.unionByName(heads, allowMissingColumns=True).groupBy("segment", "qblock").applyInArrow(lambda table: _found(table, score, k, schema, size, run), ddl)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, score: Scoring, k: int = 50, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for each item, equal scores by ascending id.

    ``index``: what ``build_index`` gives, with a column ``prime``, as a written table. Items meet the postings of
    their terms by a join on the term, in blocks of items. The segments marked ``prime`` are searched first: the
    score of an item's last document there is a threshold that every other segment starts with. It drops no document
    that could be among the ``k``, as the others only raise it.

    Rows that share an item_id are one item with the terms of all their texts. Items without a term that some
    document has give no row.
    """
    scratch = Scratch(queries.sparkSession, "search")
    items = queries.select(F.col(f"`{item_id}`").alias("item"), F.explode(terms(F.col(f"`{text}`").cast("string"))).alias("term")).distinct()
    blocks = -(-items.select("item").distinct().count() // QUERIES) or 1
    df = index.where("term IS NOT NULL").select("term", "df").join(items.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("all"))
    items = scratch.write(items.join(df, "term").select("item", "term", weight(score.documents, F.col("all")).alias("weight"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("qblock")))

    def asked(rows: DataFrame) -> DataFrame:
        return scratch.write(rows.groupBy("qblock", "term", "weight").agg(F.collect_list(F.struct("item", "least")).alias("items")))

    first = scratch.write(_by_segment(index.where("prime"), asked(items.withColumn("least", F.lit(1).cast("bigint"))), blocks, score, k))
    least = _top(first, k).where(F.col("rank") == k).select(F.col("item").alias("_item"), F.col("score").alias("least"))
    rest = items.join(least, F.col("item").eqNullSafe(F.col("_item")), "left").withColumn("least", F.coalesce("least", F.lit(1).cast("bigint")))
    found = first.unionByName(_by_segment(index.where("NOT prime"), asked(rest), blocks, score, k))
    return _top(found, k).select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Index ``docs`` and search it: (item_id, rank, doc_id, score), see ``search``; both tables have the text in ``text``.

    Every row of ``docs`` is a document of its own: rows that share a doc_id are ranked each, rows without one come
    last among equal scores. Null and empty texts have no terms, so they are no documents of the statistics and are
    never found. A very long text is a segment alone. Other columns are ignored. An empty table on either side gives
    no rows.
    """
    score = scoring(docs, text)
    path = shared_path(docs.sparkSession, "index")
    index = build_index(docs, score, text, doc_id)
    index = index.withColumn("prime", F.pmod(F.xxhash64("segment"), F.lit(PRIME)) == 0)
    index.write.partitionBy("prime").parquet(path)
    index = docs.sparkSession.read.schema(index.schema).parquet(path)
    found = search(index, queries, score, k, text, item_id)
    return found.select(F.col("item").alias(item_id), F.col("rank").cast("int"), F.col("id").alias(doc_id), "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
f AS (SELECT term, floor(1000.0 * ln((2.0 * docs + 2.0) / (2.0 * count(*) + 1.0)))::BIGINT AS w FROM p, s GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50
"""
