"""Removal of passages that an earlier document has: distributed prefix doubling over sampled positions.

Prefix doubling names every string of length 2h by the pair of names at a position and h further
on, sorts the pairs and drops what is unique. Here the names of 1, 2, 4, 8 and 16 bytes are made
inside each document. Spark then deals and sorts the (name, document, position) triples of two
rounds:

1. Grams of GRAM bytes, at sampled positions only: a window of LENGTH bytes holds LENGTH - GRAM + 1
   grams, and the position of the least name among them is the same wherever the window occurs. So
   a repeated window has a repeated sampled gram. Grams of one document alone are unique and drop
   out. A gram whose whole neighbourhood also stands in an earlier document settles all windows
   around it.
2. Around the other repeated grams (the edges of repeated passages) the texts' bytes are fetched, and
   every window of LENGTH bytes is named from the gram and its place in the window, and sorted again.

Within a task, equal triples of later documents settle at once and don't move, so a passage that a
third of all documents share costs a task one row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.ordering import position

from .common import BASE, BYTE_CODES, U64, mix, parts, row_chunks, text_buffers

LENGTH, GRAM = 50, 22
SPAN = LENGTH - GRAM  # a window's last gram starts so far after its first
AROUND = LENGTH + SPAN  # bytes of all windows that hold a gram
HOT = 1024  # a gram with more unsettled places than this has its windows dealt one by one
BUCKET_BYTES = 32 << 20  # of text, at most, on average, where the session's partitions are fewer
SLICE = 1 << 18  # bytes of text sampled at once; a longer text is sampled in slices
ANCHORS = 1 << 19  # sampled positions that a task holds before it passes them on
PIECE = 1 << 13  # places whose windows are named at once
SETTLED, OPEN, OPEN_HOT, CONTEXT, WINDOW = 1, 2, 3, 4, 5
ROWS = "kind tinyint, bucket int, blob binary"
ROW_SCHEMA = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("blob", pa.binary())])


def gram_names(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The name of the ``size`` bytes from each position, by doubling; shorter than ``data`` by size - 1."""
    if len(data) < size:
        return np.zeros(0, U64)
    name, length, whole, done = BYTE_CODES[data], 1, None, 0
    power = int(BASE)
    while True:
        if size & length:  # a binary digit of size: append this power of two
            if whole is None:
                whole, done = name, length
            else:
                n = len(data) - done - length + 1
                whole, done = whole[:n] * U64(power) + name[done : done + n], done + length
        if length * 2 > size:
            return mix(whole)
        name = name[:-length] * U64(power) + name[length:]
        length, power = length * 2, power * power % (1 << 64)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


def sampled(names: np.ndarray, window_ok: np.ndarray) -> np.ndarray:
    """Positions whose name is least among the grams of some whole window that starts where ``window_ok``."""
    if len(names) <= SPAN:
        return np.zeros(0, np.int64)
    least = np.where(window_ok, _slide(names, SPAN + 1, np.minimum), U64(0))
    around = np.concatenate([np.zeros(SPAN, U64), least, np.zeros(SPAN, U64)])
    return np.flatnonzero(_slide(around, SPAN + 1, np.maximum) == names)


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return len(arrays[0]).to_bytes(8, "little") + zstandard.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    n, data, at, out = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:]), 0, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _gather(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpack(b, *kinds) for b in blobs), strict=True)] if blobs else [np.zeros(0, k) for k in kinds]


def _deal(kind: int, buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with its part of the arrays."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    found, starts = np.unique(buckets[order], return_index=True)
    sorted_arrays = [x[order] for x in arrays]
    ends = [*starts[1:], len(order)]
    for low in range(0, len(found), 256):
        some = range(low, min(low + 256, len(found)))
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int8()), pa.array(found[low : low + 256].astype(np.int32)), pa.array([_pack(*(x[starts[i] : ends[i]] for x in sorted_arrays)) for i in some], pa.binary())], schema=ROW_SCHEMA)


def _bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` integers that Spark's hash partitioning puts into ``n`` different partitions, so that buckets lie evenly."""
    near = spark.range(24 * n).select(F.col("id").cast("int").alias("key"))
    found = near.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).collect()
    return np.array([r.key for r in found], np.int64)  # fewer than n only if a partition has no key: still a valid deal


def _doc_bucket(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[(mix(docs.astype(np.int64).view(U64) + BASE) % U64(len(keys))).astype(np.int64)]


def _gram_bucket(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[((names >> U64(16)) % U64(len(keys))).astype(np.int64)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[bytes]]]:
    """The blobs of a partition by kind and bucket."""
    out: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for kind, bucket, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            out.setdefault(kind, {}).setdefault(bucket, []).append(blob)
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in arrays that are sorted together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _text_places(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram, context, doc, position) of the sampled positions of some texts, a chunk at a time.

    The context names the bytes of all windows around the gram. At the edge of a text it is made
    from what is there. A slice of a long text has SPAN more bytes on both sides, for contexts alone.
    """
    for low, high in row_chunks(offsets, SLICE):
        size = offsets[high] - offsets[low]
        if high - low == 1 and size > SLICE:
            cuts = [(max(x - SPAN, 0), min(x + SLICE + LENGTH + SPAN, size), x) for x in range(0, size, SLICE)]
        else:
            cuts = [(0, size, 0)]
        for first, last, own in cuts:
            d = data[offsets[low] + first : offsets[low] + last]
            if len(d) < LENGTH:
                continue
            o = offsets[low : high + 1] - offsets[low] if len(cuts) == 1 else np.array([0, last - first])
            names = gram_names(d)
            left = np.repeat(o[1:], np.diff(o)) - np.arange(len(d))
            ok = left[: len(d) - LENGTH + 1] >= LENGTH
            if len(cuts) > 1:  # windows that start in the slice itself
                ok[: own - first] = False
                ok[own - first + SLICE :] = False
            at = sampled(names, ok)
            doc = np.searchsorted(o, at, "right") - 1
            before, after = at - o[doc] + first, o[doc + 1] - at - GRAM + size - last
            wide = gram_names(d, SPAN)
            context = mix(wide[np.maximum(at - SPAN, 0)] * BASE + wide[np.minimum(at + GRAM, len(wide) - 1)])
            for i in np.flatnonzero((before < SPAN) | (after < SPAN)):
                a, b = min(before[i], SPAN), min(after[i], SPAN)
                context[i] = int.from_bytes(hashlib.blake2b(bytes([a, b]) + d[at[i] - a : at[i] + GRAM + b].tobytes(), digest_size=8).digest(), "little")
            yield names[at], context, docs[low + doc], before


def _sample(keys: np.ndarray, m: int):
    """Round 1 in the documents: sampled grams, without those that an equal one of the task settles."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        gram, context, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, context, gram))
        gram, context, doc, at = gram[order], context[order], doc[order], at[order]
        new = _groups(gram, context)
        own = _document(doc, m)
        later = own > own[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        yield from _deal(SETTLED, _doc_bucket(doc[later], keys), doc[later], at[later].astype("<u4"))
        gram, context, doc, at = (x[~later] for x in (gram, context, doc, at))
        order = np.lexsort((at, doc))
        gram, context, doc, at = gram[order], context[order], doc[order], at[order]
        # 48 bits of each name move, besides those that the bucket holds; places compare by both names.
        yield from _deal(OPEN, _gram_bucket(gram, keys), (gram & U64(0xFFFFFFFF)).astype("<u4"), (gram >> U64(48)).astype("<u2"), (context & U64(0xFFFFFFFF)).astype("<u4"), (context >> U64(48)).astype("<u2"), doc.astype("<i8"), at.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for place in _text_places(data, offsets, np.asarray(batch.column(0), dtype=np.int64)):
                held.append(place)
                count += len(place[0])
                if count >= ANCHORS:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)

    return run


def _rank_grams(keys: np.ndarray, m: int):
    """Round 1 over the grams of a partition: unique ones drop out, whole contexts settle, the rest stay open."""

    def ranked(blobs: list[bytes]) -> tuple[list[np.ndarray], ...]:
        low, high, c_low, c_high, doc, at = _gather(blobs, "<u4", "<u2", "<u4", "<u2", "<i8", "<u4")
        gram = low.astype(U64) | high.astype(U64) << U64(32)
        context = c_low.astype(U64) | c_high.astype(U64) << U64(32)
        order = np.lexsort((doc, context, gram))
        gram, context, doc, at = gram[order], context[order], doc[order], at[order]
        new = _groups(gram)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        of = _document(doc, m)
        repeated = (np.minimum.reduceat(of, starts) < np.maximum.reduceat(of, starts))[group]
        own = _groups(gram, context)
        first = of == of[np.maximum.accumulate(np.where(own, np.arange(len(doc)), 0))]
        several = (np.add.reduceat(own.astype(np.int64), starts) > 1)[group]
        still = repeated & first & several
        hot = (np.bincount(group[still], minlength=len(starts)) > HOT)[group]
        return tuple([doc[some], at[some]] for some in (repeated & ~first, still & ~hot, still & hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _by_bucket(batches)
        found = [ranked(x) for x in blobs.get(OPEN, {}).values()]
        done = [_gather([b for x in blobs.get(SETTLED, {}).values() for b in x], "<i8", "<u4")]
        for i, kind in enumerate((SETTLED, OPEN, OPEN_HOT)):
            doc, at = (np.concatenate(x) for x in zip(*[f[i] for f in found], *(done if kind == SETTLED else [[np.zeros(0, "<i8"), np.zeros(0, "<u4")]]), strict=True))
            yield from _deal(kind, _doc_bucket(doc, keys), doc, at)

    return run


def _texts(blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    import zstandard

    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        data = zstandard.decompress(blob[8:])
        docs, sizes = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u4", n, 8 * n)
        at = 12 * n
        for doc, size in zip(docs.tolist(), sizes.tolist(), strict=True):
            yield doc, np.frombuffer(data, np.uint8, size, at)
            at += size


def _pack_texts(keys: np.ndarray):
    """Texts by bucket of their document, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            docs = np.asarray(batch.column(0), dtype=np.int64)
            bucket = _doc_bucket(docs, keys)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            for b, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                sizes = np.diff(offsets)[rows].astype("<u4")
                raw = docs[rows].astype("<i8").tobytes() + sizes.tobytes() + b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in rows)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([b], pa.int32()), pa.array([len(rows).to_bytes(8, "little") + zstandard.compress(raw, 1)], pa.binary())], schema=ROW_SCHEMA)

    return run


def _document(ids: np.ndarray, m: int) -> np.ndarray:
    """The doc_id of each id, of which every doc_id has ``m``."""
    return ids if m == 1 else ids // m


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def _grams_of(around: np.ndarray) -> np.ndarray:
    """The gram of each row of AROUND bytes."""
    out = [np.zeros(0, U64)]
    for low in range(0, len(around), PIECE):
        own = np.ascontiguousarray(around[low : low + PIECE, SPAN : SPAN + GRAM])
        out.append(gram_names(own.reshape(-1))[::GRAM])
    return np.concatenate(out)


def _window_names(around: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Names of the SPAN + 1 windows of each row of AROUND bytes, with the gram and the place in the window."""
    flat = gram_names(np.ascontiguousarray(around).reshape(-1), LENGTH)
    at = np.arange(len(around))[:, None] * AROUND + np.arange(SPAN + 1)[None, :]
    return mix(flat[at] + gram[:, None] * BASE + np.arange(SPAN + 1, dtype=U64)[None, :] * U64(0xD1B54A32D192ED03))


def _whole(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which windows around a gram lie in the text, by the bytes there are before and after it."""
    k = np.arange(SPAN + 1)[None, :]
    return (k >= SPAN - before[:, None]) & (k <= after[:, None])


def _rank_windows(names: np.ndarray, grams: np.ndarray, docs: np.ndarray, m: int) -> np.ndarray:
    """Which windows also stand in a document of smaller id; windows are equal if both 64-bit names are."""
    order = np.lexsort((docs, names))
    new = _groups(names[order], grams[order])
    sorted_docs = _document(docs[order], m)
    later = np.empty(len(names), bool)
    later[order] = sorted_docs > sorted_docs[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return later


def _hot_windows(around: np.ndarray, gram: np.ndarray, doc: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, m: int) -> tuple[tuple, tuple]:
    """The windows around hot places of a bucket, by names: (doc, start) of those that an earlier document of it has, and the rest once each as (names, first gram, doc, start).

    Places of one gram stand together, so most of their windows settle in the piece that names them.
    """
    order = np.argsort(gram, kind="stable")
    settled, left = [], []
    for low in range(0, len(order), PIECE):
        some = order[low : low + PIECE]
        whole = _whole(before[some], after[some])
        names = _window_names(around[some], gram[some])[whole]
        docs = np.repeat(doc[some], whole.sum(1))
        starts = (at[some].astype(np.int64)[:, None] - SPAN + np.arange(SPAN + 1)[None, :])[whole].astype("<u4")
        # A window is dealt and compared by its two names whatever gram led to it, so its gram is the one it starts with.
        first = gram_names(around[some].reshape(-1))[np.arange(len(some))[:, None] * AROUND + np.arange(SPAN + 1)[None, :]][whole]
        later = _rank_windows(names, first, docs, m)
        settled.append((docs[later], starts[later]))
        left.append(tuple(x[~later] for x in (names, first, docs, starts)))
    names, first, docs, starts = (np.concatenate(x) for x in zip(*left, strict=True))
    later = _rank_windows(names, first, docs, m)
    settled.append((docs[later], starts[later]))
    rest = np.flatnonzero(~later)
    rest = rest[np.lexsort((starts[rest], docs[rest], first[rest], names[rest]))]
    rest = rest[_groups(names[rest], first[rest], docs[rest], starts[rest])]
    return tuple(np.concatenate(x) for x in zip(*settled, strict=True)), (names[rest], first[rest], docs[rest], starts[rest])


def _open_contexts(keys: np.ndarray, m: int):
    """The documents' side of round 2: bytes around open grams; settled places become runs."""

    def run(key: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        by_kind = {k: [] for k in (SETTLED, OPEN, OPEN_HOT)}
        for kind, blob in zip(flags.column("kind").to_pylist(), flags.column("blob").to_pylist(), strict=True):
            by_kind[kind].append(blob)
        places = {k: _gather(v, "<i8", "<u4") for k, v in by_kind.items()}
        for k, (doc, at) in places.items():
            order = np.argsort(doc, kind="stable")
            places[k] = doc[order], at[order].astype(np.int64)
        out, seen = [], set()
        rows = {OPEN: [], OPEN_HOT: []}
        settled = []
        bucket = key[0].as_py()
        for doc, text in _texts(texts.column("blob").to_pylist()):
            if doc in seen:  # the same text again
                continue
            seen.add(doc)
            mine = {k: at[slice(*np.searchsorted(docs, [doc, doc + 1]))] for k, (docs, at) in places.items()}
            at = mine[SETTLED]
            at = at[at + GRAM <= len(text)]
            starts, ends = _runs(np.maximum(at - SPAN, 0), np.minimum(at + GRAM + SPAN, len(text)))
            if len(starts):
                settled.append((np.full(len(starts), doc, "<i8"), starts.astype("<u4"), ends.astype("<u4")))
            for k in rows:
                at = mine[k]
                at = at[at + GRAM <= len(text)]
                if not len(at):
                    continue
                padded = np.concatenate([np.zeros(SPAN, np.uint8), text, np.zeros(SPAN, np.uint8)])
                around = padded[at[:, None] + np.arange(AROUND)[None, :]]
                before, after = np.minimum(at, SPAN), np.minimum(len(text) - at - GRAM, SPAN)
                rows[k].append((np.full(len(at), doc, "<i8"), at.astype("<u4"), before.astype("u1"), after.astype("u1"), around))
        if settled:
            doc, starts, ends = (np.concatenate(x) for x in zip(*settled, strict=True))
            out += _deal(SETTLED, np.full(len(doc), bucket), doc, starts, ends)
        for k, some in rows.items():
            if not some:
                continue
            doc, at, before, after, around = (np.concatenate(x) for x in zip(*some, strict=True))
            some.clear()
            gram = _grams_of(around)
            if k == OPEN:
                out += _deal(CONTEXT, _gram_bucket(gram, keys), doc, at, before, after, around)
            else:
                (docs, starts), (names, first, own, begin) = _hot_windows(around, gram, doc, at, before, after, m)
                out += _deal(SETTLED, np.full(len(docs), bucket), docs, starts, starts + np.uint32(LENGTH))
                out += _deal(WINDOW, _gram_bucket(names, keys), names.astype("<u8"), first.astype("<u8"), own, begin)
        return pa.Table.from_batches(out, ROW_SCHEMA)

    return run


def _rank_open(keys: np.ndarray, m: int):
    """Round 2 over the windows of a partition: those that stand in an earlier document, as runs of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _by_bucket(batches)
        contexts, windows = ([b for x in blobs.get(k, {}).values() for b in x] for k in (CONTEXT, WINDOW))
        done = _gather([b for x in blobs.get(SETTLED, {}).values() for b in x], "<i8", "<u4", "<u4")
        found = []
        if contexts:
            doc, at, before, after, around = _gather(contexts, "<i8", "<u4", "u1", "u1", f"({AROUND},)u1")
            contexts.clear()
            gram = _grams_of(around)
            order = np.argsort(gram, kind="stable")
            starts = np.flatnonzero(_groups(gram[order]))
            low = 0
            while low < len(gram):  # whole gram groups, some at a time
                high = int(starts[np.searchsorted(starts, low + PIECE)]) if low + PIECE < (starts[-1] if len(starts) else 0) else len(gram)
                part = order[low:high]
                whole = _whole(before[part], after[part])
                names = _window_names(around[part], gram[part])[whole]
                docs, grams = np.repeat(doc[part], whole.sum(1)), np.repeat(gram[part], whole.sum(1))
                begin = (at[part].astype(np.int64)[:, None] - SPAN + np.arange(SPAN + 1)[None, :])[whole]
                later = _rank_windows(names, grams, docs, m)
                found.append((docs[later], begin[later]))
                low = high
        if windows:
            names, grams, docs, begin = _gather(windows, "<u8", "<u8", "<i8", "<u4")
            later = _rank_windows(names, grams, docs, m)
            found.append((docs[later], begin[later].astype(np.int64)))
        if found:
            docs, begin = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((begin, docs))
            docs, begin = docs[order], begin[order]
            # neighbouring windows of a document are one run
            new = _groups(docs) | np.concatenate([[True], begin[1:] > begin[:-1] + LENGTH])[: len(docs)]
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(docs) - 1]]) if len(docs) else np.zeros(0, np.int64)
            done = [np.concatenate(x) for x in zip(done, (docs[new], begin[new].astype("<u4"), (begin[last] + LENGTH).astype("<u4")), strict=True)]
        yield from _deal(SETTLED, _doc_bucket(done[0], keys), *done)

    return run


OUT = "doc_id bigint, n_bytes bigint, text_crc32 bigint, spans array<struct<start:bigint,end:bigint>>, kept "


def _cut(as_text: bool, once: bool, m: int):
    """The last step: each text without its runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_crc32", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string() if as_text else pa.binary())])
    return lambda key, texts, runs: _cut_bucket(texts, runs, schema, as_text, once, m)


def _cut_bucket(texts: pa.Table, runs: pa.Table, schema: pa.Schema, as_text: bool, once: bool, m: int) -> pa.Table:
    doc, start, end = _gather(runs.column("blob").to_pylist(), "<i8", "<u4", "<u4")
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    out, seen = {k: [] for k in schema.names}, set()
    for d, text in _texts(texts.column("blob").to_pylist()):
        if once and d in seen:
            continue
        seen.add(d)
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        starts, ends = _runs(np.minimum(start[mine], len(text)), np.minimum(end[mine], len(text)))
        keep = np.ones(len(text), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            keep[a:b] = False
        out["doc_id"].append(d // m)
        out["n_bytes"].append(len(text))
        out["text_crc32"].append(zlib.crc32(text))
        out["spans"].append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b > a])
        kept = (text[keep] if len(starts) else text).tobytes()
        out["kept"].append(kept.decode(errors="ignore") if as_text else kept)
    return pa.Table.from_pydict(out, schema)


def _with_ids(named: DataFrame) -> tuple[DataFrame, int, int, DataFrame | None]:
    """Rows by an id that each text of a doc_id has for itself, how many ids a doc_id has, the bytes of all texts, and the doc_ids by place.

    The id is doc_id unless several texts share one; then it is the doc_id times the most texts that
    one has, plus the text's number. Where that could pass 63 bits, the doc_id's place among all doc_ids stands for it, and
    the last item has (place, doc_id); else it is None.
    """
    texts = named.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    of_text = texts.groupBy("doc_id", "h").agg(F.sum("n").alias("n"))
    most, total, low, high = of_text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).agg(F.max("k"), F.sum("n"), F.min("doc_id"), F.max("doc_id")).first()
    m = most or 1
    if m == 1:
        return named, 1, total or 0, None
    numbered = of_text.select("doc_id", "h", (F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).alias("j"))
    keyed = named.withColumn("h", F.xxhash64("text")).join(numbered, ["doc_id", "h"])
    places, own = None, F.col("doc_id")
    if max(-low, high) >= (1 << 62) // m:
        places = position(of_text.select("doc_id").distinct(), ["doc_id"])
        keyed, own = keyed.join(places, "doc_id"), F.col("place")
    return keyed.select((own * F.lit(m) + F.col("j")).alias("doc_id"), "text"), m, total, places


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, once: bool = False) -> DataFrame:
    """(doc_id, n_bytes, text_crc32, spans, kept) of every row: ``text`` without the bytes that an earlier document has.

    Removed is each byte of a LENGTH-byte string that also starts in a document with a smaller
    doc_id, judged on the input. Strings are equal if two 64-bit names of them are. Null texts are
    empty; a row without doc_id keeps its text and gives nothing away; rows that share a doc_id are
    each judged by their own text, and take nothing from one another. ``spans`` are the maximal
    removed runs of bytes; ``kept`` is the rest, which may start or end inside a character; with
    ``as_text`` it is a string without such parts of characters. With ``once``, rows of equal doc_id
    and text give one row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    named, m, size, places = _with_ids(rows.where(F.col("doc_id").isNotNull()))
    n = parts(spark, -(-size // BUCKET_BYTES))
    keys = _bucket_keys(spark, n)
    grams = named.mapInArrow(_sample(keys, m), ROWS).repartition(n, "bucket").mapInArrow(_rank_grams(keys, m), ROWS)
    texts = named.mapInArrow(_pack_texts(keys), ROWS)
    windows = texts.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(_open_contexts(keys, m), ROWS)
    runs = windows.repartition(n, "bucket").mapInArrow(_rank_open(keys, m), ROWS)
    cut = texts.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_cut(as_text, once, m), OUT + ("string" if as_text else "binary"))
    if places is not None:
        cut = cut.withColumnRenamed("doc_id", "place").join(places, "place").drop("place").select("doc_id", "n_bytes", "text_crc32", "spans", "kept")
    rest = rows.where(F.col("doc_id").isNull())
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return cut.unionByName(rest.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.crc32("text").alias("text_crc32"), none.alias("spans"), F.col("text").cast("string" if as_text else "binary").alias("kept")))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``documents``."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x.end - x.start)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
