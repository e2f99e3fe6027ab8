"""Byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch, encode the pieces, decode."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and how far each chunk reads on into the next.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
CACHE_PIECES = 300_000
_codecs: dict = {}


class Codec:
    """The ranks of a vocabulary file, with the ids of pieces seen before."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.known: dict[str, bytes] = {}

    def boundaries(self, text: str) -> list[int]:
        """Where the pre-tokens of ``text`` start."""
        return [m.start() for m in self.pattern.finditer(text)]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """The ids of the pieces, each encoded by itself, as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        try:
            return b"".join([known[x] for x in pieces])
        except KeyError:
            for x in set(pieces).difference(known):
                known[x] = np.array(self.core.encode_single_piece(x) if hasattr(self.core, "encode_single_piece") else self.core._encode_single_piece(x), "<u4").tobytes()
        return b"".join([known[x] for x in pieces])

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def stitch(length: int, starts: list[int], heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """Cut points of a text at true pre-token boundaries, one chunk after another.

    Chunk k begins at ``starts[k]`` and reads on past ``starts[k + 1]``. ``heads[k]`` are the
    boundaries that it finds near its start, perhaps out of step; ``tails[k]`` those that it finds
    past the next chunk's start. Matching goes from left to right without looking back, so from
    the first boundary that both find, both agree to the end. A chunk with no such boundary joins
    the one before it, and the cut falls after it.
    """
    cuts, sure = [0], tails[0]
    for k in range(1, len(starts)):
        meet = next((b for b in sure if b in set(heads[k])), None) if sure else None
        if meet is not None:
            cuts.append(meet)
            sure = tails[k]
        else:
            sure = []  # this chunk may be out of step; the joined piece runs to the text's end or a later cut
    return [*cuts, length]


def chunk_rows(docs: DataFrame, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(_row, at, piece): overlapping chunks of each long text, spread over the cluster. A chunk's row holds its own text alone."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(chunk))
    pieces = F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring("text", at + 1, F.lit(chunk + overlap)).alias("piece")))
    return docs.select("_row", F.explode(pieces).alias("c")).select("_row", "c.at", "c.piece").repartition("_row", "at")


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    Texts up to ``chunk`` characters are one chunk and stay where they are. Longer ones are cut
    into overlapping chunks that are pre-tokenised in parallel; the boundaries near the seams meet
    by text, give exact cut points, and the pieces between them are encoded in parallel and put
    together. Null texts count as empty and have no ids. Rows that are equal stay separate rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    short = rows.where(F.char_length("text") <= chunk)
    long = rows.where(F.char_length("text") > chunk).withColumn("_row", F.sha2("text", 256))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [c.encode(x) for x in part.column(1).to_pylist()]
                decoded = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out = {"_row": [], "at": [], "head": [], "tail": []}
            for row, at, piece in zip(*(batch.column(x).to_pylist() for x in ("_row", "at", "piece")), strict=True):
                found = c.boundaries(piece)
                whole_text = len(piece) < chunk + overlap  # the text ends here, so its last matches are true ones
                # A seam is cut only after a letter or digit, so that no run of white space is parted.
                found = [x for x in (found if whole_text else found[:-2]) if x and piece[x - 1].isalnum()]
                out["_row"].append(row)
                out["at"].append(at)
                out["head"].append([at + x for x in found if x < overlap])
                out["tail"].append([at + x for x in found if x >= chunk])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("_row", pa.string()), ("at", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            ids = [c.encode(x) for x in batch.column("part").to_pylist()]
            decoded = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("low"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["_row", "low", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stitch(-1, *([x[name] for x in row] for name in ("at", "head", "tail"))) for row in batch.column("seams").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(pa.int32()))], names=["_row", "cuts"])

    texts = long.select("_row", "text").dropDuplicates(["_row"])
    seam = chunk_rows(texts, chunk, overlap).mapInArrow(seams, "_row string, at int, head array<int>, tail array<int>")
    by_text = seam.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "head", "tail"))).alias("seams"))
    cuts = by_text.mapInArrow(cut, "_row string, cuts array<int>")
    # the last cut, -1, stands for the text's end
    size = lambda low, i: F.when(F.get("cuts", i + 1) < 0, F.char_length("text")).otherwise(F.get("cuts", i + 1)) - low
    lows = F.slice("cuts", 1, F.size("cuts") - 1)
    parts = F.transform(lows, lambda low, i: F.struct(low.alias("low"), F.substring("text", low + 1, size(low, i)).alias("part")))
    pieces = texts.join(cuts, "_row").select("_row", F.explode(parts).alias("p")).select("_row", "p.low", "p.part").repartition("_row", "low")
    put = pieces.mapInArrow(encoded, "_row string, low int, ids binary, decoded binary").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("low", "ids", "decoded"))).alias("p"))
    whole_of = lambda name: F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x[name])).alias(name)
    put = put.select("_row", whole_of("ids"), whole_of("decoded"))
    done = short.mapInArrow(whole, f"doc_id {short.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
    return done.unionByName(long.select("doc_id", "_row").join(put, "_row").select("doc_id", "ids", "decoded"))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows, and the columns ``more``."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``documents``; null texts are empty, repeated rows are each returned."""
    import public_tokenizers as P

    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


