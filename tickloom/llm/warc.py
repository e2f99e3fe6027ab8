"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: An archive is closed once it has this many bytes, so that a reader's row stays small.
ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")


class WarcError(ValueError):
    """A frame, header or length that is not as the format has it."""


def record_bytes(kind: str, uri: str, payload: bytes, digest: str, size: int, record_id: str, extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One WARC/1.1 record: header lines, an empty line, the block, two line ends."""
    # A record's date is fixed: the archive of the same pages is the same bytes.
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
             "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", *(f"{a}: {b}" for a, b in extra), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record that fills ``data``; WarcError if it doesn't."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not NAME.fullmatch(name):
            raise WarcError(f"bad header line {line[:60]!r}")
        if (key := name.decode().lower()) in headers:
            raise WarcError(f"header {key} comes twice")
        headers[key] = value.strip().decode()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise WarcError(f"no {key}")
    if not re.fullmatch(r"\d+", headers["content-length"]) or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as content-length says")
    return headers, rest[:-4]


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each."""
    import zstandard as zstd

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        held, at = data[8 : 8 + size], 8 + size
        if len(held) != size:
            raise WarcError("the dictionary's frame is cut short")
        if held[:4] == struct.pack("<I", FRAME):
            held = zstd.ZstdDecompressor().decompress(held)
        dictionary = zstd.ZstdCompressionDict(held)
    reader = zstd.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while at < len(data):
        if data[at : at + 4] != struct.pack("<I", FRAME):
            raise WarcError(f"no frame at byte {at}")
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise WarcError("a frame is cut short")
            out.append(one.decompress(data[at : at + 8192]))  # small steps: what is left over is copied
            at = min(at + 8192, len(data))
        at -= len(one.unused_data)
        yield b"".join(out)


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A Zstandard dictionary from sample records; empty if they are too few to train on."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def with_types(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of payloads of at least 100 bytes that are equal, that of the smallest page_id is the response.
    The smallest id of each digest is found from ids and digests alone, aggregated before they
    move. A null html is an empty payload; a null page_id comes after all others.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(first, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumns({
        "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        "refers_to": F.when(revisit, F.col("_first")),
        "html": F.when(~revisit, F.col("html")),
    }).drop("_first")


def write_archives(pages: DataFrame, target: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives below ``target``; (file, records) of each archive.

    A task sorts its rows and names its archives by its own number, so that a task that runs again
    writes the same bytes to the same names, each renamed when whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(target if "://" in target else "file://" + os.path.abspath(target.removeprefix("file:")))
        store.create_dir(base, recursive=True)
        files: list[tuple[str, int]] = []

        def close(records: list[bytes]) -> None:
            dictionary = train_dictionary(records[:400])
            options = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
            writer = zstd.ZstdCompressor(level=3, **options)
            name = f"{TaskContext.get().partitionId():06d}-{len(files):05d}.warc.zst"
            part = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(archive_head(dictionary))
                for x in records:
                    out.write(writer.compress(x))
            store.move(part, f"{base}/{name}")
            files.append((name, len(records)))

        pending, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                extra = ()
                if row["record_type"] == "revisit":
                    extra = (("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"))
                page = "" if row["page_id"] is None else row["page_id"]
                pending.append(record_bytes(row["record_type"], re.sub(r"[\r\n]", "", row["url"] or ""), payload, row["payload_digest"], row["payload_bytes"], f"urn:page:{page}", extra))
                held += len(pending[-1])
                if held >= archive_bytes:
                    close(pending)
                    pending, held = [], 0
        if pending:
            close(pending)
        yield pa.RecordBatch.from_pydict({"file": [x for x, _ in files], "records": [n for _, n in files]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    rows = pages.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.sortWithinPartitions("page_id", "url", "payload_digest").mapInArrow(run, "file string, records long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``*.warc.zst`` below ``path``, validated; a bad frame, header, length or digest fails.

    (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for frame in frames(data.as_py()):
                    h, block = parse_record(frame)
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    kind, size = h["warc-type"], int(h["x-payload-length"])
                    if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                        raise WarcError(f"{h['warc-record-id']}: the payload is not as its headers say")
                    page = h["warc-record-id"].strip("<>").removeprefix("urn:page:")
                    refers = h.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
                    rows.append({"page_id": int(page) if page else None, "url": h.get("warc-target-uri"), "payload": block, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None})
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return found.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive(pages: DataFrame) -> str:
    """Write ``pages`` and return the folder of the archives; what each holds is listed beside it."""
    spark = pages.sparkSession
    target = shared_path(spark, "warc")
    listed = write_archives(with_types(pages), target)
    listed.write.parquet(f"{target}/_list")
    return target


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of ``pages``, read back from the archives; null pages are empty."""
    target = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM q
"""
