"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash blocks in which a shard is numbered.
BLOCKS = 1024
BITS = 52  # of an MD5 digest, as many as a double holds exactly


def _uniform(key: Column, shard: int) -> Column:
    """A draw in (0, 1) fixed by the key and the shard's number."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, BITS // 4), 16, 10).cast("long")
    return (word.cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest ``-weight / ln(draw)``; the lower number of equals.

    A key's score for a shard depends on that shard alone. So a new shard takes keys only for
    itself, a removed one gives up only its own, and a raised weight only draws keys. Null keys
    share one key.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((F.lit(-float(w)) / F.ln(_uniform(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """``docs`` with its shard; nothing is shuffled."""
    return docs.withColumn(column, rendezvous_shard(F.col(f"`{key}`"), weights))


def slots(docs: DataFrame, key: str, shard_column: str, tie: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """``docs`` with ``slot``: the row's place in its shard, from 0 without gaps.

    A shard is numbered by hash blocks of the key, then the key, then ``tie``. Only the counts of
    the (shard, block) pairs are summed over a whole shard, so no task holds a shard's rows.
    """
    block = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))), 18, 13), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    rows = docs.withColumn("_block", block)
    sums = "sum(n) OVER (PARTITION BY {s} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n".format(s=f"`{shard_column}`")
    before = rows.groupBy(shard_column, "_block").agg(F.count(F.lit(1)).alias("n")).select(F.col(shard_column), "_block", F.expr(sums).alias("_before"))
    order = [F.col(f"`{key}`").asc_nulls_first(), *[F.col(f"`{x}`").asc_nulls_first() for x in tie]]
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy(shard_column, "_block").orderBy(*order)))
    return placed.join(before, [shard_column, "_block"]).withColumn("slot", F.col("_before") + F.col("_row") - 1).drop("_block", "_before", "_row")


def op3_rendezvous(spark, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """Equal weights; one more shard of the same weight for grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = shard(shard(rows, "doc_id", [1.0] * n_shards), "doc_id", [1.0] * (n_shards + 1), "grown_shard")
    return slots(rows, "doc_id", "shard", ("text_crc32", "size"), BLOCKS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))

