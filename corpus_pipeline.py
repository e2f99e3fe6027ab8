"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read again."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, decontaminate, language_id, order_minhash, suffix_dedup
from tickloom.llm.common import setting, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; ``und`` and doubtful ones go. All columns stay as they are.

    Null and empty texts and texts without a letter are ``und``. Rows are judged each by its text, so repeated rows stay or go
    together; of equally likely languages the first counts. Null lang, source and doc_id don't matter; an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).where(language_id.accepted()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document of smallest doc_id.

    Rows without doc_id stay; rows that share one are one document and stay or go together.
    """
    gone = order_minhash.near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go.

    ``n_chars`` follows the text. Rows without doc_id stay as they are; rows that share one are each
    cut by their own text and keep their own columns.
    """
    named = docs.where("doc_id IS NOT NULL")
    cut = suffix_dedup.remove_repeats(named, as_text=True, once=True).where("kept <> '' OR n_bytes = 0")
    cut = cut.select("doc_id", F.col("n_bytes").alias("_n"), F.col("text_crc32").alias("_crc"), F.col("kept").alias("text"))
    text = F.coalesce("text", F.lit(""))
    rest = named.withColumns({"_n": F.octet_length(text).cast("bigint"), "_crc": F.crc32(text)}).drop("text")
    out = rest.join(cut, ["doc_id", "_n", "_crc"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none, and equal texts stay or go together.

    Test items without id or text are never found. Empty tables on either side are allowed.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, items)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document; ids as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids; repeated rows and rows without doc_id give a row each; an empty table gives none.
    """
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, "ids")


#: Texts that go to a Python worker at once, in all stages of a session.
BATCH_ROWS = 2000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage):
    """``stage`` with batches of BATCH_ROWS texts. A stage's rows are made after it returns, so the setting is put back by run()."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCHES, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", in_small_batches(identify_language)),
    ("near_dedup", in_small_batches(drop_near_duplicates)),
    ("passage_dedup", in_small_batches(drop_repeated_passages)),
    ("decontamination", in_small_batches(drop_benchmark_leaks)),
    ("byte_bpe", in_small_batches(encode_tokens)),
]

#: Sketches, alignment, a trained network and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with setting(spark, BATCHES, str(BATCH_ROWS)):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
