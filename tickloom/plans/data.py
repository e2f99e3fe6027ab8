"""Day lists, coverage windows and cadences as DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The streams that prices settle on.
SETTLEMENT_STREAMS = ["prices", "twap30s", "twap60s"]


def physical_datasets(datasets: Sequence[str]) -> list[str]:
    """The archive's trees behind logical datasets: settlement stands for its three streams."""
    names = {"settlement": SETTLEMENT_STREAMS, "book": ["book", "price_change", "orderbook"], "trades": ["last_trade_price"]}
    return sorted({x for d in datasets for x in names.get(d, [d])})


def fingerprint(parts: dict) -> str:
    """SHA-256 of the canonical JSON of what defines a run."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def day_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 day)")).alias("day")).select(F.col("day").cast("string"))


def complete_days(days: DataFrame, needed: int) -> DataFrame:
    """Days on which at least ``needed`` distinct datasets were captured."""
    return days.groupBy("day").agg(F.countDistinct("dataset").alias("n")).where(F.col("n") >= needed).select("day")


def last_window(days: DataFrame, n: int) -> DataFrame:
    """The last ``n`` days: a top-k report."""
    return days.select("day").distinct().orderBy(F.col("day").desc()).limit(n)


def first_gap(wanted: DataFrame, captured: DataFrame) -> DataFrame:
    """One row: the first and last wanted day that wasn't captured, and how many there are."""
    return wanted.select("day").join(captured.select("day"), "day", "left_anti").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days"))


def throttle_ms(windows: DataFrame, first, last) -> DataFrame:
    """The coarsest cadence of each asset among the windows that meet [first, last]."""
    return windows.where((F.col("from") <= F.lit(last)) & (F.col("to") >= F.lit(first))).groupBy("asset").agg(F.max("ms").alias("throttle_ms"))


def settlement_paths(files: DataFrame, markets: DataFrame) -> DataFrame:
    """Settlement files of the streams that some decoded market settles on; other files stay."""
    streams = markets.select(F.col("stream").alias("dataset")).distinct()
    settles = F.col("dataset").isin(*SETTLEMENT_STREAMS)
    return files.where(~settles).unionByName(files.where(settles).join(streams, "dataset", "left_semi").select(*files.columns))


def market_order(markets: DataFrame, mode: str) -> DataFrame:
    """Markets in replay order: by asset, open and id, or by open and id in a session."""
    return markets.orderBy("open_ms", "market_id") if mode == "session" else markets.orderBy("asset", "open_ms", "market_id")


def market_days(markets: DataFrame) -> DataFrame:
    """One row: how many (asset, day, interval) there are, and markets by settlement stream."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("open_ms") / 86_400_000).cast("int"))
    counts = [F.count_if(F.col("stream") == s).alias(s) for s in SETTLEMENT_STREAMS]
    return markets.agg(F.countDistinct("asset", day, "interval").alias("market_days"), *counts)
