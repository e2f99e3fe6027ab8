"""Partition columns from archive paths, as expressions on a path column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.parsing import alternatives, let

# Asset prefixes, dataset names and the words for two intervals.
ASSETS = ["BTC", "ETH", "SOL", "XRP", "DOGE", "BNB", "HYPE", "ZEC"]
UNLISTED_ASSETS = ["ZEC"]
DATASETS = ["prices", "twap30s", "twap60s", "book", "best_bid_ask", "price_change", "last_trade_price", "markets", "tick_size_change", "orderbook", "klines", "other"]
INTERVAL_WORDS = {"HOURLY": "1h", "DAILY": "1d"}


def asset_of(segment: Column) -> Column:
    """The known asset that a path segment starts with."""
    found = F.regexp_extract(F.upper(segment), f"^({'|'.join(ASSETS)})", 1)
    return F.nullif(found, F.lit(""))


def venue_of(path: Column) -> Column:
    return F.when(F.array_contains(F.split(F.lower(path), "/"), "predict-fun"), "predict").otherwise("polymarket")


def day_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def _period(segment: Column, words: bool) -> Column:
    pattern = r"^[A-Za-z]+-(\d+[mMhHdD]" + ("|HOURLY|DAILY" if words else "") + ")$"
    period = F.nullif(F.regexp_extract(segment, pattern, 1), F.lit(""))
    named = F.when(period == "HOURLY", "1h").when(period == "DAILY", "1d") if words else F.lit(None).cast("string")
    return F.coalesce(named, F.lower(period))


def classify(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with venue, dataset, asset, interval and ext; a path of no known layout has dataset ``other``.

    A path is split once, and its parts are read from one struct, so that filters on them stay small.
    """
    return paths.withColumn("_c", let(F.split(F.col(path), "/"), _parts)).withColumn("venue", venue_of(F.col(path))).select(*paths.columns, "venue", "_c.*")


def _parts(segments: Column) -> Column:
    seg = lambda i: F.get(segments, i)
    name = F.element_at(segments, -1)
    ext = F.when(name.endswith(".csv.gz"), "csv.gz").when(name.endswith(".jsonl.gz"), "jsonl.gz").otherwise("")
    derived = (seg(0) == "derived") & (seg(1) == "klines")
    predict, chain, poly = seg(1) == "predict-fun", seg(1).startswith("chainlink"), seg(1) == "polymarket"
    dataset = (F.when(derived, "klines").when(predict, F.when(seg(2).isin("klines", "orderbook", "prices", "markets"), seg(2)).otherwise("other"))
               .when(chain, F.when(seg(1) == "chainlink-twap-30s", "twap30s").when(seg(1) == "chainlink-twap-60s", "twap60s").otherwise("prices"))
               .when(poly, F.when(seg(3).isin(*DATASETS), seg(3)).otherwise("other")).otherwise("other"))
    asset = (F.when(derived | (predict & seg(2).isin("klines", "orderbook", "prices")), asset_of(seg(3)))
             .when(chain | poly, asset_of(seg(4))))
    interval = (F.when(derived | (predict & (seg(2) == "klines")), seg(4)).when(predict & (seg(2) == "orderbook"), _period(seg(3), True))
                .when(poly, _period(seg(4), False)))
    return F.struct(dataset.alias("dataset"), asset.alias("asset"), interval.alias("interval"), ext.alias("ext"))


def matches(meta: DataFrame, **query: str | None) -> DataFrame:
    """The rows that all given dimensions match; see alternatives()."""
    for name, want in query.items():
        meta = meta.where(F.coalesce(alternatives(F.col(name), F.lit(want).cast("string")), F.lit(False)))
    return meta


def for_run(meta: DataFrame, venue: str, assets: list[str], datasets: list[str], intervals: list[str]) -> DataFrame:
    """Files that a run reads: null assets and intervals always match."""
    keep = (F.col("venue") == venue) & F.col("dataset").isin(*datasets)
    if assets:
        keep = keep & (F.col("asset").isNull() | F.col("asset").isin(*assets))
    if intervals:
        keep = keep & (F.col("interval").isNull() | F.col("interval").isin(*intervals))
    return meta.where(keep)


def interval_minutes(label: Column) -> Column:
    n, unit = F.regexp_extract(label, r"^(\d+)(mo|[mhdw])$", 1).try_cast("bigint"), F.regexp_extract(label, r"^(\d+)(mo|[mhdw])$", 2)
    size = F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440).when(unit == "w", 10080).when(unit == "mo", 43200)
    return F.coalesce(n * size, F.lit((1 << 53) - 1))


def summarise(meta: DataFrame) -> DataFrame:
    """One row: the distinct venues, datasets, assets, and intervals by duration, and which dimensions hold nulls."""
    by_length = F.transform(F.array_sort(F.transform(F.collect_set("interval"), lambda x: F.struct(interval_minutes(x).alias("m"), x.alias("x")))), lambda s: s.x)
    nullable = F.filter(F.array(F.when(F.bool_or(F.col("asset").isNull()), "asset"), F.when(F.bool_or(F.col("interval").isNull()), "interval")), lambda x: x.isNotNull())
    return meta.agg(F.array_sort(F.collect_set("venue")).alias("venues"), F.array_sort(F.collect_set("dataset")).alias("datasets"),
                    F.array_sort(F.collect_set("asset")).alias("assets"), by_length.alias("intervals"), nullable.alias("nullable"))


# The feeds of reference prices and their symbols.
REFERENCE_SYMBOLS = ["btcusdt", "ethusdt", "solusdt", "xrpusdt", "bnbusdt", "dogeusdt"]
REFERENCE_INTERVALS = ["1s", "1m"]


def reference_feed(name: Column) -> Column:
    """(canonical, symbol, market, interval) of a feed's name such as ``binance:btcusdt:spot:1s``, in any case; null if there is no such feed."""
    plain = F.lower(F.trim(name))
    shape = rf"^binance:({'|'.join(REFERENCE_SYMBOLS)}):(spot):({'|'.join(REFERENCE_INTERVALS)})$"
    part = lambda i: F.regexp_extract(plain, shape, i)
    return F.when(plain.rlike(shape), F.struct(plain.alias("canonical"), part(1).alias("symbol"), part(2).alias("market"), part(3).alias("interval")))
