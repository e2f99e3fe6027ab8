"""Strategies as sets of signals: what each would order, when, from what it could see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof, within


def _seconds_left(close: str = "close_ms", now: str = "ts_ms"):
    return (F.col(close) - F.col(now)) / F.lit(1000.0)


def _first(signals: DataFrame, key: str = "market_id") -> DataFrame:
    """The first signal of each market, as an aggregate that is combined before it moves."""
    return signals.groupBy(key).agg(F.min_by(F.struct(*signals.columns), F.struct("ts_ms", "ord")).alias("s")).select("s.*")


def lead_lag(ticks: DataFrame, reference: DataFrame, quotes: DataFrame, markets: DataFrame, window_s: float, stop_s: float, min_move_bps: float, max_ticks: int, lag_ms: int = 0) -> DataFrame:
    """(market_id, ts_ms, ord, side, limit_ticks): one order for each market, on the first tick near its close at which a reference
    has moved enough since the market's opening and the ask is still cheap.

    ``reference`` (asset, ts_ms, close) is seen ``lag_ms`` late, and not before the opening.
    """
    near = ticks.join(markets.select("market_id", "asset", "open_ms", "close_ms"), "market_id")
    ref = reference.select("asset", F.col("ts_ms").alias("ref_ms"), F.col("close").alias("ref_close"))
    bounds = markets.select("market_id", "asset", "open_ms", "close_ms")
    seen = within(ref.withColumn("seen_ms", F.col("ref_ms") + lag_ms), bounds, "seen_ms", "open_ms", "close_ms", keys=["asset"])
    base = seen.groupBy("market_id").agg(F.min_by("ref_close", "ref_ms").alias("ref_open"), (F.min("ref_ms") + lag_ms).alias("from_ms"))
    now = asof(near, ref, ["asset"], "ts_ms", "ref_ms", ["ref_close", "ref_ms"], ["ref_close"], lag_ms=lag_ms, block_ms=3_600_000).join(base, "market_id").where("ts_ms >= from_ms")
    move = (F.col("ref_close") / F.col("ref_open") - 1) * 10_000
    left = _seconds_left()
    hot = now.where((left <= window_s) & (left > stop_s) & (F.abs(move) >= min_move_bps)).withColumn("side", F.when(move > 0, "UP").otherwise("DOWN"))
    ask = quotes.select("market_id", "side", F.col("ts_ms").alias("q_ms"), F.col("ask_ticks").alias("limit_ticks"))
    priced = asof(hot, ask, ["market_id", "side"], "ts_ms", "q_ms", ["limit_ticks"], ["limit_ticks"])
    return _first(priced.where(F.col("limit_ticks") <= max_ticks).select("market_id", "ts_ms", "ord", "side", "limit_ticks"))


def favourite_near_close(quotes: DataFrame, markets: DataFrame, window_s: float, min_ticks: int, max_ticks: int) -> DataFrame:
    """(market_id, ts_ms, ord, side, limit_ticks): the first quote near the close of a side within the price range; the dearer side of equals in time."""
    near = quotes.join(markets.select("market_id", "close_ms"), "market_id").where((_seconds_left() <= window_s) & (F.col("ts_ms") < F.col("close_ms")))
    ok = near.where(F.col("ask_ticks").between(min_ticks, max_ticks))
    return _first(ok.select("market_id", "ts_ms", (F.col("ord") * 10_001 + 10_000 - F.col("ask_ticks")).alias("ord"), "side", F.col("ask_ticks").alias("limit_ticks")))


def two_sided_quotes(tops: DataFrame, markets: DataFrame, min_spread: int, low: int, high: int, stop_s: float) -> DataFrame:
    """(market_id, ts_ms, ord, bid_ticks, down_bid_ticks): new resting bids on both tokens where UP's best prices change, the spread is wide and prices are not extreme."""
    t = tops.join(markets.select("market_id", "close_ms"), "market_id").where(_seconds_left() > stop_s)
    ok = t.where((F.col("ask_ticks") - F.col("bid_ticks") >= min_spread) & (F.col("bid_ticks") >= low) & (F.col("ask_ticks") <= high))
    w = Window.partitionBy("market_id").orderBy("ts_ms", "ord")
    before = F.lag(F.struct("bid_ticks", "ask_ticks")).over(w)
    new = ok.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.struct("bid_ticks", "ask_ticks")))
    return new.select("market_id", "ts_ms", "ord", "bid_ticks", (F.lit(10_000) - F.col("ask_ticks")).alias("down_bid_ticks"))
