"""Market events as a stream: keyed state with event-time timers, and windowed panels with watermarks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.ledger import QUEUE_OUT, queue_rows, queue_step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QueueProcessor(StatefulProcessor):
    """Resting orders of one market between batches.

    Rows of a batch are put in order by (ts_ms, seq). Rows at or before the last time folded are
    late: they are dropped and counted. The market closes by a timer at ``close_ms``, once the
    watermark passes it; then its orders come out and its state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string, last_ms bigint, last_seq bigint, late bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        body, last, late = {"levels": {}, "shown": {}, "orders": {}}, (-(1 << 62), -1), 0
        if self.state.exists():
            raw, last_ms, last_seq, late = self.state.get()
            body, last = _load(raw), (last_ms, last_seq)
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        for r in pdf.itertuples(index=False):
            if (r.ts_ms, r.seq) <= last:
                late += 1
                continue
            last = (int(r.ts_ms), int(r.seq))
            if r.ts_ms <= r.close_ms:
                queue_step(body, r.kind, int(r.ts_ms), int(r.order_id), int(r.tick), float(r.size))
        self.state.update((json.dumps(_dump(body)), last[0], last[1], late))
        self.handle.registerTimer(int(pdf["close_ms"].max()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            raw, _, _, late = self.state.get()
            self.state.clear()
            yield queue_rows(int(key[0]), _load(raw)).assign(late=late)

    def close(self) -> None:
        pass


def _dump(body: dict) -> dict:
    return {k: [[i, v] for i, v in body[k].items()] for k in body}


def _load(raw: str) -> dict:
    out = {k: {int(i): v for i, v in rows} for k, rows in json.loads(raw).items()}
    for o in out["orders"].values():
        o["seq"] = tuple(o["seq"])
    return out


def queue_stream(events: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Resting orders of each market as it closes; ``events`` as for queue_replay, with close_ms and an event time ``ts``.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.withWatermark("ts", lateness).select("market_id", "ts", "ts_ms", "seq", "kind", "order_id", "tick", "size", "close_ms")
    return rows.groupBy("market_id").transformWithStateInPandas(QueueProcessor(), outputStructType=QUEUE_OUT + ", late bigint", outputMode="append", timeMode="EventTime")


def panel_stream(events: DataFrame, size: str, slide: str | None = None, lateness: str = "1 minute") -> DataFrame:
    """Counts and amounts by event-time window and kind; rows later than the watermark drop out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", lateness).groupBy(w, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n", "size")


def session_stream(events: DataFrame, gap: str, lateness: str = "1 minute") -> DataFrame:
    """Stretches of activity of each market, ended by a gap."""
    out = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "market_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("market_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
