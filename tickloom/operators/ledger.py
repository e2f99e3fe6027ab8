"""Positions at average cost, and resting orders behind a queue: folds of each key's events in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.prices import EPS

LEG = "size bigint, cost bigint, realised bigint"


def positions(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, size, cost, realised, avg_ticks) after all fills of a leg, in whole ticks.

    ``fills`` has signed qty (below 0 reduces, never past flat), ticks and fee. A reduction takes
    cost in proportion, rounded down to whole ticks.

    A leg is cut where it is flat. How much is held after each fill is a running sum, less the lowest it ever fell
    below zero, so flat points are found by windows. The pieces between them pass through tasks as ordered streams
    that keep three numbers; what they realised adds up, and a leg's last piece has its size and cost.
    """
    places = [f"_o{i}" for i in range(len(order))]
    steps = fills.select(*keys, *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)], *[F.col(c).cast("bigint").alias(a) for c, a in (("qty", "_q"), ("ticks", "_t"), ("fee", "_f"))])
    by_leg = Window.partitionBy(*keys).orderBy(*places)
    upto, before = by_leg.rowsBetween(Window.unboundedPreceding, 0), by_leg.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_sum", F.sum("_q").over(upto))
    held = F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0))
    pieces = steps.withColumn("_flat", (held == 0).cast("bigint")).withColumn("_piece", F.coalesce(F.sum("_flat").over(before), F.lit(0)))
    cut = pieces.select(*keys, "_piece", *places, "_q", "_t", "_f").repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", *places)
    folded = cut.mapInArrow(_fold_pieces(list(keys)), ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in keys) + ", _piece bigint, " + LEG)
    last = F.max_by(F.struct("size", "cost"), "_piece")
    out = folded.groupBy(*keys).agg(last.alias("_x"), F.sum("realised").alias("realised")).select(*keys, "_x.size", "_x.cost", "realised")
    return out.withColumn("avg_ticks", F.when(F.col("size") > 0, F.col("cost") / F.col("size")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _fold_pieces(keys: list[str]):
    """(keys, piece, size, cost, realised) of each piece in batches that are ordered by keys, piece and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size, cost, realised, schema = None, 0, 0, 0, None
        for batch in batches:
            schema = pa.schema([batch.schema.field(k) for k in [*keys, "_piece"]] + [pa.field(c, pa.int64()) for c in ("size", "cost", "realised")])
            names = zip(*[batch.column(k).to_pylist() for k in [*keys, "_piece"]], strict=True)
            out = []
            for own, q, t, f in zip(names, *[batch.column(c).to_pylist() for c in ("_q", "_t", "_f")], strict=True):
                if own != piece:
                    if piece is not None:
                        out.append((*piece, size, cost, realised))
                    piece, size, cost, realised = own, 0, 0, 0
                if q >= 0:
                    size, cost, realised = size + q, cost + q * t, realised - f
                else:
                    cut = min(-q, size)
                    basis = cost * cut // size if size else 0
                    size, cost, realised = size - cut, cost - basis, realised + cut * t - basis - f
            yield _batch(out, schema)
        if piece is not None:
            yield _batch([(*piece, size, cost, realised)], schema)

    return run


def settle(legs: DataFrame, markets: DataFrame, side: str = "side") -> DataFrame:
    """``legs`` of settled markets with value and pnl in ticks: contracts pay 1, 0 or a half, without a fee."""
    from tickloom.functions.prices import contract_value

    paid = (contract_value(F.col(side), F.col("outcome")) * 10_000).cast("bigint") * F.col("size")
    return legs.join(markets.select("market_id", "outcome"), "market_id").where("outcome IS NOT NULL").withColumns({"value": paid, "pnl": F.col("realised") + paid - F.col("cost")})


PRINT_LAG_MS = 800
QUEUE_OUT = "market_id bigint, order_id bigint, filled double, ahead double, state string, last_ms bigint"


def queue_step(state: dict, kind: str, ts: int, oid: int, tick: int, size: float) -> None:
    """One event of a book side into the resting orders' state.

    ``join`` queues an order behind the visible size of its tick. ``level`` shows a tick's new
    size: it can only shorten the queue ahead. ``trade`` sells into the side, the best price
    first: at each tick first what a level change already showed gone in the last PRINT_LAG_MS,
    then the queue ahead, then the orders in turn. ``cancel`` takes effect after PRINT_LAG_MS.
    """
    levels, shown, orders = state["levels"], state["shown"], state["orders"]
    for o in orders.values():
        if o["state"] == "cancel_pending" and ts >= o["until"]:
            o["state"] = "cancelled"
    live = [o for o in orders.values() if o["state"] in ("live", "cancel_pending")]
    if kind == "join":
        orders[oid] = {"tick": tick, "left": size, "filled": 0.0, "ahead": levels.get(tick, 0.0), "state": "live", "seq": (ts, oid), "last": None, "until": None}
    elif kind == "cancel" and oid in orders and orders[oid]["state"] == "live":
        orders[oid].update(state="cancel_pending", until=ts + PRINT_LAG_MS)
    elif kind == "level":
        drop = levels.get(tick, 0.0) - size
        if drop > 0:
            shown.setdefault(tick, []).append([ts, drop])
        levels[tick] = size
        for o in live:
            if o["tick"] == tick:
                o["ahead"] = min(o["ahead"], size)
    elif kind == "trade":
        budget = size
        for t in sorted({o["tick"] for o in live if o["tick"] >= tick}, reverse=True):
            known = [x for x in shown.get(t, []) if ts - x[0] <= PRINT_LAG_MS]
            for x in known:
                used = min(x[1], budget)
                x[1] -= used
                budget -= used
            shown[t] = [x for x in known if x[1] > EPS]
            passed = 0.0
            for o in sorted((o for o in live if o["tick"] == t), key=lambda o: o["seq"]):
                ahead = min(max(o["ahead"] - passed, 0.0), budget)
                passed += ahead
                budget -= ahead
                o["ahead"] = max(o["ahead"] - passed, 0.0)
                got = min(o["left"], budget)
                if got > EPS:
                    budget -= got
                    o["left"] -= got
                    o["filled"] += got
                    o["last"] = ts
                    if o["left"] <= EPS:
                        o["state"] = "filled"


def queue_rows(market: int, state: dict) -> pd.DataFrame:
    rows = [(market, i, o["filled"], o["ahead"], "expired" if o["state"] == "live" else o["state"], o["last"]) for i, o in sorted(state["orders"].items())]
    return pd.DataFrame(rows, columns=["market_id", "order_id", "filled", "ahead", "state", "last_ms"]).astype({"last_ms": "Int64"})


def queue_replay(events: DataFrame) -> DataFrame:
    """Resting orders of each market after its events: (market_id, order_id, filled, ahead, state, last_ms).

    ``events`` has market_id, ts_ms, seq, kind (join, cancel, level, trade), order_id, tick and size.
    A market is one group, folded in order, for its lifetime of minutes to a day; markets run side by side.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {"levels": {}, "shown": {}, "orders": {}}
        for r in pdf.sort_values(["ts_ms", "seq"]).itertuples(index=False):
            queue_step(state, r.kind, int(r.ts_ms), int(r.order_id), int(r.tick), float(r.size))
        return queue_rows(int(key[0]), state)

    return events.select("market_id", "ts_ms", "seq", "kind", "order_id", "tick", "size").groupBy("market_id").applyInPandas(fold, QUEUE_OUT)
