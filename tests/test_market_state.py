"""Books at any time, throttles, ledgers, orders, windows, records, an archive day and joins as they lie, against plain loops."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F


def plain_book(events, at):
    """The ladders after all events up to ``at``: {(ladder, ticks): (size, ts)}."""
    book = {}
    for ts, _seq, kind, ladder, ticks, size in events:
        if ts > at:
            break
        if kind == "snapshot":
            book = {k: v for k, v in book.items() if k[0] != ladder} | {(ladder, t): (s, ts) for t, s in size if s > 0}
        elif kind == "change":
            book.pop((ladder, ticks), None)
            if size > 0:
                book[ladder, ticks] = (size, ts)
        else:
            worse = (lambda t: t < ticks) if ladder == "asks" else (lambda t: t > ticks)
            book = {k: v for k, v in book.items() if not (k[0] == ladder and worse(k[1]) and v[1] < ts)}
    return book


def test_books_at_any_time(spark):
    from tickloom.operators import book

    rng = random.Random(3)
    events, ts = [], 0
    for seq in range(900):
        ts += rng.choice([0, 0, 1, 3])
        kind = rng.choices(["change", "snapshot", "bound"], [12, 1, 3])[0]
        ladder = rng.choice(["asks", "bids"])
        levels = [] if rng.random() < 0.2 else [(t, rng.randint(0, 9)) for t in rng.sample(range(0, 10_001, 500), 5)]
        events.append((ts, seq, kind, ladder, rng.choice([0, 10_000, *range(100, 10_000, 700)]) if kind == "bound" else rng.randrange(0, 10_001, 500), levels if kind == "snapshot" else rng.randint(-1, 5)))
    changes = [("m", e[0], e[1], e[2] == "snapshot", e[3], t, float(s)) for e in events if e[2] != "bound" for t, s in ((e[5] or [(None, 0)]) if e[2] == "snapshot" else [(e[4], e[5])])]
    rows = spark.createDataFrame(changes, "market_id string, ts_ms long, seq long, snapshot boolean, ladder string, ticks int, size double")
    bounds = spark.createDataFrame([("m", e[0], e[1], e[3], e[4]) for e in events if e[2] == "bound"], "market_id string, ts_ms long, seq long, ladder string, ticks int")
    spans = book.level_spans(rows, ["market_id"], ["seq", "ticks"], bounds, same=("seq",))
    asked = spark.createDataFrame([("m", i, t) for i, t in enumerate(range(-1, ts + 2, 7))], "market_id string, id int, at long")
    got = {}
    for r in book.book_at(asked, spans, ["market_id"], "at").collect():
        got.setdefault(r.id, {})[r.ladder, r.ticks] = (r["size"], r.ts_ms)
    for r in asked.collect():
        assert got.get(r.id, {}) == plain_book(events, r["at"]), r
    by_event = book.level_spans(rows, ["market_id"], ["seq", "ticks"], bounds, place="seq", same=("seq",))
    for seq in (10, 333, 899):
        there = by_event.where((F.col("from_at") <= seq) & (F.col("to_at").isNull() | (F.col("to_at") > seq))).collect()
        assert {(r.ladder, r.ticks): (r["size"], r.ts_ms) for r in there} == plain_book(events[: seq + 1], 10**9)


def test_fills_from_the_book_of_their_time(spark):
    from tickloom.functions.prices import quote_guard
    from tickloom.operators import book

    levels = [("asks", 5000, 100.5), ("asks", 5100, 200.0), ("asks", 5500, 400.0), ("bids", 4900, 150.0), ("bids", 4800, 200.0)]
    spans = spark.createDataFrame([("m", lad, t, s, 10, 10, 60 if t == 5000 else None) for lad, t, s in levels], "k string, ladder string, ticks int, size double, ts_ms long, from_at long, to_at long")
    orders = [(1, 20, 250.0, 5500, False, False), (2, 20, 500.0, 5100, False, False), (3, 20, 100.0, 4500, False, False), (4, 20, 5000.0, 10_000, False, True), (5, 20, 100.0, None, True, False), (6, 20, 400.0, 4850, True, False), (7, 70, 100.0, 5500, False, True), (8, 5, 1.0, 5500, False, False)]
    rows = spark.createDataFrame([("m", *o) for o in orders], "k string, order_id int, at long, qty double, limit_ticks int, reduce_only boolean, fok boolean")
    got = {r.order_id: (r.filled, r.quoted_ticks, r.worst_ticks, r.levels_walked) for r in book.fills_at(rows, spans, ["k"], "at").collect()}
    assert got == {1: (250.0, 5000, 5100, 2), 2: (300.5, 5000, 5100, 2), 3: (0.0, 5000, None, 0), 4: (0.0, None, None, 0), 5: (100.0, 4900, 4900, 1), 6: (150.0, 4900, 4900, 1), 7: (100.0, 5100, 5100, 1), 8: (0.0, None, None, 0)}
    q = spark.createDataFrame([(0.5, 0.5, 5, 9, False), (0.5, None, 5, 9, False), (0.6, 0.5, 5, 9, False), (0.5, 0.5, None, 9, False), (0.5, 0.5, 1, 9, True)], "u double, d double, t long, s long, r boolean")
    guard = lambda **k: [r[0] for r in q.select(quote_guard(F.col("u"), F.col("d"), [F.col("t"), F.col("s")], F.lit(10), reduce_only=F.col("r"), **k)).collect()]
    assert guard(ask_sum=(0.9, 1.0)) == [None, "quote_guard", "quote_guard", None, None]
    assert guard(max_age_ms=5) == [None, None, None, "quote_guard", None] and guard(max_age_ms=5, include_exits=True)[4] == "quote_guard"


def test_sequences_keep_fractions(spark):
    from tickloom.operators import book

    orders = spark.createDataFrame([("b", 1, 0.5, 100), ("b", 2, 1.7, 100), ("b", 3, 9.0, 100)], "k string, id int, qty double, limit_ticks int")
    for kind in ("int", "double"):
        levels = spark.createDataFrame([("b", "asks", 50, 2), ("b", "asks", 90, 1)], "k string, ladder string, ticks int, size int").withColumn("size", F.col("size").cast(kind))
        got = [r.filled for r in book.take_in_sequence(orders, levels, ["k"], ["id"]).orderBy("id").collect()]
        assert got == pytest.approx([0.5, 1.7, 0.8])


def test_opening_quotes_of_one_state(spark):
    from tickloom.operators import book

    tops = spark.createDataFrame([("m", 1, "UP", 40), ("m", 2, "UP", None), ("m", 3, "DOWN", 55), ("m", 4, "UP", 45), ("n", 1, "UP", 40)], "m string, ts int, side string, ask_ticks int")
    assert [tuple(r) for r in book.opening_quotes(tops, "m", ["ts"]).collect()] == [("m", 45, 55)]


def test_locked_mean(spark):
    from tickloom.operators.temporal import twap_at

    # the window is [40 s, 100 s); a value at 50 s comes twice, one comes late, the close's own value doesn't count
    ticks = [(39_000, 39_100, 1.0), (40_000, 40_100, 10.0), (50_000, 50_200, 20.0), (50_000, 50_300, 99.0), (60_000, 66_000, 30.0), (100_000, 100_050, 500.0)]
    rows = spark.createDataFrame([("m", f, a, v, 100_000, 60_000) for f, a, v in ticks], "k string, ts_ms long, arrived_ms long, value double, close long, back long")
    asked = spark.createDataFrame([("m", t, 100_000, 60_000) for t in (39_500, 40_050, 40_500, 51_000, 65_000, 66_000, 101_000)], "k string, now long, close long, back long")
    got = {r.now: r for r in twap_at(asked, rows, "k", "now", "close", "back").collect()}
    assert got[39_500].twap is None and got[40_050].twap is None
    assert (got[40_500].twap, got[40_500].samples, got[40_500].coverage) == (10.0, 1, 1.0) and got[40_500].projected == pytest.approx(10.0)
    assert (got[51_000].twap, got[51_000].samples, got[51_000].coverage, got[51_000].projected) == (15.0, 2, 2 / 11, None)
    assert got[66_000].twap == 20.0 and got[66_000].last_ts_ms == 60_000
    assert (got[101_000].samples, got[101_000].elapsed_ms, got[101_000].last_ts_ms) == (3, 60_000, 100_000)


def test_throttle_is_the_plain_rule(spark):
    from tickloom.operators.temporal import throttle

    rng = random.Random(5)
    rows = [(k, t, i) for k in ("a", "b", None) for i, t in enumerate(sorted(rng.choices(range(3000), k=400)))] + [("c", t, t) for t in range(0, 2000, 3)] + [("d", None, 1)]
    want, last = set(), {}
    for k, t, i in rows:
        if t is not None and (k not in last or t - last[k] >= 50):
            want.add((k, t, i))
            last[k] = t
    got = throttle(spark.createDataFrame(rows, "k string, t long, i long"), "k", "t", 50, ["i"])
    assert {tuple(r) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
    gaps = throttle(spark.createDataFrame(rows, "k string, t long, i long"), "k", "t", F.when(F.col("k") == "a", 50).otherwise(1000), ["i"])
    assert {tuple(r) for r in gaps.where("k = 'a'").collect()} == {x for x in want if x[0] == "a"}


def test_ledger_of_pieces(spark):
    from tickloom.operators.ledger import positions

    rng = random.Random(6)
    rows, want = [], {}
    for leg in ("a", "b", "c"):
        size = cost = realised = 0
        for i in range(300):
            q, t = rng.choice([5, 3, -4, -9, 2, 0]), rng.randint(1, 9999)
            rows.append((leg, i, q, t, 1))
            if q >= 0:
                size, cost, realised = size + q, cost + q * t, realised - 1
            else:
                cut = min(-q, size)
                basis = cost * cut // size if size else 0
                size, cost, realised = size - cut, cost - basis, realised + cut * t - basis - 1
        want[leg] = (size, cost, realised)
    got = positions(spark.createDataFrame(rows, "leg string, i int, qty int, ticks int, fee int").repartition(3), ["leg"], ["i"])
    assert {r.leg: (r["size"], r.cost, r.realised) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_positions_in_one_order(spark):
    from tickloom.operators.ordering import position

    values = random.Random(7).choices(range(500), k=3000)
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, -1)], "v int, i int").repartition(7)
    got = position(rows, ["v", "i"]).collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.place)] == [(None, -1), *sorted((v, i) for i, v in enumerate(values))]
    assert sorted(r.place for r in got) == list(range(3001)) and position(rows.limit(0), ["v"]).count() == 0


def test_window_algebra(spark):
    from tickloom.plans import windows as w

    of = lambda rows: spark.createDataFrame([("k", *r) for r in rows], "k string, start int, end int")
    a, b = of([(0, 10), (5, 12), (12, 15), (30, None), (40, 40)]), of([(None, 3), (8, 13), (35, 50), (9, 7)])
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect()) if "names" in df.columns else sorted([(r.start, r.end) for r in df.collect()], key=lambda x: (x[0] is not None, x[0]))
    pieces = [(r.start, r.end, "".join(r.names)) for r in w.overlay({"a": a, "b": b}, ["k"]).collect()]
    assert sorted(pieces, key=lambda x: (x[0] is not None, x[0])) == [(None, 0, "b"), (0, 3, "ab"), (3, 8, "a"), (8, 13, "ab"), (13, 15, "a"), (30, 35, "a"), (35, 50, "ab"), (50, None, "a")]
    assert rows(w.union(a, b, ["k"])) == [(None, 15), (30, None)] and rows(w.intersection(a, b, ["k"])) == [(0, 3), (8, 13), (35, 50)]
    assert rows(w.difference(a, b, ["k"])) == [(3, 8), (13, 15), (30, 35), (50, None)] and rows(w.difference(a, a, ["k"])) == []
    wanted = spark.createDataFrame([("2025-01-0%d" % i, x) for i in (1, 2, 3) for x in ("book", "bbo")], "day string, dataset string")
    captured = spark.createDataFrame([("bbo", "2025-01-02", "2025-01-02"), ("bbo", "2025-01-02", None)], "dataset string, first string, last string")
    assert sorted(tuple(r) for r in w.usable_datasets(wanted, captured, ["bbo"]).collect()) == [("2025-01-01", "book"), ("2025-01-02", "bbo"), ("2025-01-02", "book"), ("2025-01-03", "bbo"), ("2025-01-03", "book")]


def test_records_are_counted_in_one_pass(spark):
    from tickloom.sources import records

    fill = {"market_id": "m", "side": "UP", "requested": 5, "filled": 2, "tag": "t" * 99, "liquidity": "other", "fee": "1"}
    lines = [json.dumps(fill), json.dumps({**fill, "unfilled": 1.5, "action": "reduce"}), "{", "[]", "  ", "", json.dumps({**fill, "market_id": ""}), json.dumps({**fill, "side": None}), json.dumps({**fill, "filled": "2"}), json.dumps(fill) + "}", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got, seen = records.counted_records(rows, "fill")
    first, second = sorted(got.collect(), key=lambda r: r.i)
    assert (first.unfilled, first.tag, first.liquidity, first.fee, first.action) == (3.0, "t" * 64, "taker", 0.0, "open") and (second.unfilled, second.action) == (1.5, "reduce")
    assert seen.get == {"rows": 2, "malformed": 3, "market_id": 1, "side": 1, "requested": 0, "filled": 1}
    key = {"key": "k", "cash": 1, "marked": 2.5, "position_value": 0, "final": False}
    rows = spark.createDataFrame([(i, json.dumps({**key, "ts": i})) for i in range(50)] + [(99, "x")], "i int, value string").repartition(4)
    got, seen = records.counted_records(rows, "record", order=("i",), max_rows=20)
    assert sorted(r.i for r in got.collect()) == list(range(20)) and seen.get["truncated"] == 30 and seen.get["malformed"] == 1
    kept, seen = records.sifted(spark.range(100).toDF("t"), {"early": F.col("t") < 10, "late": F.col("t") > 89, "never": F.lit(None).cast("boolean")})
    assert kept.count() == 80 and seen.get == {"kept": 80, "early": 10, "late": 10, "never": 0}


def test_single_token_books_and_missing_datasets(spark):
    from tickloom.operators import decode

    m = spark.createDataFrame([("m", "s", "BTC", "u", "d", "prices", None, 0, 1000)], "market_id string, slug string, asset string, token_up string, token_down string, stream string, price_feed_id long, open_ms long, close_ms long")
    books = [("m", "s", "d", 10, '{"asks": [["0.3", "5"]], "bids": []}', 1), ("m", "s", "x", 20, '{"asks": [["0.4", "5"]]}', 2), ("m", "s", None, 30, '{"asset_id": "u", "bids": [["0.6", "5"]]}', 3)]
    rows = spark.createDataFrame(books, "condition_id string, slug string, asset_id string, ts_ms long, payload string, seq long")
    got = decode.day_events(m, {}, books=rows).orderBy("pos").collect()
    assert [(r.side, r.levels.UP is None, r.levels.DOWN is None) for r in got] == [("DOWN", True, False), ("UP", False, True)]
    assert got[0].levels.DOWN.asks[0].px == 0.3 and got[1].levels.UP.bids[0].px == 0.6
    assert decode.day_events(m, {}).count() == 0
    changes = spark.createDataFrame([("m", "s", t, json.dumps({"price_changes": [{"asset_id": "u", "side": "BUY", "price": "0.5", "size": s}]}), t) for t, s in ((1, "1"), (50, "2"), (101, "0"), (150, "-1"), (230, "3"))], "condition_id string, slug string, ts_ms long, payload string, seq long").withColumn("asset_id", F.lit("u"))
    assert [r.ts_ms for r in decode.day_events(m, {}, changes=changes).orderBy("pos").collect()] == [1, 50, 101, 230]
    assert [r.ts_ms for r in decode.day_events(m, {}, changes=changes, throttles={"changes": 100}).orderBy("pos").collect()] == [1, 101, 230]
    slugs = spark.createDataFrame([("z", "s", 1), ("a", "s", 2)], "market_id string, slug string, seq long")
    assert decode.with_market(spark.createDataFrame([(None, "s")], "condition_id string, slug string"), slugs, "condition_id", "slug").first().market_id == "a"


def test_archive_day_opens_only_its_files(spark, tmp_path):
    from tickloom.sources import archive

    def put(rel, lines):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress("".join(x + "\n" for x in lines).encode()) if rel.endswith(".gz") else "".join(x + "\n" for x in lines).encode())

    day, t0 = "2025-01-02", 1_735_776_000
    market = {"condition_id": "c1", "slug": "s1", "asset": "BTC", "interval_sec": 900, "strike_value": "1" + "0" * 18, "resolved": True, "outcome_prices": ["1", "0"], "start_sec": t0, "end_sec": t0 + 900, "token_ids": ["u", "d"], "raw": {"cryptoMarketConfig": {}, "feesEnabled": False}}
    at = lambda s: (t0 + s) * 1000
    put(f"data/polymarket/crypto/markets/BTC-15m/{day}.jsonl.gz", [json.dumps({**market, "slug": "old"}), json.dumps(market), json.dumps({**market, "condition_id": "e1", "asset": "ETH"})])
    put(f"data/polymarket/crypto/book/BTC-15m/{day}.jsonl.gz", ["", json.dumps({"condition_id": "c1", "asset_id": "u", "event_ts_ms": at(5), "payload": {"asks": [["0.5", "3"]], "bids": []}}), "{", json.dumps({"condition_id": "c1", "asset_id": "d", "event_ts_ms": at(2000), "payload": {}})])
    put(f"data/polymarket/crypto/last_trade_price/BTC-15m/{day}.csv.gz", ["condition_id,slug,asset_id,event_ts_ms,price,size,side", f"c1,s1,u,{at(7)},0.5,2,BUY", f",s1,d,{at(8)},0.4,1,sell"])
    put(f"data/chainlink-prices/x/y/BTC-USD/{day}.jsonl", [json.dumps({"feed_ts_ms": at(6), "value": 50_000.5})])
    broken = [f"data/polymarket/crypto/book/BTC-15m/2025-01-03.jsonl.gz", f"data/polymarket/crypto/book/ETH-15m/{day}.jsonl.gz", f"data/polymarket/crypto/book/BTC-5m/{day}.jsonl.gz", f"data/chainlink-twap-30s/x/y/BTC-USD/{day}.jsonl.gz", f"data/predict-fun/orderbook/BTC-15m/{day}.jsonl.gz"]
    for rel in broken:  # opening one of these fails
        put(rel, [])
        (tmp_path / rel).write_bytes(b"\x1f\x8b broken")
    markets, events = archive.load_day(spark, str(tmp_path), day, assets=["BTC"], intervals=["15m"])
    assert [(r.market_id, r.slug) for r in markets.collect()] == [("c1", "s1")]
    got = [(r.kind, r.ts_ms - at(0), r.side, r.px, r.taker, r.value) for r in events.orderBy("pos").collect()]
    assert got == [("book", 5000, "UP", None, None, None), ("tick", 6000, None, None, None, 50_000.5), ("trade", 7000, "UP", 0.5, "BUY", None), ("trade", 8000, "DOWN", 0.4, "SELL", None)]
    opened = {f.split("/data/")[1] for f in events.inputFiles()}
    assert not {b.removeprefix("data/") for b in broken} & opened
    _, spots = archive.load_day(spark, str(tmp_path), day, datasets=["settlement", "spot"], assets=["BTC"], intervals=["15m"])
    assert sorted(r.kind for r in spots.collect()) == ["spot", "tick"]
    none, nothing = archive.load_day(spark, str(tmp_path), "2025-02-02")
    assert none.count() == nothing.count() == 0


def test_long_and_open_spans(spark):
    from tickloom.operators.temporal import within

    rng = random.Random(8)
    spans = [(i, rng.choice([None, rng.randrange(10**9)]) if i % 50 == 0 else (s := rng.randrange(10**9)), None if i % 60 == 0 else s + rng.choice([0, 5, 3000, 10**8]) if i % 50 else 10**9) for i in range(300)]
    points = [(i, rng.randrange(10**9)) for i in range(300)] + [(300 + i, s[1]) for i, s in enumerate(spans[:100]) if s[1] is not None]
    got = within(spark.createDataFrame(points, "p int, t long"), spark.createDataFrame(spans, "s int, a long, b long"), "t", "a", "b")
    want = {(p, s) for p, t in points for s, a, b in spans if (a is None or a <= t) and (b is None or t <= b)}
    rows = got.select("p", "s").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_tables_that_meet_as_they_lie(spark, tmp_path):
    from tickloom.operators.temporal import replay_order
    from tickloom.sources.sinks import write_colocated

    rows = spark.range(2000).select((F.col("id") % 17).alias("market_id"), (F.col("id") * 7919 % 1000).alias("ts_ms"), F.lit("book").alias("kind"), F.col("id").alias("seq"))
    name = f"colocated_{random.randrange(10**9)}"
    write_colocated(rows, name, "market_id", ["ts_ms", "seq"], 4)
    table = spark.table(name)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in (replay_order(table), table.alias("a").join(table.alias("b"), "market_id"), table.groupBy("market_id").count()):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        key = lambda df: sorted((r.seq, r.pos) for r in df.collect())
        assert key(replay_order(table)) == key(replay_order(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_stream_of_spans(spark, tmp_path):
    from tickloom.operators.temporal import within
    from tickloom.streaming.spans import stream_within

    at = lambda c: F.timestamp_seconds(F.col(c) + 1_700_000_000)
    points = spark.range(600).select((F.col("id") % 3).alias("asset"), (F.col("id") * 37 % 5000).alias("t"), F.col("id").alias("p"))
    spans = spark.range(60).select((F.col("id") % 3).alias("asset"), (F.col("id") * 80).alias("a"), (F.col("id") * 80 + 300).alias("b"), F.col("id").alias("s"))
    for name, df in (("p", points.withColumn("ts", at("t"))), ("s", spans.withColumn("open", at("a")).withColumn("close", at("b")))):
        df.write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    out = stream_within(read("p"), read("s"), "ts", "open", "close", ["asset"], "10 minutes")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = {(r.p, r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = within(points, spans, "t", "a", "b", keys=["asset"])
    assert got == {(r.p, r.s) for r in want.collect()} and got


def test_feed_names_lines_and_time_columns(spark):
    from tickloom.sources import archive, paths

    names = [" Binance:BTCUSDT:spot:1s ", "binance:hypeusdt:spot:1s", "binance:btcusdt:perp:1s", "binance:btcusdt:spot:1s:x", "binance:btcusdt", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(paths.reference_feed(F.col("n"))).collect()]
    assert got[0] == ("binance:btcusdt:spot:1s", "btcusdt", "spot", "1s") and got[1:] == [None] * 5
    lines = spark.createDataFrame([('{"kind":"trade","x":1}',), (' {"kind":"book"}\r',), ("  ",), ('{"x":1,"kind":"trade"}',)], "value string")
    assert [r[0] for r in archive.event_lines(lines, drop_trades=True).collect()] == ['{"kind":"book"}', '{"x":1,"kind":"trade"}'] and archive.event_lines(lines).count() == 3
    of = lambda *v: spark.createDataFrame([(x, "1") for x in v], "id string, px string")
    with pytest.raises(ValueError, match="no column holds times"):
        archive.series(of("17", "18"))
    assert [r.ts_ms for r in archive.series(of("1735776000", "x")).collect()] == [1_735_776_000_000]
    with pytest.raises(ValueError, match="no column holds times"):
        archive.series(of("9" * 40))


def test_panels_of_no_rows_and_ties(spark):
    from tickloom.operators import decode, report

    cells = spark.createDataFrame([(1, 3, 2.0), (1, None, 5.0), (2, 10, None)], "y int, x int, v double")
    assert report.sweep(cells, "y", "x", "v").columns == ["y", "x_3", "x_10"]
    assert tuple(report.sweep_extent(cells.limit(0), "y", "x", "v").first()) == (0, [], [], None, None)
    log = spark.createDataFrame([(i, "é" * 10) for i in range(9)], "i int, line string")
    assert sorted(r.i for r in report.log_budget(log, ["i"], chars=4, limit=28).collect()) == [0, 1, 2, 3]  # 9 bytes each; the last one may pass the limit
    keys = spark.createDataFrame([("d1", "BTC", "5m"), ("d1", "ETH", None), ("d2", "BTC", "5m")], "day string, asset string, interval string")
    got = {r.day: (r.cover, r.without) for r in decode.coverage(keys, keys.where("asset = 'BTC' AND day = 'd1'"), ["day", "asset", "interval"]).collect()}
    assert got == {"d1": ("partial", ["ETH"]), "d2": ("none", None)}
    trades = spark.createDataFrame([("m", 5, 2), ("n", -7, 2), ("x", 7, 2)], "market_id string, pnl long, size int")
    meta = spark.createDataFrame([("m", "BTC", "5m"), ("n", "ETH", None)], "market_id string, asset string, interval string")
    assert [tuple(r) for r in report.split_by_market(trades, meta).orderBy("place").collect()] == [("ETH", -7, 1, 1), ("unknown", 7, 1, 2), ("BTC 5m", 5, 1, 3)]


def test_report_bundle(spark, tmp_path):
    import hashlib
    import zipfile

    from tickloom.sources.sinks import write_report

    panel = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "bucket int, name string")
    trades = spark.range(100).toDF("id")
    sums = write_report(tmp_path / "r.zip", {"pnl": 1.5}, {"calibration": panel}, "first line\n", {"full": ["d1"]}, {"trades": trades}, str(tmp_path / "tables"))
    with zipfile.ZipFile(tmp_path / "r.zip") as z:
        assert sorted(z.namelist()) == ["calibration.csv", "coverage.json", "logs.txt", "report.json", "sha256sums.txt"]
        assert json.loads(z.read("report.json")) == {"pnl": 1.5, "tables": {"trades": str(tmp_path / "tables") + "/trades"}} and z.read("logs.txt") == b"first line\n"
        assert z.read("calibration.csv").decode("utf-8-sig") == 'bucket,name\n1,"a ""b"", c"\n2,\n'
        assert all(hashlib.sha256(z.read(n)).hexdigest() == h for n, h in sums.items())
    assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "trades")).count() == 100
    first = (tmp_path / "r.zip").read_bytes()
    write_report(tmp_path / "r.zip", {"pnl": 1.5}, {"calibration": panel}, "first line\n", {"full": ["d1"]}, {"trades": trades}, str(tmp_path / "tables"))
    assert (tmp_path / "r.zip").read_bytes() == first
