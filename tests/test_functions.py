"""Expressions, decoding, files and planning on hand-made rows."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tickloom.functions import parsing as P
from tickloom.functions import prices as X
from tickloom.operators import book, decode, ledger, report, temporal
from tickloom.operators.running import running
from tickloom.plans import data as plans
from tickloom.sources import archive, paths, sinks


def values(spark, cells, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_cells(spark):
    assert values(spark, ["", " ", "1.5", " 2 ", "x", "NaN", "Infinity", None, "-0"], P.num) == [None, None, 1.5, 2.0, None, None, None, None, -0.0]
    assert values(spark, ["1.5", ".5", "1e3", "0x10", " 1", "1.", "NaN"], P.strict_decimal) == [1.5, 0.5, 1000.0, None, None, 1.0, None]
    ms = ["1700000000000", "2026-01-02T03:04:05.678Z", "2026-01-02T03:04:05.6789+01:00", "2026-01-02T03:04:05", "2026-02-31T00:00:00Z", "5", "9999999999999", "2026-01-02T03:04:05Z"]
    assert values(spark, ms, P.time_ms) == [1700000000000, 1767323045678, 1767319445678, None, None, None, None, 1767323045000]
    assert values(spark, ["1700000000", "1700000000123", "1700000000123456", "abc"], P.epoch_ms) == [1700000000000, 1700000000123, 1700000000123, None]
    got = values(spark, ['[[0.5,10],["0.4","x"],[2,1]]', '[{"price":"0.5","size":"1"}]', "0.5:10|bad|0.6:0", None], lambda c: P.ladder(P.parse_levels(c)))
    assert [[(x.px, x["size"]) for x in g] if g is not None else None for g in got] == [[(0.5, 10.0)], [(0.5, 1.0)], [(0.5, 10.0)], None]
    got = values(spark, ["0.5:1|0.6:2", "0.5:1|0.50000001:2", "0.5:1|x:2"], lambda c: P.strict_ladder(P.parse_levels(c)).isNotNull())
    assert got == [True, False, False]
    assert values(spark, ['{"a":null}', "{}", None, "[1]"], lambda c: P.has_key(c, "a")) == [True, False, False, False]


def test_prices(spark):
    assert values(spark, [0.00005, 0.5, 0.99995, 1.0], X.to_ticks, "double") == [1, 5000, 10000, 10000]
    assert values(spark, [0.5, -0.5, 1.5, -1.5, 2.4], X.round_half_up, "double") == [1, 0, 2, -1, 2]
    assert values(spark, [60, 300, 900, 3600, 86400, 90, None, 0], X.interval_label, "int") == ["1m", "5m", "15m", "1h", "1d", "90s", None, None]
    assert values(spark, ["UP", "DOWN", "TIE", None], lambda o: X.contract_value(F.lit("UP"), o)) == [1.0, 0.0, 0.5, None]
    assert values(spark, [1.239999999, 2.0], X.floor_cents, "double") == [1.23, 2.0]
    for model in ("power", "power2", "power3", "log", "log2"):
        p = values(spark, [1.0, 10.0, 0.0, -1.0], lambda a, m=model: X.queue_probability(a, F.lit(5.0), m), "double")
        assert 0 <= p[1] < p[0] <= 1 and p[2:] == [None, None]
    with pytest.raises(ValueError):
        X.queue_probability(F.lit(1.0), F.lit(1.0), "other")
    rules = spark.createDataFrame([(0.01, 5.0), (0.00005, 5.0), (0.01, 0.0), (None, 1.0)], "t double, m double")
    assert [r.ok for r in rules.select(X.market_rules_ok(F.col("t"), F.col("m")).alias("ok")).collect()] == [True, False, False, False]


def test_decode(spark):
    raw = "struct<cryptoMarketConfig:struct<twapLookbackSeconds:int>,feesEnabled:boolean,feeSchedule:struct<rate:double,exponent:int>>"
    rows = spark.createDataFrame([("m1", "s1", "BTC", 900, ["t1", "t2"], 100, 1000, True, ["1", "0"], "65000000000000000000000", ((60,), True, (0.07, 1)))],
                                 f"condition_id string, slug string, asset string, interval_sec int, token_ids array<string>, start_sec long, end_sec long, resolved boolean, outcome_prices array<string>, strike_value string, raw {raw}")
    m = decode.polymarket_records(rows)
    r = m.first()
    assert (r.market_id, r.interval, r.strike, r.outcome, r.open_ms, r.stream, r.fee.model) == ("m1", "15m", 65000.0, "UP", 100_000, "twap60s", "rate")
    other = decode.predict_records(spark.createDataFrame([(7, "s7", "BTC", "1h", 3, 1, 2, "5", "5")], "market_id int, category_slug string, asset string, interval_label string, price_feed_id int, start_sec long, end_sec long, start_price string, end_price string"))
    assert other.first().outcome == "TIE"
    feed = spark.createDataFrame([("200000", "1.5"), ("2000000", "1"), ("", "3"), ("300000", "")], "feed_ts_ms string, value string")
    ticks = decode.price_ticks(feed, m, "twap60s")
    assert [(t.market_id, t.ts_ms, t.value) for t in ticks.collect()] == [("m1", 200000, 1.5)]
    frames = spark.createDataFrame([("s1", "t2", 200000, '{"price_changes":[{"asset_id":"t1","side":"SELL","price":"0.5","size":"3"},{"asset_id":"t9","side":"BUY","price":"0.5","size":"3"},{"asset_id":"t2","side":"BUY","price":"1.5","size":"3"}],"asks":[["0.6","5"]],"bids":"0.4:2|0.3:0","best_bid":"0.4","best_ask":"0.3","price":"0.5","size":"2","side":"SELL"}')], "slug string, asset_id string, event_ts_ms long, payload string")
    joined = decode.with_market(frames, m, "asset_id", "slug").join(m.select("market_id", "token_up", "token_down"), "market_id")
    assert [(c.side, c.ladder, c.px, c["size"]) for c in decode.book_changes(joined).collect()] == [("UP", "asks", 0.5, 3.0)]
    snap = decode.two_sided_books(joined).first().levels
    assert [(x.px, x["size"]) for x in snap.UP.asks] == [(0.6, 5.0)] and [(x.px, x["size"]) for x in snap.DOWN.asks] == [(0.6, 2.0)] and [(x.px, x["size"]) for x in snap.DOWN.bids] == [(0.4, 5.0)]
    assert decode.best_bounds(joined).count() == 0
    t = decode.trade_prints(joined).first()
    assert (t.side, t.taker, t.px) == ("DOWN", "SELL", 0.5)
    assert decode.clip(ticks.withColumn("ts_ms", F.lit(5)), m).count() == 0
    ids = spark.createDataFrame([(1, "m1", "t1"), (2, "m1", "x"), (3, "m2", "t1"), (4, None, None)], "seq int, id string, token string")
    tokens = spark.createDataFrame([("m1", "m1"), ("t1", "m1"), ("m2", "m2")], "id string, market_id string")
    assert sorted((r.seq, r.market_id, r.conflict) for r in decode.conflicts(ids, tokens).collect()) == [(1, "m1", False), (2, "m1", False), (3, None, True), (4, None, False)]
    bad = spark.createDataFrame([("m", 1, None), ("m", 2, "late"), ("m", 3, "x"), ("k", 1, None)], "market_id string, seq int, reason string")
    assert [(r.market_id, r.reason, r.bad) for r in decode.poisoned(bad, F.col("reason").isNotNull()).collect()] == [("m", "late", 2)]


def test_open_spans_and_running(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50), ("b", 7)], "k string, ts long")
    spans = spark.createDataFrame([("a", 0, 10), ("a", None, 6), ("b", 7, None)], "k string, start long, end long")
    out = temporal.within(points, spans, "ts", "start", "end", 4, keys=["k"])
    assert sorted(((r.k, r.ts, r.start, r.end) for r in out.collect()), key=str) == [("a", 5, 0, 10), ("a", 5, None, 6), ("b", 7, 7, None)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, -1, 4, -9, 5, 2])], "i long, v long")
    assert [r.s for r in running(df, F.floor(F.col("i") / 2), ["i"], F.col("v"), "s").orderBy("i").collect()] == [3, 2, 6, -3, 2, 4]
    assert [r.s for r in running(df, F.floor(F.col("i") / 2), ["i"], F.col("v"), "s", "max").orderBy("i").collect()] == [3, 3, 4, 4, 5, 5]


def test_book_rules(spark):
    cols = "k int, ladder string, ticks int, size double, ts_ms long, snapshot boolean, seq int"
    rows = [(1, "asks", 50, 5.0, 1, True, 1), (1, "asks", 51, 5.0, 1, True, 2), (1, "asks", 50, 0.0, 2, False, 3), (1, "asks", 52, 7.0, 3, False, 4), (1, "bids", 49, 1.0, 3, False, 5), (1, "asks", 60, 2.0, 9, True, 6)]
    state = book.levels_after(spark.createDataFrame(rows[:5], cols), ["k"], ["seq"])
    assert sorted((r.ladder, r.ticks, r["size"]) for r in state.collect()) == [("asks", 51, 5.0), ("asks", 52, 7.0), ("bids", 49, 1.0)]
    assert [(r.ticks) for r in book.levels_after(spark.createDataFrame(rows, cols), ["k"], ["seq"]).where("ladder = 'asks'").collect()] == [60]
    bounds = spark.createDataFrame([(1, "asks", 52, 2), (1, "bids", 40, 3)], "k int, ladder string, ticks int, ts_ms long")
    assert sorted(r.ticks for r in book.prune(state, bounds, ["k"]).collect()) == [49, 52]  # 51 is older and better; 49 is as old as its bound
    assert sorted(r.ticks for r in book.prune(state, bounds, ["k"], inclusive=True).collect()) == [52]


def test_ledger(spark):
    f = spark.createDataFrame([(1, 1, 10, 40, 0), (1, 2, 10, 60, 1), (1, 3, -5, 70, 0), (1, 4, -99, 80, 0), (2, 1, 4, 30, 0)], "market_id int, seq int, qty int, ticks int, fee int")
    got = {r.market_id: (r["size"], r.cost, r.realised) for r in ledger.positions(f, ["market_id"], ["seq"]).collect()}
    assert got == {1: (0, 0, 5 * 70 + 15 * 80 - 1000 - 1), 2: (4, 120, 0)}
    legs = ledger.positions(f.where("market_id = 2"), ["market_id"], ["seq"]).withColumn("side", F.lit("UP"))
    assert ledger.settle(legs, spark.createDataFrame([(2, "UP")], "market_id int, outcome string")).first().pnl == 40_000 - 120


def test_report_edges(spark):
    none = spark.createDataFrame([], "market_id long, side string, outcome string, size long, entry_ticks long, closed_ms long, opened_ms long, how string, pnl long, o long")
    assert report.summary(none).first().win_rate is None and report.drawdown(report.equity(none, ["o"]), "closed_ms", "equity", ["o"]).first().max_drawdown == 0
    one = spark.createDataFrame([(1, "UP", "UP", 1, 10_000, 10, 0, "settled", -5, 1)], none.schema)
    assert report.calibration(one).count() == 0 and report.daily_ratios(one).first().sharpe is None
    d = report.drawdown(report.equity(one, ["o"]), "closed_ms", "equity", ["o"]).first()
    assert (d.max_drawdown, d.max_drawdown_pct) == (5, None)
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v long")
    assert report.at_share(v, "v", {"m": 0.5}).first().m == 3


def test_files(spark, tmp_path):
    base = tmp_path / "data/polymarket/daily/book/BTC-15m"
    base.mkdir(parents=True)
    (base / "2026-01-02.jsonl").write_text('{"a":1}\n\nbroken\n{"a":2}\n')
    (base / "2026-01-03.jsonl").write_text('{"a":3}\n')
    f = {r.day: r for r in archive.files(spark, str(tmp_path)).collect()}
    assert (f["2026-01-02"].dataset, f["2026-01-02"].asset, f["2026-01-02"].interval) == ("book", "BTC", "15m")
    assert sorted(r.a for r in archive.json_rows(spark, str(tmp_path / "data"), "a int").collect()) == [1, 2, 3]
    lines = [(r.line, r.value) for r in archive.numbered_lines(spark, str(tmp_path / "data")).orderBy("file", "line").collect()]
    assert lines == [(0, '{"a":1}'), (2, "broken"), (3, '{"a":2}'), (0, '{"a":3}')]
    (tmp_path / "s.csv").write_text("when,time,x\nq,1700000000,5\nq,,6\nr,1700000001000,abc\n")
    s = archive.series(archive.csv_rows(spark, str(tmp_path / "s.csv"))).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.x.number, r.x.text) for r in s] == [(1700000000000, 5.0, "5"), (1700000001000, None, "abc")]
    with pytest.raises(ValueError):
        archive.series(spark.createDataFrame([(1, 2)], "time long, kind long"))
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "n int, s string").orderBy("n")
    data = sinks.panel_csv(df)
    assert data == b'\xef\xbb\xbfn,s\n1,"a,""b"""\n2,\n'
    sums = [sinks.write_zip(tmp_path / n, [("t.csv", data), ("big.json", json.dumps(list(range(500))).encode())]) for n in ("a.zip", "b.zip")]
    assert sums[0] == sums[1] and (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    assert set(zipfile.ZipFile(tmp_path / "a.zip").namelist()) == {"t.csv", "big.json", "sha256sums.txt"}
    with pytest.raises(ValueError):
        sinks.panel_csv(df, limit=1)
    ev = spark.createDataFrame([("2026-01-01", "m", 5, 1, 1), ("2026-01-01", "m", 4, 1, 2)], "day string, market_id string, ts_ms long, rank int, seq int")
    sinks.write_events(ev, str(tmp_path / "events"))
    assert [r.ts_ms for r in spark.read.parquet(str(tmp_path / "events")).collect()] == [4, 5]
    meta = paths.classify(spark.createDataFrame([("data/polymarket/daily/book/BTC-15m/x.jsonl.gz",), ("data/chainlink/daily/prices/ETHUSD/x.csv.gz",)], "path string"))
    assert paths.for_run(meta, "polymarket", ["BTC"], ["book", "prices"], ["15m"]).count() == 1


def test_plans(spark):
    assert plans.fingerprint({"a": 1, "b": [2]}) == plans.fingerprint({"b": [2], "a": 1}) != plans.fingerprint({"a": 2})
    assert plans.physical_datasets(["settlement", "trades"]) == ["last_trade_price", "prices", "twap30s", "twap60s"]
    days = plans.day_range(spark, "2026-02-27", "2026-03-02")
    assert [r.day for r in days.orderBy("day").collect()] == ["2026-02-27", "2026-02-28", "2026-03-01", "2026-03-02"]
    gap = plans.first_gap(days, days.where("day <> '2026-02-28'")).first()
    assert (gap.first, gap.last, gap.days) == ("2026-02-28", "2026-02-28", 1)
    assert sorted(r.day for r in plans.last_window(days, 2).collect()) == ["2026-03-01", "2026-03-02"]
    m = spark.createDataFrame([("m1", "BTC", 0, "5m", "prices"), ("m2", "BTC", 1, "5m", "twap30s")], "market_id string, asset string, open_ms long, interval string, stream string")
    assert tuple(plans.market_days(m).first()) == (1, 1, 1, 0)
    files = spark.createDataFrame([("a", "prices"), ("b", "twap60s"), ("c", "book")], "path string, dataset string")
    assert sorted(r.path for r in plans.settlement_paths(files, m).collect()) == ["a", "c"]
    assert [r.market_id for r in plans.market_order(m, "session").collect()] == ["m1", "m2"]


def test_spans_open_on_either_side(spark):
    """Without keys too, a null bound is open; a span of two null bounds holds every point; reversed spans hold none."""
    points = spark.createDataFrame([(t,) for t in (-7, 0, 3, 4, 19)], "ts long")
    spans = spark.createDataFrame([(1, None, None), (2, 3, None), (3, None, 0), (4, 0, 4), (5, 4, 0), (6, 100, None), (7, -10**15, 10**15)], "id int, start long, end long")
    got = {}
    for r in temporal.within(points, spans, "ts", "start", "end", 4).collect():
        got.setdefault(r.id, []).append(r.ts)
    assert {k: sorted(v) for k, v in got.items()} == {1: [-7, 0, 3, 4, 19], 2: [3, 4, 19], 3: [-7, 0], 4: [0, 3, 4], 7: [-7, 0, 3, 4, 19]}
    assert temporal.within(points.limit(0), spans, "ts", "start", "end", 4).count() == 0


def test_iso_zones(spark):
    cases = {"2025-01-01T12:00:00Z": 0, "2025-01-01 12:00:00+00": 0, " 2025-01-01 12:00:00+00:00 ": 0, "2025-01-01T14:30:00+0230": 0, "2025-01-01T07:00:00.25-05": 250, "2025-01-01T12:00:00": None, "2025-02-30T12:00:00Z": None, "2025-01-01T12:00Z": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", P.iso_ms(F.col("c")).alias("ms"))
    assert {r.c: r.ms for r in df.collect()} == {c: None if v is None else 1735732800000 + v for c, v in cases.items()}


def test_unusable_reasons(spark):
    ok = dict(asset="btc", token_ids=["u", "d"], stream="s", outcome="UP", open_ms=10, close_ms=20)
    markets = {"ok": ok, "venue": {**ok, "token_ids": []}, "open": {**ok, "open_ms": None, "close_ms": None}, "blank": {**ok, "asset": ""}, "all": dict(asset=None, token_ids=None, stream=None, outcome=None, open_ms=10, close_ms=20), "tokens": {**ok, "token_ids": None, "stream": None},
               "stream": {**ok, "stream": None, "outcome": None}, "outcome": {**ok, "outcome": "VOID"}, "outside": ok, "trades": ok, "books": ok, "quiet": ok}
    m = spark.createDataFrame([(k, *v.values()) for k, v in markets.items()], "market_id string, asset string, token_ids array<string>, stream string, outcome string, open_ms long, close_ms long")
    events = [("ok", 10, "tick"), ("venue", 20, "tick"), ("open", 99, "tick"), ("outside", 21, "tick"), ("outside", 9, "book"), ("trades", 15, "trade"), ("books", 15, "book"), ("books", 25, "tick"), ("unknown", 15, "tick"), ("outcome", 15, "tick"), ("blank", 15, "tick")]
    got = {r.market_id: r.reason for r in decode.unusable(m, spark.createDataFrame(events, "market_id string, ts_ms long, kind string")).collect()}
    assert got == {"unknown": decode.NO_METADATA, "blank": decode.NO_ASSET, "all": decode.NO_ASSET, "tokens": decode.NO_TOKENS, "stream": decode.NO_STREAM, "outcome": decode.NO_OUTCOME, "outside": decode.NO_EVENTS, "trades": decode.NO_EVENTS, "quiet": decode.NO_EVENTS, "books": "no settlement ticks on s"}


def test_account_series_ends(spark):
    """The last time is the last final sample's, and a point of its own off the grid; what comes later doesn't count."""
    cols = "key string, ts long, ord long, cash long, marked long, position_value long, final boolean"
    rows = [("a", 3, 1, 10, 1, 5, False), ("b", 12, 2, 7, 0, 0, False), ("a", 20, 3, 20, 2, 0, False), ("a", 24, 4, 30, 0, 4, True), ("b", 31, 5, 99, 0, 9, False)]
    series = lambda r: [tuple(x) for x in report.account_series(spark.createDataFrame(r, cols), 10).orderBy("ts").collect()]
    assert series(rows) == [(10, 16, 5, 1), (20, 29, 0, 0), (24, 41, 4, 1)]
    assert series([(*r[:6], False) for r in rows])[-2:] == [(30, 41, 4, 1), (31, 142, 13, 2)]
    assert series([("a", 3, 1, 10, 1, 5, False)]) == [(3, 16, 5, 1)]
    assert series([("a", 40, 1, 10, 1, 5, True)]) == [(40, 16, 5, 1)]
    assert series([]) == []


def test_panels_with_gaps(spark):
    """Markets without trades, cells without runs and cadences outside the range."""
    from tickloom.plans.data import throttle_ms

    m = spark.createDataFrame([(1, "UP", "s"), (2, "DOWN", "s")], "market_id int, outcome string, stream string")
    t = spark.createDataFrame([(1, 4, 7, 9)], "market_id int, size long, pnl long, opened_ms long")
    rows = {r.market_id: r for r in report.market_rows(m, t).collect()}
    assert (rows[1].entered, rows[1].trades, rows[1].pnl, rows[2].entered, rows[2].trades, rows[2].pnl, rows[2].first_ms) == (True, 1, 7, False, 0, 0, None)
    cells = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 2, 7)], "y int, x int, v int")
    assert sorted(map(tuple, report.sweep(cells, "y", "x", "v", [1, 2]).select("y", "x_1", "x_2").collect())) == [(0, 5, 6), (1, None, 7)]
    w = spark.createDataFrame([("a", 0, 99, 900), ("a", 50, 100, 20), ("a", 400, 500, 10), ("a", 401, 500, 800), ("b", 0, 1, 5)], "asset string, from long, to long, ms int")
    assert [tuple(r) for r in throttle_ms(w, 100, 400).collect()] == [("a", 20)]


def test_return_over_drawdown(spark):
    cols = "id int, closed_ms long, pnl long"
    value = lambda rows: report.return_over_drawdown(spark.createDataFrame(rows, cols), ["id"]).first()[0]
    assert value([(1, 1, 10), (2, 2, -4), (3, 3, 1), (4, 4, -5)]) == 0.25
    assert value([(1, 1, -8), (2, 2, 7)]) == -0.13  # -0.125: halves go away from zero
    assert value([(1, 1, 3), (2, 2, None)]) is None
    df = spark.createDataFrame([(1.005,), (-2.5,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(report.rounded(F.col("x"), 0)).collect()] == [1.0, -3.0, None, None]


def test_orders_in_sequence_keep_to_their_limits(spark):
    levels = spark.createDataFrame([("b", "asks", 10, 5), ("b", "asks", 20, 5), ("b", "bids", 5, 100), (None, "asks", 10, 1)], "k string, ladder string, ticks long, size long")
    asked = [("b", 1, 3, 10), ("b", 2, 9, 10), ("b", 3, 4, 20), ("b", 4, 1, 10), ("b", 5, 9, 20), ("b", 6, 1, None), ("c", 7, 1, 99)]
    orders = spark.createDataFrame([(*x, "more") for x in asked], "k string, o long, qty long, limit_ticks long, ladder string")
    got = book.take_in_sequence(orders, levels, ["k"], ["o"])
    assert got.columns == [*orders.columns, "filled"]
    assert [r.filled for r in got.orderBy("o").collect()] == [3, 2, 4, 0, 1, 0, 0]
    assert book.take_in_sequence(orders.where("false"), levels, ["k"], ["o"]).count() == 0


def test_places_of_many_values(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.choice([rng.randrange(9), rng.randrange(10_000)]))) for k in (None, "a", "b") for _ in range(700)] + [("b", None)]
    shares = {"first": 0.0, "median": 0.5, "worst": 0.99, "last": 1.0}
    want = lambda v: tuple(sorted(v)[min(len(v) - 1, int(q * len(v)))] for q in shares.values())
    df = spark.createDataFrame(rows, "k string, v double")
    assert tuple(report.at_share(df, "v", shares, ranges=8).first()) == want([v for _, v in rows if v is not None])
    got = {r.k: tuple(r)[1:] for r in report.at_share(df, "v", shares, ["k"], ranges=8).collect()}
    assert got == {k: want([v for x, v in rows if x == k and v is not None]) for k in (None, "a", "b")}
    assert tuple(report.at_share(df.where("false"), "v", shares).first()) == (None,) * 4


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"row {i}\n" if i % 7 else "\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("only\n")
    (tmp_path / "c.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = archive.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = sorted((r.line, r.value) for r in found if r.file.endswith("a.txt"))
    assert a == [(i, f"row {i}") for i in range(3000) if i % 7]
    assert [(r.line, r.value) for r in found if r.file.endswith("b.txt")] == [(0, "only")] and len(found) == len(a) + 1


def test_asof_in_blocks_is_asof(spark):
    rng = random.Random(3)
    some = lambda n, k: [(rng.choice(["x", "y", None]), rng.choice([None, *range(-50, 400)]), k + i) for i in range(n)]
    left, right = spark.createDataFrame(some(200, 0), "k string, t long, i long"), spark.createDataFrame(some(40, 1000), "k string, u long, v long")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(temporal.asof(left, right, ["k"], "t", "u", ["v"], ["v"]))
    for block in (1, 37, 1000):
        assert rows(temporal.asof(left, right, ["k"], "t", "u", ["v"], ["v"], block_ms=block)) == whole
    assert temporal.asof(left, right.limit(0), ["k"], "t", "u", ["v"], block_ms=37).where("v IS NOT NULL").count() == 0


def test_last_rows_keep_nulls_and_may_be_none(spark):
    right = spark.createDataFrame([("x", 1, None), ("x", 2, 20), ("x", 3, 30), ("x", 9, 90)], "k string, u long, v long")
    left = spark.createDataFrame([("x", 0), ("x", 2), ("x", 4), ("y", 4)], "k string, t long")
    found = {(r.k, r.t): r.last for r in temporal.asof_last(left, right, ["k"], "t", "u", "v", 2).collect()}
    assert found == {("x", 0): [], ("x", 2): [None, 20], ("x", 4): [20, 30], ("y", 4): []}
