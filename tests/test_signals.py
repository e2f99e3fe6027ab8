"""Signals as sets; later additions of the library."""

from pyspark.sql import functions as F

from tickloom.functions import prices as X
from tickloom.operators import book, decode, report, signals


def test_signals(spark):
    m = spark.createDataFrame([("m", "BTC", 0, 100_000), ("n", "BTC", 0, 100_000)], "market_id string, asset string, open_ms long, close_ms long")
    ticks = spark.createDataFrame([("m", 50_000, 1), ("m", 80_000, 2), ("m", 90_000, 3), ("n", 99_500, 4)], "market_id string, ts_ms long, ord long")
    ref = spark.createDataFrame([("BTC", 1_000, 100.0), ("BTC", 79_500, 101.0), ("BTC", 89_000, 102.0)], "asset string, ts_ms long, close double")
    q = spark.createDataFrame([("m", "UP", 0, 1, 6000), ("m", "UP", 85_000, 2, 5500)], "market_id string, side string, ts_ms long, ord long, ask_ticks int")
    f = lambda **k: [(r.market_id, r.ts_ms, r.side, r.limit_ticks) for r in signals.lead_lag(ticks, ref, q, m, **{"window_s": 60, "stop_s": 1, "min_move_bps": 50, "max_ticks": 7000, **k}).collect()]
    assert f() == [("m", 80_000, "UP", 6000)]
    assert f(lag_ms=1000) == [("m", 90_000, "UP", 5500)]  # the move isn't seen yet at 80 s
    assert f(max_ticks=5600) == [("m", 90_000, "UP", 5500)] and f(min_move_bps=300) == []
    got = signals.favourite_near_close(q, m, 20, 5000, 7000).collect()
    assert [(r.market_id, r.ts_ms, r.side, r.limit_ticks) for r in got] == [("m", 85_000, "UP", 5500)]
    tops = spark.createDataFrame([("m", 1, 1, 4000, 5000), ("m", 2, 2, 4000, 5000), ("m", 3, 3, 4100, 5000), ("m", 4, 4, 4900, 5000), ("m", 99_900, 5, 1000, 5000)], "market_id string, ts_ms long, ord long, bid_ticks int, ask_ticks int")
    assert [(r.ord, r.bid_ticks, r.down_bid_ticks) for r in signals.two_sided_quotes(tops, m, 200, 500, 9500, 1).orderBy("ord").collect()] == [(1, 4000, 5000), (3, 4100, 5000)]


def test_client_book_opening_and_grid(spark):
    rows = [("t", "asks", 5000, 5.0, "0.50", True, 1), ("t", "asks", 5100, 5.0, "0.510", True, 2), ("t", "bids", 4900, 1.0, "0.49", False, 3)]
    changes = spark.createDataFrame(rows, "token string, ladder string, ticks int, size double, price string, snapshot boolean, ord long").withColumn("snapshot", F.col("snapshot") & (F.col("ord") == 1))
    bounds = spark.createDataFrame([("t", "asks", 5100, 9)], "token string, ladder string, ticks int, ord long")
    assert sorted((r.ladder, r.price) for r in book.rebuild(changes, ["token"], bounds).collect()) == [("asks", "0.510"), ("bids", "0.49")]
    tops = spark.createDataFrame([("m", 1, "UP", 40), ("m", 2, "UP", 45), ("m", 3, "DOWN", 50), ("m", 4, "UP", 60)], "market_id string, ord int, side string, ask_ticks int")
    assert [(r.up_ticks, r.down_ticks) for r in book.opening_quotes(tops, "market_id", ["ord"]).collect()] == [(45, 50)]
    c = spark.createDataFrame([("m", "asks", 5, 2.0, 1, False, 1), ("m", "asks", 6, 2.0, 50, False, 2)], "market_id string, ladder string, ticks int, size double, ts_ms long, snapshot boolean, ord int")
    m = spark.createDataFrame([("m", 10)], "market_id string, open_ms long")
    assert [(r.ts_ms, r.ticks, r.snapshot) for r in book.opening_snapshot(c, m, ["ord"]).collect()] == [(10, 5, True)]
    s = spark.createDataFrame([("a", 5, 1, 7.0), ("a", 25, 2, 8.0)], "key string, ts long, ord int, v double")
    assert [(r.at, r.v) for r in book.record_grid(s, "key", 10).orderBy("at").collect()] == [(10, 7.0), (20, 7.0), (25, 8.0)]


def test_generic_records(spark):
    ok = '{"market_id":"a","token_ids":["1","2"],"labels":["Up","Down"],"start_ts_ms":1700000000000}'
    gamma = '{"gamma":{"conditionId":"b","clobTokenIds":"[\\"3\\",\\"4\\"]","outcomes":"[\\"Yes\\",\\"No\\"]"}}'
    bad = ['{"labels":["Up","Down"]}', ok.replace('["1","2"]', "[1,2]"), ok.replace('"2"]', '"1"]'), ok.replace("Down", "up "), ok.replace('["Up","Down"]', '["Down","Up"]'), ok.replace("1700000000000", "5"), ok[:-1] + ',"fee":{"model":"x","rate":7}}', ok[:-1] + ',"tick_size":0.00001}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([ok, gamma, *bad])], "i int, value string").orderBy("i")
    got = [(r.market_id, r.reason) for r in decode.generic_records(rows).collect()]
    assert got[:2] == [("a", None), ("b", None)]
    assert [r for _, r in got[2:]] == ["no market id", "token_ids", "token_ids", "labels differ", "label side", "start", "fee", "rules"]
    d = decode.duplicated(decode.generic_records(rows), "market_id", "token_up").collect()
    assert {(r.column, r.value) for r in d} >= {("market_id", "a"), ("token_up", "1")}
    v = decode.validated(spark.createDataFrame([(0.5, 1.0), (2.0, None)], "px double, size double"), {"px": F.expr("px BETWEEN 0 AND 1"), "size": F.expr("size > 0")})
    assert [r.invalid for r in v.collect()] == [[], ["px", "size"]]


def splitmix32(seed, n):
    s, out = seed & 0xFFFFFFFF, []
    for _ in range(n):
        s = (s + 0x9E3779B9) & 0xFFFFFFFF
        z = ((s ^ (s >> 16)) * 0x21F0AAAD) & 0xFFFFFFFF
        z = ((z ^ (z >> 15)) * 0x735A2D97) & 0xFFFFFFFF
        out.append((z ^ (z >> 15)) / 4294967296)
    return out


def test_seeded_uniform_and_panels(spark):
    for seed in (0, 7, 4294967295):
        got = spark.range(1, 40).select(X.seeded_uniform(F.lit(seed), F.col("id")).alias("u")).collect()
        assert [r.u for r in got] == splitmix32(seed, 39)
    f = spark.createDataFrame([("maker", 2, 10.0, 1.0), ("maker", 4, 30.0, None), ("maker", 0, 9.0, 1.0), ("taker", 5, 1.0, 1.0)], "liquidity string, filled long, ahead_at_join double, mk_1s double")
    r = report.maker_fills(f, ["mk_1s"]).first()
    assert (r.fills, r["size"], r.mk_1s_mean, r.median_ahead_at_join) == (2, 6, 1.0, 30.0)
    t = spark.createDataFrame([("a", "marked", 5, 0, 100), ("b", "settled", 7, None, None)], "market_id string, how string, pnl long, exit_ticks int, mark_age_ms long")
    assert tuple(report.marked_extras(t).first()) == (7, 5, 1, 1, 100)
    c = spark.createDataFrame([("k", i, 1.0 if i < 5 else 9.0) for i in range(12)], "key string, i int, cost double")
    assert [(x.key, x.at) for x in report.over_budget(c, "key", "i", "cost", 4.0, size=4).collect()] == [("k", 6)]
    assert tuple(report.crosscheck(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), "a", "b").first()) == (2, 1, 1)
