"""How many rows queries move between tasks as their tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def moved(spark, run):
    """Rows that ``run`` writes to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()))
    had = max((s.stageId() for s in stages()), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > had)


def copies(spark, to, table, n, **columns):
    """``n`` copies of a table in the folder ``to``, with columns replaced by what is said of them and of the copy's number _c."""
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").crossJoin(spark.range(n).withColumnRenamed("id", "_c"))
    rows.withColumns({k: F.expr(x) for k, x in columns.items()}).drop("_c").coalesce(1).write.parquet(f"{to}/{table}.parquet")


@pytest.mark.parametrize(("name", "most"), [("q_book_at", 1.5), ("q_fill_at_time", 3.5)])
def test_orders_and_other_books_move_no_pairs(spark, tmp_path, name, most):
    """An order moves a few times however many levels it meets, and changes of books that no order asks for don't."""
    counts, orders = [], spark.read.parquet(f"{DATA}/orders.parquet").count()
    for i, (n, others) in enumerate([(1, 1), (9, 1), (1, 9)]):
        d = str(tmp_path / str(i))
        copies(spark, d, "orders", n, o_orderkey="o_orderkey + _c * 1000000", o_custkey="o_custkey % 9")
        copies(spark, d, "lineitem", others, l_suppkey="l_suppkey + _c * 1000000")
        counts.append(moved(spark, lambda d=d: QUERIES[name](spark, d).collect()))
    assert counts[1] - counts[0] <= most * 8 * orders
    assert counts[2] - counts[0] <= 300


def test_merged_feeds_move_no_pairs(spark, tmp_path):
    """Users and signups within an hour grow ninefold, their pairs 81-fold; what moves grows as the events."""
    counts = []
    for n in (1, 9):
        d = str(tmp_path / str(n))
        copies(spark, d, "events", n, event_id="event_id + _c * 1000000", user_id="user_id + _c * 1000000", ts="timestampadd(SECOND, event_id % 3000, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
        rows = []
        counts.append((moved(spark, lambda d=d, rows=rows: rows.append(len(QUERIES["q_ordered_merge"](spark, d).toArrow()))), rows[0]))
    assert counts[1][1] > 30 * counts[0][1]
    assert counts[1][0] < 15 * counts[0][0] and counts[1][0] < counts[1][1] / 2


def test_merged_feeds_by_a_plain_loop(spark, monkeypatch):
    from tickloom.operators import temporal

    monkeypatch.setattr(temporal, "FEED_ROWS", 7)
    rng = random.Random(5)
    hour = 3_600_000
    at = lambda: rng.randrange(0, 6 * hour, hour // 20)  # noqa: E731  many at one time
    events = [(rng.choice(["a", "b", "c", "z", None]), rng.choice([at(), at(), at() + 9 * hour, None]), i) for i in range(200)]
    feeds = {"x": [(at(), i % 17) for i in range(90)] + [(None, 3)], "w": [(at() + 8 * hour, i) for i in range(40)] + [(at(), 5)] * 2}
    markets = [("a", hour, 2 * hour), ("b", None, 3 * hour), ("c", 2 * hour, None), ("d", None, None), ("e", hour, hour), ("f", 5 * hour, hour), ("g", 20 * hour, None)]
    frames = {name: (spark.createDataFrame(rows, "ts_ms long, ord long"), lag) for (name, rows), lag in zip(feeds.items(), (hour // 20, 0), strict=True)}
    out = temporal.merge_feeds(spark.createDataFrame(events, "market_id string, ts_ms long, ord long"), frames, spark.createDataFrame(markets, "market_id string, open_ms long, close_ms long"))
    got = sorted(map(tuple, out.select("market_id", "visible_ms", "src_rank", "feed", "ord", "pos").collect()), key=str)
    want = []
    for m in ["a", "b", "c", "d", "e", "f", "g", "z", None]:
        rows = [(-1 if t is None else t, 0, "", o, t) for k, t, o in events if k == m]
        for _, low, high in (x for x in markets if x[0] == m):
            for name, lag in (("x", hour // 20), ("w", 0)):
                rows += [(t + lag, 1, name, o, t + lag) for t, o in feeds[name] if t is not None and (low is None or t + lag >= low) and (high is None or t + lag <= high)]
        want += [(m, r[4], *r[1:4], i + 1) for i, r in enumerate(sorted(rows, key=lambda r: r[:4]))]
    assert got == sorted(want, key=str)


def test_decoded_days_move_no_pairs(spark, tmp_path):
    """Markets and prices grow 20-fold, their pairs 400-fold; what moves grows as both. Rows of unknown markets don't move."""
    counts = []
    for n, others in ((1, 1), (20, 1), (1, 9)):
        d = str(tmp_path / f"{n}-{others}")
        copies(spark, d, "events", n, event_id="event_id + _c * 1000000", user_id="user_id + _c * 1000000")
        copies(spark, d, "supplier", n, s_suppkey="s_suppkey + _c * 1000")
        copies(spark, d, "lineitem", others, l_suppkey="l_suppkey - _c * 1000000")
        rows = []
        counts.append((moved(spark, lambda d=d, rows=rows: rows.append(len(QUERIES["q_decode_day"](spark, d).toArrow()))), rows[0]))
    assert counts[1][1] > 100_000 and counts[1][0] < 80_000
    assert counts[2][0] - counts[0][0] < 4800  # names, not the 48,000 rows


@pytest.mark.parametrize("few", [0, 1000])
def test_decoded_days_as_row_by_row(spark, monkeypatch, few):
    """Prices reach the markets that ``price_ticks`` and ``spot_events`` give them to, in replay order, whatever is null."""
    from tickloom.operators import decode, temporal

    monkeypatch.setattr(temporal, "FEED_ROWS", 5)
    monkeypatch.setattr(decode, "FEW_KEYS", few)
    rng = random.Random(11)
    pick, hour = rng.choice, 3_600_000
    at = lambda: rng.randrange(0, 8 * hour, hour // 10)
    markets = [(f"m{i}", pick([f"s{i}", "s", None]), pick(["A", "B", None]), f"u{i}", f"d{i}", pick(["p", "q", None]), pick([1, 2, None, None]), pick([None, 2 * hour, 5 * hour]), pick([None, 6 * hour, 4 * hour])) for i in range(14)]
    m = spark.createDataFrame(markets, "market_id string, slug string, asset string, token_up string, token_down string, stream string, price_feed_id long, open_ms long, close_ms long")
    price = "ts_ms long, value string, asset string, price_feed_id long, seq long"
    feeds = {s: spark.createDataFrame([(pick([at(), None]) if i % 9 == 0 else at(), pick(["1", "2", "x"]), pick(["A", "B", None]), pick([1, 2, None]), i // 2) for i in range(60)], price) for s in ("p", "q")}
    spot = spark.createDataFrame([(at(), "3", pick(["A", "B", None]), i) for i in range(40)], "ts_ms long, value string, asset string, seq long")
    trades = spark.createDataFrame([(pick([f"m{i % 16}", None]), pick([f"s{i % 16}", "s", None]), f"{pick('ud')}{i % 16}", at(), pick(['{"price": "0.5", "size": "2"}', "{}"]), i) for i in range(150)], "condition_id string, slug string, asset_id string, ts_ms long, payload string, seq long")
    own = decode.clip(decode.trade_prints(decode.with_market(trades, m, "condition_id", "slug").join(m.select("market_id", "token_up", "token_down"), "market_id")), m)
    want = own.unionByName(decode.spot_events(spot, m), allowMissingColumns=True)
    for s, rows in feeds.items():
        want = want.unionByName(decode.price_ticks(rows, m, s), allowMissingColumns=True)
    columns = ["market_id", "kind", "ts_ms", "value", "source", "side", "px", "seq", "pos"]
    want = temporal.replay_order(want, order=("seq", "side", "px", "size", "value")).select(*columns).collect()
    got = decode.day_events(m, feeds, trades=trades, spot=spot).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.kind for r in got} == {"trade", "tick", "spot"}
