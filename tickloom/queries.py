"""The operators bound to the driver's tables, each with SQL for the same rows where SQL can say it.

Events stand for market events (a user is a market), line items for book levels, fills and trades,
orders for taker orders. Prices are whole ticks and money whole micro-dollars on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import parsing as P
from tickloom.functions import prices as X
from tickloom.operators import book, decode, ledger, report, temporal
from tickloom.sources import paths

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return put


# ---- bindings -------------------------------------------------------------------------------

def _ms(column: str):
    """Epoch ms of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) div 1000")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("market_id"), _ms("ts").alias("ts_ms"), "event_id", "event_type", F.floor(F.col("value") * 100 + 0.5).alias("cents"))


EV = "ev AS (SELECT user_id AS market_id, epoch_us(ts) // 1000 AS ts_ms, event_id, event_type, floor(value * 100 + 0.5)::BIGINT AS cents FROM events)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/lineitem.parquet")
    return r.select(
        F.col("l_suppkey").alias("book_id"), F.when(F.col("l_linestatus") == "O", "asks").otherwise("bids").alias("ladder"), F.floor(F.col("l_discount") * 10000 + 0.5).cast("bigint").alias("ticks"),
        F.col("l_quantity").cast("bigint").alias("size"), _ms("l_shipdate").alias("ts_ms"), ((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).alias("snapshot"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").cast("bigint").alias("o2"), F.col("l_partkey").alias("o3"), F.col("l_returnflag").alias("flag"))


LV = """lv AS (SELECT l_suppkey AS book_id, CASE WHEN l_linestatus = 'O' THEN 'asks' ELSE 'bids' END AS ladder, floor(l_discount * 10000 + 0.5)::BIGINT AS ticks,
    l_quantity::BIGINT AS size, epoch_ms(l_shipdate) AS ts_ms, (l_linenumber = 1 AND l_returnflag = 'R') AS snapshot, l_orderkey AS o1, l_linenumber::BIGINT AS o2, l_partkey AS o3, l_returnflag AS flag FROM lineitem)"""
ORDER = ["ts_ms", "o1", "o2", "o3", "size", "ticks"]
DEPTH = "dp AS (SELECT book_id, ladder, ticks, sum(size)::BIGINT AS size FROM lv GROUP BY ALL)"


def depth(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("book_id", "ladder", "ticks").agg(F.sum("size").alias("size"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    r = lines(spark, d)
    side = F.when(F.col("o2") % 2 == 1, "UP").otherwise("DOWN")
    outcome = F.when(F.col("flag") == "A", "UP").when(F.col("flag") == "N", "DOWN").otherwise("TIE")
    t = r.select(F.col("o1").alias("market_id"), side.alias("side"), outcome.alias("outcome"), "size", (F.col("ticks") * 8 + F.col("o3") % 10 * 100).alias("entry_ticks"), F.col("ts_ms").alias("closed_ms"),
                 (F.col("ts_ms") - (F.col("book_id") % 5 + 1) * 3600000).alias("opened_ms"), F.when(F.col("ladder") == "asks", "settled").otherwise("exit").alias("how"), F.col("book_id").alias("asset"), "o1", "o2", "o3")
    value = (X.contract_value(F.col("side"), F.col("outcome")) * 10000).cast("bigint")
    return t.withColumn("pnl", (value - F.col("entry_ticks")) * F.col("size") * 100)


TR = LV + """, t0 AS (SELECT o1 AS market_id, CASE WHEN o2 % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS side, CASE flag WHEN 'A' THEN 'UP' WHEN 'N' THEN 'DOWN' ELSE 'TIE' END AS outcome, size,
    ticks * 8 + o3 % 10 * 100 AS entry_ticks, ts_ms AS closed_ms, ts_ms - (book_id % 5 + 1) * 3600000 AS opened_ms, CASE WHEN ladder = 'asks' THEN 'settled' ELSE 'exit' END AS how, book_id AS asset, o1, o2, o3 FROM lv),
tr AS (SELECT *, CASE WHEN outcome = 'TIE' THEN 5000 WHEN side = outcome THEN 10000 ELSE 0 END AS value, (CASE WHEN outcome = 'TIE' THEN 5000 WHEN side = outcome THEN 10000 ELSE 0 END - entry_ticks) * size * 100 AS pnl FROM t0)"""
TORDER = ["o1", "o2", "o3", "pnl"]


def fills(spark: SparkSession, d: str) -> DataFrame:
    r = lines(spark, d)
    filled = F.least(F.col("size"), F.col("o2") * 10 - 10)
    return r.select(F.when(F.col("flag") == "A", "close").otherwise("open").alias("action"), F.when(F.col("o3") % 4 == 0, "maker").when(F.col("o3") % 4 == 1, "taker").alias("liquidity"), F.col("size").alias("requested"),
                    filled.alias("filled"), (F.col("size") - filled).alias("unfilled_size"), F.col("ticks").alias("quoted_ticks"), (F.col("ticks") + F.col("o2") % 3 * 7).alias("avg_ticks"), (F.col("o2") % 3 + 1).alias("levels_walked"))


FL = LV + """, fl AS (SELECT CASE WHEN flag = 'A' THEN 'close' ELSE 'open' END AS action, CASE o3 % 4 WHEN 0 THEN 'maker' WHEN 1 THEN 'taker' END AS liquidity, size AS requested, least(size, o2 * 10 - 10) AS filled,
    size - least(size, o2 * 10 - 10) AS unfilled_size, ticks AS quoted_ticks, ticks + o2 % 3 * 7 AS avg_ticks, o2 % 3 + 1 AS levels_walked FROM lv)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 50 + 1).alias("book_id"), F.floor(F.col("o_totalprice") / 50).cast("bigint").alias("qty"), (F.col("o_orderkey") % 8 * 100 + 200).alias("limit_ticks"), F.col("o_orderpriority").startswith("1").alias("fok"))


OD = "od AS (SELECT o_orderkey AS order_id, o_custkey % 50 + 1 AS book_id, floor(o_totalprice / 50)::BIGINT AS qty, o_orderkey % 8 * 100 + 200 AS limit_ticks, o_orderpriority LIKE '1%' AS fok FROM orders)"


# ---- joins in time --------------------------------------------------------------------------

def _asof(spark, d, **more):
    e = events(spark, d)
    asks = e.where("event_type = 'purchase'").select("event_id", "market_id", "ts_ms")
    views = e.where("event_type = 'view'").select("market_id", F.col("ts_ms").alias("seen_ms"), F.col("cents").alias("seen_cents"))
    return temporal.asof(asks, views, ["market_id"], "ts_ms", "seen_ms", ["seen_ms", "seen_cents"], ["seen_cents"], **more)


ASOF = "WITH " + EV + """, v AS (SELECT market_id, ts_ms AS seen_ms, cents AS seen_cents FROM ev WHERE event_type = 'view'),
a AS (SELECT event_id, market_id, ts_ms, {at} AS at FROM ev WHERE event_type = 'purchase')
SELECT event_id, a.market_id, ts_ms, seen_ms, seen_cents FROM a ASOF LEFT JOIN v ON a.market_id = v.market_id AND a.at >= v.seen_ms"""


@query("q_asof_last", ASOF.format(at="ts_ms"))
def q_asof_last(spark, d):
    return _asof(spark, d)


@query("q_asof_lag", ASOF.format(at="ts_ms - 60000"))
def q_asof_lag(spark, d):
    return _asof(spark, d, lag_ms=60_000)


@query("q_asof_at", ASOF.format(at="least(ts_ms - ts_ms % 86400000, ts_ms - 60000)"))
def q_asof_at(spark, d):
    return _asof(spark, d, lag_ms=60_000, at=F.col("ts_ms") - F.col("ts_ms") % 86_400_000)


@query("q_asof_blocks", ASOF.format(at="ts_ms - 60000"))
def q_asof_blocks(spark, d):
    return _asof(spark, d, lag_ms=60_000, block_ms=3 * 86_400_000)


@query("q_interval_fanout", "WITH " + EV + """ SELECT s.event_id AS span_id, count(*) AS n, sum(p.cents)::BIGINT AS cents FROM ev s JOIN ev p ON p.ts_ms BETWEEN s.ts_ms AND s.ts_ms + 1800000
WHERE s.event_type = 'purchase' AND p.event_type = 'error' GROUP BY ALL""")
def q_interval_fanout(spark, d):
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), F.col("ts_ms").alias("open_ms"), (F.col("ts_ms") + 1_800_000).alias("close_ms"))
    points = e.where("event_type = 'error'").select("ts_ms", "cents")
    return temporal.within(points, spans, "ts_ms", "open_ms", "close_ms", 1_800_000).groupBy("span_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("q_ordered_merge", "WITH " + EV + """, w AS (SELECT market_id, min(ts_ms) AS a, min(ts_ms) + 3600000 AS b FROM ev GROUP BY 1),
u AS (SELECT market_id, ts_ms AS visible_ms, 0 AS src_rank, '' AS feed, event_id AS ord FROM ev WHERE event_type IN ('view', 'click')
UNION ALL SELECT w.market_id, ev.ts_ms + 500, 1, 'signups', event_id FROM ev JOIN w ON ev.ts_ms + 500 BETWEEN w.a AND w.b WHERE event_type = 'signup')
SELECT market_id, visible_ms, src_rank, feed, ord, row_number() OVER (PARTITION BY market_id ORDER BY visible_ms, src_rank, feed, ord)::INT AS pos FROM u""")
def q_ordered_merge(spark, d):
    e = events(spark, d).withColumn("ord", F.col("event_id"))
    windows = e.groupBy("market_id").agg(F.min("ts_ms").alias("open_ms"), (F.min("ts_ms") + 3_600_000).alias("close_ms"))
    return temporal.merge_feeds(e.where("event_type IN ('view', 'click')"), {"signups": (e.where("event_type = 'signup'").select("ts_ms", "ord"), 500)}, windows)


@query("q_replay_order", "WITH " + EV + """, k AS (SELECT market_id, ts_ms // 86400000 AS ts_ms, event_id AS seq, CASE event_type WHEN 'view' THEN 'book' WHEN 'click' THEN 'tick' WHEN 'purchase' THEN 'trade' WHEN 'error' THEN 'spot' ELSE 'ref' END AS kind, cents % 2 = 0 AS snap FROM ev)
SELECT market_id, seq, row_number() OVER (PARTITION BY market_id ORDER BY ts_ms, CASE kind WHEN 'spot' THEN 0 WHEN 'book' THEN 1 WHEN 'trade' THEN 2 WHEN 'tick' THEN 3 ELSE 4 END, CASE WHEN snap THEN 0 ELSE 1 END, seq)::INT AS pos FROM k""")
def q_replay_order(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("view", "book", "click", "tick", "purchase", "trade", "error", "spot", "signup", "ref")])[F.col("event_type")]
    e = events(spark, d).select("market_id", F.floor(F.col("ts_ms") / 86_400_000).alias("ts_ms"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("cents") % 2 == 0).alias("snap"))
    return temporal.replay_order(e, snapshot=F.col("snap")).select("market_id", "seq", "pos")


@query("q_session_order", "WITH " + EV + """, m AS (SELECT market_id, min(ts_ms) AS o, max(ts_ms) AS c FROM ev GROUP BY 1)
SELECT market_id, max(ts_ms) OVER (PARTITION BY market_id ORDER BY cents, event_id) AS t, 1 AS phase, event_id AS s FROM ev
UNION ALL SELECT market_id, o, 0, 0 FROM m UNION ALL SELECT market_id, c, 2, 0 FROM m UNION ALL SELECT market_id, c, 3, 0 FROM m""")
def q_session_order(spark, d):
    e = events(spark, d)  # by amount, so that times do run backwards
    m = e.groupBy("market_id").agg(F.min("ts_ms").alias("open_ms"), F.max("ts_ms").alias("close_ms"))
    return temporal.session_order(m, e, order=("cents", "event_id"))


@query("q_markout", "WITH " + EV + """, q AS (SELECT market_id, ts_ms AS q_ts, CASE WHEN cents % 3 = 0 THEN NULL ELSE cents::DOUBLE END AS mid FROM ev WHERE event_type = 'view'),
f AS (SELECT event_id, market_id, ts_ms FROM ev WHERE event_type = 'purchase'),
a AS (SELECT f.event_id, CASE WHEN f.ts_ms + 3600000 - q_ts <= 86400000 THEN mid END AS mid_3600000 FROM f ASOF LEFT JOIN (SELECT * FROM q) q ON f.market_id = q.market_id AND f.ts_ms + 3599999 >= q.q_ts),
b AS (SELECT f.event_id, CASE WHEN f.ts_ms + 21600000 - q_ts <= 86400000 THEN mid END AS mid_21600000 FROM f ASOF LEFT JOIN (SELECT * FROM q) q ON f.market_id = q.market_id AND f.ts_ms + 21599999 >= q.q_ts)
SELECT f.event_id, mid_3600000, mid_21600000 FROM f JOIN a USING (event_id) JOIN b USING (event_id)""")
def q_markout(spark, d):
    e = events(spark, d)
    one_sided = F.when(F.col("cents") % 3 != 0, F.col("cents").cast("double"))
    quotes = e.where("event_type = 'view'").select("market_id", "ts_ms", (one_sided - 1).alias("bid"), (one_sided + 1).alias("ask"))
    f = e.where("event_type = 'purchase'").select("event_id", "market_id", "ts_ms")
    return temporal.markouts(f, quotes, [3_600_000, 21_600_000], ["market_id"], 86_400_000).drop("market_id", "ts_ms")


# ---- windows over ticks ---------------------------------------------------------------------

@query("q_indicators", "WITH " + EV + """, x AS (SELECT event_id, cents, avg(cents) OVER w AS m, stddev_pop(cents) OVER w AS sd, count(*) OVER w AS n, sum(cents) OVER w AS s FROM ev WINDOW w AS (PARTITION BY market_id ORDER BY ts_ms, event_id ROWS 19 PRECEDING))
SELECT event_id, n AS n, s::BIGINT AS total, floor(m * 1000 + 0.5)::BIGINT AS sma_milli, floor(CASE WHEN n < 2 THEN 0 ELSE sd END * 1000 + 0.5)::BIGINT AS stdev_milli, floor(CASE WHEN n < 2 OR sd = 0 THEN 0 ELSE (cents - m) / sd END * 1000 + 0.5)::BIGINT AS z_milli FROM x""")
def q_indicators(spark, d):
    out = temporal.indicators(events(spark, d), "cents", "market_id", ["ts_ms", "event_id"], 20)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    total = F.aggregate("history", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("event_id", F.size("history").cast("bigint").alias("n"), total.alias("total"), milli("sma").alias("sma_milli"), milli("stdev").alias("stdev_milli"), milli("zscore").alias("z_milli"))


@query("q_ema", "WITH " + EV + """, x AS (SELECT event_id, list(cents::DOUBLE) OVER (PARTITION BY market_id ORDER BY ts_ms, event_id ROWS 9 PRECEDING) AS h FROM ev)
SELECT event_id, floor(list_reduce(h, lambda a, b: b * (2.0 / (len(h) + 1)) + a * (1 - 2.0 / (len(h) + 1))) * 100 + 0.5)::BIGINT AS ema_100 FROM x""")
def q_ema(spark, d):
    e = events(spark, d).withColumn("value", F.col("cents").cast("double"))
    return temporal.indicators(e, "value", "market_id", ["ts_ms", "event_id"], 10).select("event_id", F.floor(F.col("ema") * 100 + 0.5).alias("ema_100"))


#: Of each market the values as they arrive, half a second to a day after their feed time; the window is the three days before its last feed time.
TWAP = "WITH " + EV + """, ft AS (SELECT *, ts_ms // 21600000 * 21600000 AS feed_ms FROM ev),
tk AS (SELECT market_id, event_id, cents, feed_ms, ts_ms AS arrived_ms, max(feed_ms) OVER (PARTITION BY market_id) AS close_ms FROM ft),
{asked},
m AS (SELECT a.*, k.cents, k.feed_ms, k.arrived_ms, k.event_id AS e, k.feed_ms >= a.close_ms - 259200000 AND k.feed_ms < a.close_ms AS inside FROM asked a JOIN tk k ON k.market_id = a.market_id AND k.arrived_ms <= a.now_ms),
f AS (SELECT *, row_number() OVER (PARTITION BY ask_id, feed_ms ORDER BY arrived_ms, e) = 1 AND inside AS one FROM m),
g AS (SELECT ask_id, market_id, now_ms, close_ms, count(*) FILTER (WHERE one) AS n, sum(cents) FILTER (WHERE one) AS s, arg_max(feed_ms, (arrived_ms, e)) AS last_ts_ms, arg_max(cents, (arrived_ms, e)) AS last FROM f GROUP BY ALL),
h AS (SELECT *, least(now_ms - (close_ms - 259200000), 259200000) AS el FROM g WHERE now_ms >= close_ms - 259200000 AND n > 0),
r AS (SELECT *, s::DOUBLE / n AS mean, least(1.0::DOUBLE, n::DOUBLE / greatest(1, el // 43200000)) AS coverage FROM h),
tw AS (SELECT ask_id, n AS samples, el AS elapsed_ms, coverage, last_ts_ms, floor(mean * 1000 + 0.5)::BIGINT AS twap_milli,
    CASE WHEN coverage >= 0.8 AND now_ms - last_ts_ms <= 86400000 THEN floor((el::DOUBLE / 259200000 * mean + (1 - el::DOUBLE / 259200000) * last) * 1000 + 0.5)::BIGINT END AS projected_milli FROM r)
"""


def _twap(spark, d, asked):
    e = events(spark, d).withColumn("feed_ms", F.floor(F.col("ts_ms") / 21_600_000) * 21_600_000)
    close = e.groupBy("market_id").agg(F.max("feed_ms").alias("close_ms")).withColumn("lookback_ms", F.lit(259_200_000))
    ticks = e.join(close, "market_id").select("market_id", F.col("ts_ms").alias("arrived_ms"), F.col("feed_ms").alias("ts_ms"), "cents", "event_id", "close_ms", "lookback_ms")
    out = temporal.twap_at(asked(e).join(close, "market_id"), ticks, "market_id", "now_ms", "close_ms", "lookback_ms", value="cents", order=["event_id"], second_ms=43_200_000, max_age_ms=86_400_000)
    return out.select("ask_id", "samples", "elapsed_ms", "coverage", "last_ts_ms", F.floor(F.col("twap") * 1000 + 0.5).alias("twap_milli"), F.floor(F.col("projected") * 1000 + 0.5).alias("projected_milli"))


@query("q_twap_window", TWAP.format(asked="asked AS (SELECT market_id AS ask_id, market_id, max(close_ms) AS now_ms, max(close_ms) AS close_ms FROM tk GROUP BY market_id)") + "SELECT market_id AS ask_id, samples, elapsed_ms, coverage, last_ts_ms, twap_milli, projected_milli FROM asked LEFT JOIN tw USING (ask_id)")
def q_twap_window(spark, d):
    """The mean that is locked at each market's close."""
    return _twap(spark, d, lambda e: e.groupBy(F.col("market_id").alias("ask_id"), "market_id").agg(F.max("feed_ms").alias("now_ms")))


@query("q_twap_at", TWAP.format(asked="asked AS (SELECT event_id AS ask_id, market_id, ts_ms AS now_ms, max(feed_ms) OVER (PARTITION BY market_id) AS close_ms FROM ft)") + "SELECT event_id AS ask_id, samples, elapsed_ms, coverage, last_ts_ms, twap_milli, projected_milli FROM ev LEFT JOIN tw ON ask_id = event_id")
def q_twap_at(spark, d):
    """What is locked at the time of every event."""
    return _twap(spark, d, lambda e: e.select(F.col("event_id").alias("ask_id"), "market_id", F.col("ts_ms").alias("now_ms")))


@query("q_dedup_feed", "WITH " + EV + """, x AS (SELECT event_id, market_id, ts_ms // 86400000 AS day, lag(ts_ms // 86400000) OVER (PARTITION BY market_id ORDER BY event_id) AS b FROM ev) SELECT event_id, market_id, day FROM x WHERE b IS NULL OR b <> day""")
def q_dedup_feed(spark, d):
    e = events(spark, d).select("event_id", "market_id", F.floor(F.col("ts_ms") / 86_400_000).alias("day"))
    return temporal.dedup_feed(e, "market_id", "day", ["event_id"])


@query("q_throttle", "WITH RECURSIVE " + EV + """, k AS (SELECT market_id, min(ts_ms) AS ts_ms FROM ev GROUP BY 1 UNION ALL SELECT k.market_id, min(e.ts_ms) AS ts_ms FROM k JOIN ev e ON e.market_id = k.market_id AND e.ts_ms >= k.ts_ms + 28800000 GROUP BY k.market_id, k.ts_ms)
SELECT market_id, ts_ms FROM k""")
def q_throttle(spark, d):
    return temporal.throttle(events(spark, d), "market_id", "ts_ms", 28_800_000, ["event_id"]).select("market_id", "ts_ms")


# ---- books ----------------------------------------------------------------------------------

STATE = "WITH " + LV + """, e AS (SELECT *, CASE WHEN snapshot AND NOT coalesce(lag(snapshot) OVER w AND lag(ts_ms) OVER w = ts_ms, false) THEN 1 ELSE 0 END AS is_new FROM lv WINDOW w AS (PARTITION BY book_id, ladder ORDER BY ts_ms, o1, o2, o3, size, ticks)),
f AS (SELECT *, sum(is_new) OVER (PARTITION BY book_id, ladder ORDER BY ts_ms, o1, o2, o3, size, ticks ROWS UNBOUNDED PRECEDING) AS ep FROM e),
g AS (SELECT *, max(ep) OVER (PARTITION BY book_id, ladder) AS top, row_number() OVER (PARTITION BY book_id, ladder, ticks ORDER BY ts_ms DESC, o1 DESC, o2 DESC, o3 DESC, size DESC) AS rn FROM f),
st AS (SELECT book_id, ladder, ticks, size - 2 AS size, ts_ms FROM g WHERE rn = 1 AND ep = top AND size - 2 > 0)
"""


def book_state(spark, d):
    changes = lines(spark, d).withColumn("size", F.col("size") - 2)
    return book.levels_after(changes, ["book_id"], ORDER)


@query("q_book_state", STATE + "SELECT * FROM st")
def q_book_state(spark, d):
    return book_state(spark, d)


@query("q_prune", STATE + """, b AS (SELECT book_id, ladder, ticks, ts_ms FROM lv WHERE flag = 'R')
SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.book_id = st.book_id AND b.ladder = st.ladder AND st.ts_ms < b.ts_ms AND CASE WHEN st.ladder = 'asks' THEN st.ticks < b.ticks ELSE st.ticks > b.ticks END)""")
def q_prune(spark, d):
    bounds = lines(spark, d).where("flag = 'R'").select("book_id", "ladder", "ticks", "ts_ms")
    return book.prune(book_state(spark, d), bounds, ["book_id"])


#: The levels of each order's book at its date: of each tick the last change until then, if no snapshot of its ladder and no tighter best price came after it.
AT = STATE.rstrip() + """, od AS (SELECT o_orderkey AS order_id, o_custkey % 50 + 1 AS book_id, epoch_ms(o_orderdate) AS at_ms, floor(o_totalprice / 9000)::BIGINT AS qty,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 8 * 100 + 200 END AS limit_ticks, o_orderkey % 3 = 0 AS reduce_only, o_orderpriority LIKE '1%' AS fok FROM orders),
ch AS (SELECT od.*, f.ladder, f.ticks, f.size - 2 AS size, f.ts_ms, ep, max(ep) OVER (PARTITION BY order_id, f.ladder) AS top, row_number() OVER (PARTITION BY order_id, f.ladder, f.ticks ORDER BY ts_ms DESC, o1 DESC, o2 DESC, o3 DESC, f.size DESC) AS rn FROM od JOIN f USING (book_id) WHERE f.ts_ms <= at_ms),
a0 AS (SELECT * FROM ch WHERE rn = 1 AND ep = top AND size > 0),
bd AS (SELECT book_id, ladder, ticks, ts_ms FROM lv WHERE flag = 'R'),
bk AS (SELECT * FROM a0 WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.book_id = a0.book_id AND bd.ladder = a0.ladder AND bd.ts_ms > a0.ts_ms AND bd.ts_ms <= a0.at_ms AND CASE WHEN a0.ladder = 'asks' THEN bd.ticks > a0.ticks ELSE bd.ticks < a0.ticks END))
"""


def _spans(spark, d, asked):
    changes = book.only_asked(lines(spark, d), asked, ["book_id"])
    bounds = changes.where("flag = 'R'").select("book_id", "ladder", "ticks", "ts_ms")
    return book.level_spans(changes.withColumn("size", F.col("size") - 2), ["book_id"], ORDER, bounds)


def _timed_orders(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    return o.select(k.alias("order_id"), (F.col("o_custkey") % 50 + 1).alias("book_id"), _ms("o_orderdate").alias("at_ms"), F.floor(F.col("o_totalprice") / 9000).cast("bigint").alias("qty"),
                    F.when(k % 5 != 0, k % 8 * 100 + 200).alias("limit_ticks"), (k % 3 == 0).alias("reduce_only"), F.col("o_orderpriority").startswith("1").alias("fok"))


@query("q_book_at", AT + """SELECT order_id, min(ticks) FILTER (WHERE ladder = 'asks') AS best_ask, max(ticks) FILTER (WHERE ladder = 'bids') AS best_bid, arg_min(ts_ms, ticks) FILTER (WHERE ladder = 'asks') AS ask_ts, arg_max(ts_ms, ticks) FILTER (WHERE ladder = 'bids') AS bid_ts,
    coalesce(sum(size) FILTER (WHERE ladder = 'asks' AND (limit_ticks IS NULL OR ticks <= limit_ticks)), 0)::BIGINT AS ask_depth, coalesce(sum(size) FILTER (WHERE ladder = 'bids' AND (limit_ticks IS NULL OR ticks >= limit_ticks)), 0)::BIGINT AS bid_depth FROM bk GROUP BY 1""")
def q_book_at(spark, d):
    """Best prices, their age and the depth to a bound of each order's book at the order's time."""
    o = _timed_orders(spark, d)
    met = book.book_at(o, _spans(spark, d, o), ["book_id"], "at_ms")
    return book.quotes(met, ["book_id", "at_ms", "order_id"], F.col("limit_ticks")).drop("book_id", "at_ms")


@query("q_fill_at_time", AT + """, mt AS (SELECT *, CASE WHEN reduce_only THEN -ticks ELSE ticks END AS cost, CASE WHEN reduce_only THEN -limit_ticks ELSE limit_ticks END AS cap FROM bk WHERE ladder = CASE WHEN reduce_only THEN 'bids' ELSE 'asks' END),
tk AS (SELECT *, CASE WHEN cap IS NULL OR cost <= cap THEN greatest(0, least(size, qty - coalesce(sum(size) OVER (PARTITION BY order_id ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END::BIGINT AS taken FROM mt),
fg AS (SELECT order_id, sum(taken)::BIGINT AS f, sum(taken * ticks)::BIGINT AS nt, arg_min(ticks, cost) AS q, arg_max(ticks, cost) FILTER (WHERE taken > 0) AS wo, count(*) FILTER (WHERE taken > 0) AS n FROM tk GROUP BY 1),
k AS (SELECT od.order_id, f, nt, q, wo, n, NOT fok OR coalesce(f >= qty, false) AS keep FROM od LEFT JOIN fg ON fg.order_id = od.order_id)
SELECT order_id, CASE WHEN keep THEN coalesce(f, 0) ELSE 0 END AS filled, CASE WHEN keep THEN coalesce(nt, 0) ELSE 0 END AS notional_ticks, CASE WHEN keep THEN q END AS quoted_ticks, CASE WHEN keep THEN wo END AS worst_ticks, CASE WHEN keep THEN coalesce(n, 0) ELSE 0 END AS levels_walked FROM k""")
def q_fill_at_time(spark, d):
    """Each order by itself against the book that stands at its time; some reduce, some are all or none, some have no limit."""
    o = _timed_orders(spark, d)
    out = book.fills_at(o, _spans(spark, d, o), ["book_id"], "at_ms")
    return out.select("order_id", "filled", "notional_ticks", "quoted_ticks", "worst_ticks", "levels_walked")


SIDES = "WITH " + LV + """, s0 AS (SELECT *, size - 2 AS n, CASE WHEN o2 % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS side, row_number() OVER (PARTITION BY book_id ORDER BY ts_ms, o1, o2, o3, size, ticks) AS seq FROM lv)
"""


def _sided(spark, d):
    r = lines(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("book_id").orderBy(*ORDER)).cast("bigint"))
    return r.withColumns({"side": F.when(F.col("o2") % 2 == 1, "UP").otherwise("DOWN"), "size": F.col("size") - 2})


@query("q_opening_book", SIDES + """, c AS (SELECT k.book_id, k.seq AS "at", s.side, s.ticks, s.n, s.seq, s.snapshot, row_number() OVER (PARTITION BY k.book_id, k.seq, s.side, s.ticks ORDER BY s.seq DESC) AS rn, max(CASE WHEN s.snapshot THEN s.seq END) OVER (PARTITION BY k.book_id, k.seq, s.side) AS snap
    FROM s0 k JOIN s0 s ON s.book_id = k.book_id AND s.seq <= k.seq AND s.ladder = 'asks'),
b AS (SELECT book_id, "at", min(ticks) FILTER (WHERE side = 'UP') AS up_ticks, min(ticks) FILTER (WHERE side = 'DOWN') AS down_ticks FROM c WHERE rn = 1 AND n > 0 AND (snap IS NULL OR seq >= snap) GROUP BY 1, 2)
SELECT book_id, min("at") AS "at", arg_min(up_ticks, "at") AS up_ticks, arg_min(down_ticks, "at") AS down_ticks FROM b WHERE up_ticks IS NOT NULL AND down_ticks IS NOT NULL GROUP BY 1""")
def q_opening_book(spark, d):
    """The first state of each book with asks on both sides, event by event."""
    spans = book.level_spans(_sided(spark, d), ["book_id", "side"], ["seq"], place="seq", same=("seq",))
    return book.opening_quotes_of(spans, "book_id")


@query("q_quote_guard", SIDES + """, st AS (SELECT book_id, side, ladder, ticks, arg_max(n, seq) AS n, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms FROM s0 GROUP BY ALL),
sn AS (SELECT book_id, side, ladder, max(seq) AS snap FROM s0 WHERE snapshot GROUP BY ALL),
l AS (SELECT st.* FROM st LEFT JOIN sn USING (book_id, side, ladder) WHERE n > 0 AND (snap IS NULL OR seq >= snap)),
q AS (SELECT book_id, min(ticks) FILTER (WHERE side = 'UP' AND ladder = 'asks') AS ua, min(ticks) FILTER (WHERE side = 'DOWN' AND ladder = 'asks') AS da, (SELECT max(ts_ms) FROM lv) AS now,
    [arg_min(ts_ms, ticks) FILTER (WHERE side = 'UP' AND ladder = 'asks'), arg_max(ts_ms, ticks) FILTER (WHERE side = 'UP' AND ladder = 'bids'), arg_min(ts_ms, ticks) FILTER (WHERE side = 'DOWN' AND ladder = 'asks'), arg_max(ts_ms, ticks) FILTER (WHERE side = 'DOWN' AND ladder = 'bids')] AS t FROM l GROUP BY 1)
SELECT book_id, CASE WHEN ua IS NULL OR da IS NULL OR ua + da NOT BETWEEN 100 AND 500 THEN 'quote_guard' END AS by_sum, CASE WHEN len(list_filter(t, lambda x: x IS NOT NULL AND now - x <= 10368000000)) < 4 THEN 'quote_guard' END AS by_age FROM q""")
def q_quote_guard(spark, d):
    """Whether each book's last state would refuse an opening order, by the sum of its asks and by its age."""
    r = _sided(spark, d)
    now = r.agg(F.max("ts_ms")).scalar()
    levels = book.levels_after(r, ["book_id", "side"], ["seq"], same=("seq",))
    of = lambda side: book.quotes(levels.where(F.col("side") == side), ["book_id"]).select("book_id", *[F.col(c).alias(f"{side}_{c}") for c in ("best_ask", "ask_ts", "bid_ts")])
    q = of("UP").join(of("DOWN"), "book_id", "full")
    asks = [X.from_ticks(F.col(f"{s}_best_ask")) for s in ("UP", "DOWN")]
    times = [F.col(f"{s}_{c}") for s in ("UP", "DOWN") for c in ("ask_ts", "bid_ts")]
    return q.select("book_id", X.quote_guard(*asks, times, F.lit(now), ask_sum=(0.01, 0.05)).alias("by_sum"), X.quote_guard(*asks, times, F.lit(now), max_age_ms=10_368_000_000).alias("by_age"))


@query("q_top_of_book", STATE + """, t AS (SELECT book_id, min(ticks) FILTER (WHERE ladder = 'asks') AS best_ask, max(ticks) FILTER (WHERE ladder = 'bids') AS best_bid, (sum(size) FILTER (WHERE ladder = 'asks'))::BIGINT AS ask_depth, (sum(size) FILTER (WHERE ladder = 'bids'))::BIGINT AS bid_depth, max(ts_ms) AS newest FROM st GROUP BY 1)
SELECT *, coalesce(best_bid >= best_ask, false) AS crossed FROM t""")
def q_top_of_book(spark, d):
    return book.top_of_book(book_state(spark, d), ["book_id"])


@query("q_best_levels", "WITH " + LV + ", " + DEPTH + """, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, ladder ORDER BY CASE WHEN ladder = 'asks' THEN ticks ELSE -ticks END)::INT AS rank FROM dp) SELECT * FROM r WHERE rank <= 3""")
def q_best_levels(spark, d):
    return book.best_levels(depth(spark, d), ["book_id"], 3)


WALK = "WITH " + LV + ", " + DEPTH + ", " + OD + """, m AS (SELECT od.*, ticks, size, coalesce(sum(size) OVER (PARTITION BY order_id ORDER BY ticks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM od JOIN dp USING (book_id) WHERE ladder = 'asks' AND ticks <= limit_ticks),
wk AS (SELECT *, greatest(0, least(size, qty - before))::BIGINT AS taken FROM m WHERE qty > before)
"""


def walked(spark, d):
    return book.walk(orders(spark, d), depth(spark, d), ["book_id"])


@query("q_walk_book", WALK + "SELECT order_id, ticks, taken FROM wk")
def q_walk_book(spark, d):
    return walked(spark, d).select("order_id", "ticks", "taken")


@query("q_fok", WALK + """, g AS (SELECT order_id, sum(taken) AS f, sum(taken * ticks) AS nt, min(ticks) AS q, max(ticks) AS wo, count(*) AS n FROM wk GROUP BY 1)
SELECT od.order_id, CASE WHEN NOT fok OR coalesce(f >= qty, false) THEN coalesce(f, 0) ELSE 0 END::BIGINT AS filled, CASE WHEN NOT fok OR coalesce(f >= qty, false) THEN coalesce(nt, 0) ELSE 0 END::BIGINT AS notional_ticks,
    CASE WHEN NOT fok OR coalesce(f >= qty, false) THEN q END AS quoted_ticks, CASE WHEN NOT fok OR coalesce(f >= qty, false) THEN wo END AS worst_ticks, CASE WHEN NOT fok OR coalesce(f >= qty, false) THEN coalesce(n, 0) ELSE 0 END::BIGINT AS levels_walked FROM od LEFT JOIN g USING (order_id)""")
def q_fok(spark, d):
    out = book.fills(orders(spark, d), walked(spark, d), fok=F.col("fok"))
    return out.select("order_id", "filled", "notional_ticks", "quoted_ticks", "worst_ticks", "levels_walked")


@query("q_take_sequence", "WITH RECURSIVE " + LV + ", " + DEPTH + ", " + OD + """, a AS (SELECT book_id, ticks, size, row_number() OVER (PARTITION BY book_id ORDER BY ticks) AS k FROM dp WHERE ladder = 'asks'),
r AS (SELECT order_id, book_id, limit_ticks, qty AS rest, 0::BIGINT AS k FROM od
UNION ALL SELECT order_id, r.book_id, limit_ticks, rest - CASE WHEN limit_ticks >= ticks THEN greatest(0, least(rest, size - coalesce(sum(CASE WHEN limit_ticks >= ticks THEN rest ELSE 0 END) OVER (PARTITION BY r.book_id ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT ELSE 0 END, a.k
    FROM r JOIN a ON a.book_id = r.book_id AND a.k = r.k + 1)
SELECT order_id, od.book_id, (qty - min(rest))::BIGINT AS filled FROM od JOIN r USING (order_id) GROUP BY order_id, od.book_id, qty""")
def q_take_sequence(spark, d):
    return book.take_in_sequence(orders(spark, d), depth(spark, d), ["book_id"], ["order_id"]).select("order_id", "book_id", "filled")


@query("q_fees", WALK + """SELECT order_id, sum(floor(taken * 0.072::DOUBLE * (ticks / 10000.0::DOUBLE) * (1 - ticks / 10000.0::DOUBLE) * 1e5 + 0.5)::BIGINT)::BIGINT AS fee_e5, sum(floor(taken * ticks * 25 / 10000)::BIGINT)::BIGINT AS flat_ticks FROM wk GROUP BY 1""")
def q_fees(spark, d):
    w = walked(spark, d).withColumn("px", X.from_ticks(F.col("ticks")))
    fee = F.floor(X.curve_fee(F.col("taken"), F.col("px"), F.lit(0.072)) * 1e5 + 0.5)
    return w.groupBy("order_id").agg(F.sum(fee).alias("fee_e5"), F.sum(F.floor(X.flat_fee(F.col("taken") * F.col("ticks"), F.lit(25)))).alias("flat_ticks"))


@query("q_book_age", "WITH " + LV + """, a AS (SELECT size * 1000000 AS micro, o3 % 40000 AS age FROM lv)
SELECT coalesce(sum(micro) FILTER (WHERE age < 1000), 0)::BIGINT AS lt_1000, coalesce(sum(micro) FILTER (WHERE age >= 1000 AND age < 5000), 0)::BIGINT AS lt_5000, coalesce(sum(micro) FILTER (WHERE age >= 5000 AND age < 30000), 0)::BIGINT AS lt_30000, coalesce(sum(micro) FILTER (WHERE age >= 30000), 0)::BIGINT AS ge_30000, max(age) AS max_age_ms FROM a""")
def q_book_age(spark, d):
    return book.book_age(lines(spark, d).select(F.col("size").alias("taken"), (F.col("o3") % 40_000).alias("age_ms")))


@query("q_ledger_fold", "WITH RECURSIVE " + LV + """, g AS (SELECT *, CASE WHEN o2 % 3 = 0 THEN -size ELSE size END AS q FROM lv), f AS (SELECT *, row_number() OVER (PARTITION BY book_id, ladder ORDER BY ts_ms, o1, o2, o3, q, ticks) AS k FROM g),
r AS (SELECT book_id, ladder, 0::BIGINT AS k, 0::BIGINT AS held, 0::BIGINT AS cost, 0::BIGINT AS realised FROM f GROUP BY 1, 2
UNION ALL SELECT r.book_id, r.ladder, f.k, (held + greatest(q, -held))::BIGINT, (cost + CASE WHEN q >= 0 THEN q * ticks WHEN held > 0 THEN -(cost * least(-q, held) // held) ELSE 0 END)::BIGINT,
    (realised - 1 + CASE WHEN q >= 0 THEN 0 ELSE least(-q, held) * ticks - CASE WHEN held > 0 THEN cost * least(-q, held) // held ELSE 0 END END)::BIGINT FROM r JOIN f ON f.book_id = r.book_id AND f.ladder = r.ladder AND f.k = r.k + 1)
SELECT book_id, ladder, arg_max(held, k) AS size, arg_max(cost, k) AS cost, arg_max(realised, k) AS realised, CASE WHEN arg_max(held, k) > 0 THEN arg_max(cost, k)::DOUBLE / arg_max(held, k) END AS avg_ticks FROM r GROUP BY 1, 2""")
def q_ledger_fold(spark, d):
    f = lines(spark, d).select("book_id", "ladder", *ORDER[:4], F.when(F.col("o2") % 3 == 0, -F.col("size")).otherwise(F.col("size")).alias("qty"), "ticks", F.lit(1).alias("fee"))
    return ledger.positions(f, ["book_id", "ladder"], ["ts_ms", "o1", "o2", "o3"])


@query("q_queue_replay")
def q_queue_replay(spark, d):
    e = events(spark, d)
    kind = F.when(F.col("event_type") == "view", "level").when(F.col("event_type") == "purchase", "trade").when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "cancel").otherwise("level")
    order = F.when(F.col("event_type") == "error", F.col("event_id") - 3).otherwise(F.col("event_id"))
    return ledger.queue_replay(e.select("market_id", "ts_ms", F.col("event_id").alias("seq"), kind.alias("kind"), order.alias("order_id"), (F.col("cents") % 5).alias("tick"), (F.col("cents") / 100).alias("size")))


# ---- report panels --------------------------------------------------------------------------

@query("q_summary", "WITH " + TR + """, s AS (SELECT count(*) AS n, count(DISTINCT market_id) AS m, sum(pnl)::BIGINT AS p, count(*) FILTER (WHERE pnl > 0) AS w, (sum(pnl) FILTER (WHERE pnl > 0))::BIGINT AS gw, (abs(sum(pnl) FILTER (WHERE pnl < 0)))::BIGINT AS gl, sum(entry_ticks * size * 100)::BIGINT AS c, sum(closed_ms - opened_ms)::BIGINT AS h FROM tr)
SELECT n AS trades, m AS markets_traded, p AS net_pnl, w::DOUBLE / n AS win_rate, gw::DOUBLE / nullif(gl, 0) AS profit_factor, c AS collateral, p::DOUBLE / nullif(c, 0) AS return_on_collateral, floor(h::DOUBLE / n + 0.5)::BIGINT AS avg_hold_ms FROM s""")
def q_summary(spark, d):
    return report.summary(trades(spark, d))


@query("q_daily", "WITH " + TR + " SELECT (make_timestamp(closed_ms * 1000))::DATE::VARCHAR AS day, sum(pnl)::BIGINT AS pnl, count(*) AS trades FROM tr GROUP BY 1")
def q_daily(spark, d):
    return report.daily(trades(spark, d))


@query("q_sharpe_sortino", "WITH " + TR + """, g AS (SELECT closed_ms // 86400000 AS day, sum(pnl)::DOUBLE AS p FROM tr GROUP BY 1)
SELECT count(*) AS trading_days, count(*) FILTER (WHERE p > 0) AS winning_days, max(p)::BIGINT AS best_day, min(p)::BIGINT AS worst_day, floor(avg(p) / stddev_samp(p) * sqrt(365) * 1e6 + 0.5)::BIGINT AS sharpe_micro, floor(avg(p) / sqrt(sum(pow(least(p, 0), 2)) / count(*)) * sqrt(365) * 1e6 + 0.5)::BIGINT AS sortino_micro FROM g""")
def q_sharpe_sortino(spark, d):
    out = report.daily_ratios(trades(spark, d))
    return out.select("trading_days", "winning_days", "best_day", "worst_day", *[F.floor(F.col(c) * 1e6 + 0.5).alias(f"{c}_micro") for c in ("sharpe", "sortino")])


EQ = "WITH " + TR + ", eq AS (SELECT *, sum(pnl) OVER (ORDER BY closed_ms, o1, o2, o3, pnl ROWS UNBOUNDED PRECEDING)::BIGINT AS equity, row_number() OVER (ORDER BY closed_ms, o1, o2, o3, pnl) AS rn FROM tr)"


@query("q_equity", EQ + " SELECT closed_ms, market_id, pnl, equity FROM eq")
def q_equity(spark, d):
    return report.equity(trades(spark, d), TORDER).select("closed_ms", "market_id", "pnl", "equity")


@query("q_drawdown", EQ + """, p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM eq), w AS (SELECT peak, peak - equity AS fall FROM p ORDER BY peak - equity DESC, rn LIMIT 1)
SELECT fall::BIGINT AS max_drawdown, CASE WHEN fall > 0 AND peak > 0 THEN -(fall::DOUBLE / peak) END AS max_drawdown_pct FROM w""")
def q_drawdown(spark, d):
    return report.drawdown(report.equity(trades(spark, d), TORDER), "closed_ms", "equity", TORDER)


@query("q_return_over_drawdown", EQ + """, p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM eq), w AS (SELECT max(peak - equity) AS fall, sum(pnl) AS net FROM p)
SELECT CASE WHEN fall > 0 THEN sign(net) * floor(abs(net::DOUBLE / fall) * 100 + 0.5) / 100 END AS return_over_max_drawdown FROM w""")
def q_return_over_drawdown(spark, d):
    return report.return_over_drawdown(trades(spark, d), TORDER)


@query("q_losing_run", EQ + """, r AS (SELECT pnl, count(*) FILTER (WHERE pnl >= 0) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS g FROM eq), n AS (SELECT count(*) AS c FROM r WHERE pnl < 0 GROUP BY g) SELECT coalesce(max(c), 0)::BIGINT AS worst_losing_run FROM n""")
def q_losing_run(spark, d):
    return report.losing_run(trades(spark, d), TORDER)


@query("q_peak_capital", "WITH " + TR + """, s AS (SELECT closed_ms AS t, 0 AS p, -(entry_ticks * size * 100) AS d FROM tr UNION ALL SELECT opened_ms, 1, entry_ticks * size * 100 FROM tr), g AS (SELECT t, p, sum(d) AS d FROM s GROUP BY ALL), h AS (SELECT sum(d) OVER (ORDER BY t, p ROWS UNBOUNDED PRECEDING) AS held FROM g) SELECT max(held)::BIGINT AS peak_capital FROM h""")
def q_peak_capital(spark, d):
    return report.peak_capital(trades(spark, d))


@query("q_holding_ratio", "WITH " + TR + """, s AS (SELECT opened_ms AS a, max(closed_ms) AS b FROM tr GROUP BY 1), u AS (SELECT a, b, max(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), c AS (SELECT greatest(0, b - greatest(a, coalesce(e, a))) AS x, a, b FROM u)
SELECT sum(x)::DOUBLE / (max(b) - min(a)) AS holding_ratio, sum(x)::BIGINT AS held_ms FROM c""")
def q_holding_ratio(spark, d):
    return report.holding_ratio(trades(spark, d))


@query("q_brier_edge", "WITH " + TR + """, s AS (SELECT *, value - entry_ticks AS e FROM tr WHERE how = 'settled')
SELECT sum(e * size)::DOUBLE / (sum(size) * 10000) AS edge_per_contract, sum(e)::DOUBLE / (count(*) * 10000) AS edge_per_trade, sum(e * e)::DOUBLE / (count(*) * 1e8) AS brier, count(*) AS settled, count(*) FILTER (WHERE entry_ticks > 5000) AS above_half FROM s""")
def q_brier_edge(spark, d):
    return report.edges(trades(spark, d))


@query("q_calibration", "WITH " + TR + """, s AS (SELECT (entry_ticks // 1000)::INT AS bucket, count(*) AS trades, sum(entry_ticks) AS e, sum(value) AS v FROM tr WHERE how = 'settled' AND entry_ticks < 10000 GROUP BY 1)
SELECT bucket, trades, e::DOUBLE / (trades * 10000) AS implied, v::DOUBLE / (trades * 10000) AS realized, ((v - e) * 100)::DOUBLE / (trades * 10000) AS edge_cents FROM s""")
def q_calibration(spark, d):
    return report.calibration(trades(spark, d))


def markets(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    outcome = F.when(F.col("o_orderstatus") == "F", "UP").when(F.col("o_orderstatus") == "O", "DOWN")
    return o.select(F.col("o_orderkey").alias("market_id"), outcome.alias("outcome"), (F.floor(F.col("o_totalprice")) % 10_000).cast("bigint").alias("up_ticks"), F.when(F.col("o_custkey") % 7 != 0, 10_000 - F.floor(F.col("o_totalprice")) % 10_000 + 50).alias("down_ticks"), F.substring("o_orderpriority", 1, 1).alias("stream"))


MK = "mk AS (SELECT o_orderkey AS market_id, CASE o_orderstatus WHEN 'F' THEN 'UP' WHEN 'O' THEN 'DOWN' END AS outcome, floor(o_totalprice)::BIGINT % 10000 AS up_ticks, CASE WHEN o_custkey % 7 <> 0 THEN 10000 - floor(o_totalprice)::BIGINT % 10000 + 50 END AS down_ticks, substr(o_orderpriority, 1, 1) AS stream FROM orders)"


@query("q_baselines", "WITH " + TR + ", " + MK + """, k AS (SELECT *, CASE WHEN outcome = 'UP' THEN 10000 ELSE 0 END AS uv, CASE WHEN outcome = 'DOWN' THEN 10000 ELSE 0 END AS dv FROM mk WHERE outcome IS NOT NULL AND down_ticks IS NOT NULL),
z AS (SELECT sum(size)::DOUBLE / count(*) AS size FROM tr)
SELECT sum(uv - up_ticks)::BIGINT * any_value(size) AS always_up, sum(dv - down_ticks)::BIGINT * any_value(size) AS always_down, sum(CASE WHEN up_ticks >= down_ticks THEN uv - up_ticks ELSE dv - down_ticks END)::BIGINT * any_value(size) AS always_favourite FROM k, z""")
def q_baselines(spark, d):
    """As many contracts as the trades have on average."""
    return report.baselines(markets(spark, d), trades(spark, d))


@query("q_slippage", "WITH " + FL + """, o AS (SELECT *, CASE WHEN filled > 0 THEN avg_ticks - quoted_ticks END AS slip FROM fl WHERE action = 'open' AND liquidity IS DISTINCT FROM 'maker'), r AS (SELECT slip, row_number() OVER (ORDER BY slip) - 1 AS i, count(*) OVER () AS n FROM o WHERE slip IS NOT NULL)
SELECT count(*) AS orders, count(*) FILTER (WHERE filled > 0 AND levels_walked = 1)::DOUBLE / count(*) AS fills_at_quote, count(*) FILTER (WHERE filled > 0 AND levels_walked > 1)::DOUBLE / count(*) AS partial_fills, count(*) FILTER (WHERE filled <= 0)::DOUBLE / count(*) AS unfilled, (-sum(slip * filled))::BIGINT AS pnl_lost_ticks,
    sum(unfilled_size)::DOUBLE / sum(requested) AS unfilled_size_ratio, (SELECT max(slip) FROM r WHERE i = least(n - 1, floor(0.5 * n))) AS median_slip, (SELECT max(slip) FROM r WHERE i = least(n - 1, floor(0.99 * n))) AS worst_slip FROM o""")
def q_slippage(spark, d):
    return report.slippage(fills(spark, d))


@query("q_activity", "WITH " + FL + """ SELECT count(*) AS fills, sum(filled)::BIGINT AS contracts, sum(filled * avg_ticks)::BIGINT AS value_ticks, coalesce(sum(filled) FILTER (WHERE liquidity IS DISTINCT FROM 'maker'), 0)::BIGINT AS taker_contracts, coalesce(sum(filled) FILTER (WHERE liquidity = 'maker'), 0)::BIGINT AS maker_contracts FROM fl WHERE filled > 0""")
def q_activity(spark, d):
    return report.activity(fills(spark, d))


@query("q_split", "WITH " + TR + " SELECT coalesce(nullif(asset, 7)::VARCHAR, 'unknown') AS asset, side, sum(pnl)::BIGINT AS pnl, count(*) AS trades, count(*) FILTER (WHERE pnl > 0)::DOUBLE / count(*) AS win_rate FROM tr GROUP BY 1, 2")
def q_split(spark, d):
    return report.split(trades(spark, d).withColumn("asset", F.nullif("asset", F.lit(7))), "asset", "side")


ROWS = "WITH " + TR + ", " + MK + ", own AS (SELECT market_id, count(*) AS n, sum(size) AS c, sum(pnl) AS p, min(opened_ms) AS f FROM tr GROUP BY 1), mr AS (SELECT mk.market_id, outcome, stream, n IS NOT NULL AS entered, coalesce(n, 0)::BIGINT AS trades, coalesce(c, 0)::BIGINT AS contracts, coalesce(p, 0)::BIGINT AS pnl, f AS first_ms FROM mk LEFT JOIN own USING (market_id))"


def rows_of_markets(spark, d):
    return report.market_rows(markets(spark, d).drop("up_ticks", "down_ticks"), trades(spark, d))


@query("q_market_rows", ROWS + " SELECT * FROM mr")
def q_market_rows(spark, d):
    return rows_of_markets(spark, d)


@query("q_on_resolved", "WITH " + TR + ", " + MK + " SELECT (SELECT count(*) FROM mk WHERE outcome IS NOT NULL) AS markets, count(*) AS trades, coalesce(sum(pnl), 0)::BIGINT AS net_pnl FROM tr WHERE market_id IN (SELECT market_id FROM mk WHERE outcome IS NOT NULL)")
def q_on_resolved(spark, d):
    return report.on_resolved(trades(spark, d), markets(spark, d))


@query("q_by_settlement", ROWS + """, nr AS (SELECT *, CASE WHEN stream = '3' THEN 'unknown' ELSE stream END AS rule FROM mr),
e AS (SELECT rule, (CASE WHEN t.outcome = 'TIE' THEN 5000 WHEN t.side = t.outcome THEN 10000 ELSE 0 END - t.entry_ticks)::BIGINT AS g, t.size FROM tr t JOIN nr USING (market_id) WHERE t.how = 'settled'),
f AS (SELECT rule, sum(g * size)::DOUBLE / (sum(size) * 10000) AS edge_per_contract, sum(g)::DOUBLE / (count(*) * 10000) AS edge_per_trade FROM e GROUP BY 1)
SELECT rule AS stream, count(*) AS markets, count(*) FILTER (WHERE entered) AS entered, sum(trades)::BIGINT AS trades, sum(pnl)::BIGINT AS pnl, any_value(edge_per_contract) AS edge_per_contract, any_value(edge_per_trade) AS edge_per_trade FROM nr LEFT JOIN f USING (rule) GROUP BY 1""")
def q_by_settlement(spark, d):
    """Streams of markets, one of them unknown, with the edge of their settled trades."""
    rows = rows_of_markets(spark, d).withColumn("stream", F.nullif("stream", F.lit("3")))
    return report.by_settlement(rows, trades(spark, d))


@query("q_split_by_market", "WITH " + TR + """, m AS (SELECT o_orderkey AS market_id, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS asset, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS interval FROM orders WHERE o_totalprice > 50000),
g AS (SELECT trim(coalesce(m.asset, 'unknown') || ' ' || coalesce(m.interval, '')) AS name, sum(pnl)::BIGINT AS pnl, count(*) AS trades FROM tr LEFT JOIN m USING (market_id) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY abs(pnl) DESC, name)::INT AS place FROM g""")
def q_split_by_market(spark, d):
    """Trades by asset and interval of their market; the markets of cheap orders aren't known."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    meta = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("market_id"), F.when(~p.startswith("1"), p).alias("asset"), F.when(s != "P", s).alias("interval"))
    return report.split_by_market(trades(spark, d), meta)


def _cells(spark, d):
    return trades(spark, d).groupBy((F.col("asset") % 6).alias("y"), F.col("o2").alias("x")).agg(F.sum("pnl").alias("v"))


CELL = "WITH " + TR + ", c AS (SELECT asset % 6 AS y, o2 AS x, sum(pnl)::BIGINT AS v FROM tr GROUP BY 1, 2)"


@query("q_sweep_pivot", CELL + " SELECT y, " + ", ".join(f"max(v) FILTER (WHERE x = {i}) AS x_{i}" for i in range(1, 8)) + " FROM c GROUP BY 1")
def q_sweep_pivot(spark, d):
    """A column for each line number that occurs."""
    return report.sweep(_cells(spark, d), "y", "x", "v")


@query("q_sweep_extent", CELL + " SELECT count(*) AS cells, list_sort(list(DISTINCT x)) AS x_labels, list_sort(list(DISTINCT y)) AS y_labels, min(v) AS min, max(v) AS max FROM c")
def q_sweep_extent(spark, d):
    return report.sweep_extent(_cells(spark, d), "y", "x", "v")


@query("q_maker_rates", """WITH s AS (SELECT l_suppkey AS mode, l_linenumber AS submitted, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber - 1 END AS rested, CASE WHEN l_linestatus = 'F' THEN NULL ELSE 1 END AS w, (l_quantity - 10)::DOUBLE AS size, l_returnflag FROM lineitem)
SELECT mode, l_returnflag AS flag, sum(submitted)::BIGINT AS submitted, sum(rested)::BIGINT AS rested, coalesce(sum(w), 0)::BIGINT AS orders_with_maker_fill, 0::BIGINT AS fully_filled, sum(submitted)::BIGINT AS cancelled, 0::BIGINT AS expired,
    sum(greatest(size, 0)) AS rested_size, sum(CASE WHEN size > 20 THEN size ELSE 0 END) AS maker_filled_size, 0::DOUBLE AS taker_on_arrival_size,
    CASE WHEN sum(greatest(size, 0)) > 0 THEN sum(CASE WHEN size > 20 THEN size ELSE 0 END) / sum(greatest(size, 0)) END AS fill_rate_size, CASE WHEN sum(rested) > 0 THEN coalesce(sum(w), 0)::DOUBLE / sum(rested) END AS fill_rate_orders FROM s GROUP BY 1, 2""")
def q_maker_rates(spark, d):
    """Counters of resting orders by supplier and flag; some are missing or negative."""
    r = spark.read.parquet(f"{d}/lineitem.parquet")
    size = (F.col("l_quantity") - 10).cast("double")
    stats = r.select(F.col("l_suppkey").alias("mode"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("submitted"), F.when(F.col("l_returnflag") == "A", -5).otherwise(F.col("l_linenumber") - 1).alias("rested"),
                     F.when(F.col("l_linestatus") != "F", 1).alias("orders_with_maker_fill"), F.lit(-1).alias("fully_filled"), F.col("l_linenumber").alias("cancelled"), F.lit(None).cast("int").alias("expired"),
                     size.alias("rested_size"), F.when(size > 20, size).alias("maker_filled_size"), F.lit(0.0).alias("taker_on_arrival_size"))
    return report.maker_rates(stats, "mode", "flag")


@query("q_log_budget", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, substr('é' || l_linestatus || ' ' || repeat(l_returnflag, l_quantity::INT), 1, 40) AS line FROM lineitem), s AS (SELECT *, strlen(line) + 1 AS b, sum(strlen(line) + 1) OVER (ORDER BY o, n, p) AS upto FROM l)
SELECT o, n, p, line FROM s WHERE upto - b < 100000""")
def q_log_budget(spark, d):
    """What a log of all line items keeps within 100,000 bytes."""
    r = spark.read.parquet(f"{d}/lineitem.parquet")
    line = F.concat(F.lit("é"), F.col("l_linestatus"), F.lit(" "), F.expr("repeat(l_returnflag, cast(l_quantity as int))"))
    return report.log_budget(r.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), line.alias("line")), ["o", "n", "p"], chars=40, limit=100_000)


@query("q_downsample", "WITH " + TR + """, g AS (SELECT closed_ms // 86400000 AS day, sum(pnl)::BIGINT AS v FROM tr GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, day, v, count(*) OVER () AS n FROM g),
b AS (SELECT *, (SELECT max(k) FROM range(0, 49) r(k) WHERE (k * (n - 2)) // 49 <= i - 1) AS b FROM p WHERE i > 0 AND i < n - 1), q AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v, i) AS lo, row_number() OVER (PARTITION BY b ORDER BY v DESC, i) AS hi FROM b)
SELECT day, v FROM q WHERE lo = 1 OR hi = 1 UNION ALL SELECT day, v FROM p WHERE i = 0 OR i = n - 1""")
def q_downsample(spark, d):
    days = trades(spark, d).groupBy(F.floor(F.col("closed_ms") / 86_400_000).alias("day")).agg(F.sum("pnl").alias("v"))
    from tickloom.operators.running import running

    points = running(days, F.floor(F.col("day") / 366), ["day"], F.lit(1).cast("bigint"), "i").withColumn("i", F.col("i") - 1)
    return report.downsample(points, "i", "v", days.count(), 100).select("day", "v")


@query("q_account_series", "WITH " + EV + """, s AS (SELECT market_id AS k, ts_ms AS ts, event_id AS ord, cents AS cash, event_id % 7 AS marked, CASE WHEN cents % 3 = 0 THEN 0 ELSE cents % 100 END AS pos, event_type = 'purchase' AS final FROM ev),
l AS (SELECT min(ts) AS a, coalesce(max(ts) FILTER (WHERE final), max(ts)) AS b FROM s),
g AS (SELECT unnest(range((-(-a // 86400000)) * 86400000, b // 86400000 * 86400000 + 1, 86400000)) AS ts FROM l UNION SELECT b FROM l), k AS (SELECT DISTINCT k FROM s), gk AS (SELECT * FROM g, k),
o AS (SELECT k, ts, arg_max(cash + marked, ord) AS cash, arg_max(pos, ord) AS pos FROM s GROUP BY k, ts),
a AS (SELECT gk.ts, o.cash, o.pos FROM gk ASOF JOIN o ON gk.k = o.k AND gk.ts >= o.ts)
SELECT ts::BIGINT AS ts, sum(cash + pos)::BIGINT AS value, sum(pos)::BIGINT AS position_value, count(*) FILTER (WHERE pos > 0) AS open_positions FROM a GROUP BY 1""")
def q_account_series(spark, d):
    c = F.col("cents")
    s = events(spark, d).select(F.col("market_id").alias("key"), F.col("ts_ms").alias("ts"), F.col("event_id").alias("ord"), c.alias("cash"), (F.col("event_id") % 7).alias("marked"),
                                F.when(c % 3 == 0, F.lit(0)).otherwise(c % 100).cast("bigint").alias("position_value"), (F.col("event_type") == "purchase").alias("final"))
    return report.account_series(s, 86_400_000)


# ---- decoding and discovery -----------------------------------------------------------------

@query("q_coverage", "WITH " + EV + """, k AS (SELECT DISTINCT ts_ms // 86400000 AS day, market_id FROM ev WHERE event_type = 'purchase'), f AS (SELECT DISTINCT ts_ms // 86400000 AS day, market_id FROM ev WHERE event_type = 'error'),
g AS (SELECT k.day, count(*) AS keys, count(f.market_id) AS found FROM k LEFT JOIN f USING (day, market_id) GROUP BY 1),
w AS (SELECT k.day, list(market_id::VARCHAR ORDER BY market_id::VARCHAR) AS without FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.day = k.day AND f.market_id = k.market_id) GROUP BY 1)
SELECT g.*, CASE WHEN found = keys THEN 'full' WHEN found = 0 THEN 'none' ELSE 'partial' END AS cover, CASE WHEN found < keys AND found > 0 THEN without END AS without FROM g LEFT JOIN w USING (day)""")
def q_coverage(spark, d):
    e = events(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000))
    return decode.coverage(e.where("event_type = 'purchase'").select("day", "market_id"), e.where("event_type = 'error'"), ["day", "market_id"])


@query("q_antijoin", "WITH " + EV + " SELECT DISTINCT ts_ms // 86400000 AS day, market_id FROM ev a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'error' AND b.market_id = a.market_id AND b.ts_ms // 86400000 = a.ts_ms // 86400000)")
def q_antijoin(spark, d):
    e = events(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000))
    return e.where("event_type = 'purchase'").select("day", "market_id").distinct().join(e.where("event_type = 'error'"), ["day", "market_id"], "left_anti")


@query("q_unusable", "WITH " + EV + """, t AS (SELECT min(ts_ms) AS a, max(ts_ms) - min(ts_ms) AS span FROM ev),
m AS (SELECT c_custkey AS market_id, CASE WHEN c_custkey % 23 = 0 THEN '' WHEN c_custkey % 11 <> 0 THEN 'btc' END AS asset, CASE WHEN c_custkey % 13 <> 0 THEN ['u', 'd'] END AS token_ids,
    CASE WHEN c_custkey % 17 <> 0 THEN 'prices' || c_custkey % 3 END AS stream, CASE c_custkey % 19 WHEN 0 THEN NULL WHEN 1 THEN 'VOID' WHEN 2 THEN 'TIE' ELSE 'UP' END AS outcome,
    CASE WHEN c_custkey % 5 <> 0 THEN a + span // 8 * (c_custkey % 7) END AS open_ms, CASE WHEN c_custkey % 6 <> 0 THEN a + span // 8 * (c_custkey % 7 + 1) END AS close_ms FROM customer, t),
e AS (SELECT DISTINCT ev.market_id, event_type FROM ev LEFT JOIN m USING (market_id) WHERE event_type <> 'purchase' AND coalesce(ts_ms >= open_ms, true) AND coalesce(ts_ms <= close_ms, true)),
i AS (SELECT market_id FROM m UNION SELECT market_id FROM ev), r AS (SELECT i.market_id, CASE
    WHEN m.market_id IS NULL THEN 'no market metadata'
    WHEN asset IS NULL OR asset = '' THEN 'market has no asset'
    WHEN token_ids IS NULL THEN 'market has no usable [Up, Down] token ids'
    WHEN stream IS NULL THEN 'settlement stream could not be resolved'
    WHEN outcome IS NULL OR outcome NOT IN ('UP', 'DOWN', 'TIE') THEN 'outcome could not be read'
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.market_id = i.market_id) THEN 'no events inside the market window'
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.market_id = i.market_id AND event_type = 'click') THEN 'no settlement ticks on ' || stream END AS reason FROM i LEFT JOIN m ON i.market_id = m.market_id)
SELECT * FROM r WHERE reason IS NOT NULL""")
def q_unusable(spark, d):
    e = events(spark, d)
    first, span = e.agg(F.min("ts_ms")).scalar(), F.floor(e.agg(F.max("ts_ms") - F.min("ts_ms")).scalar() / 8)
    k = F.col("c_custkey")
    m = spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("market_id"), F.when(k % 23 == 0, "").when(k % 11 != 0, "btc").alias("asset"), F.when(k % 13 != 0, F.array(F.lit("u"), F.lit("d"))).alias("token_ids"),
        F.when(k % 17 != 0, F.concat(F.lit("prices"), k % 3)).alias("stream"), F.when(k % 19 == 1, "VOID").when(k % 19 == 2, "TIE").when(k % 19 != 0, "UP").alias("outcome"),
        F.when(k % 5 != 0, first + span * (k % 7)).alias("open_ms"), F.when(k % 6 != 0, first + span * (k % 7 + 1)).alias("close_ms"))
    kind = F.when(F.col("event_type") == "click", "tick").when(F.col("event_type") == "view", "book").when(F.col("event_type") == "purchase", "trade").otherwise("spot")
    return decode.unusable(m, e.select("market_id", "ts_ms", kind.alias("kind")))


DAY0 = 1_704_067_200_000
CELLS = f"""mk AS (SELECT 'm' || s_suppkey AS market_id, 'slug-' || s_suppkey AS slug, 'A' || s_suppkey % 3 AS asset, 'u' || s_suppkey AS token_up, 'd' || s_suppkey AS token_down, CASE WHEN s_suppkey % 2 = 0 THEN 'prices' END AS stream,
    CASE WHEN s_suppkey % 5 <> 0 THEN {DAY0} + s_suppkey % 20 * 86400000 END AS open_ms, CASE WHEN s_suppkey % 9 <> 0 THEN {DAY0} + (s_suppkey % 20 + 1) * 86400000 END AS close_ms FROM supplier WHERE s_suppkey % 7 <> 0),
c0 AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 3 <> 0 THEN 'm' || l_suppkey END AS cid, 'slug-' || l_suppkey AS slug, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_linenumber % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS side,
    {DAY0} + (l_orderkey * 60000 + l_partkey * 1000) % 2592000000 AS ts_ms, l_partkey % 1100 AS p, l_orderkey % 1100 AS p2, l_quantity::BIGINT - 3 AS size, l_linenumber AS n, l_returnflag AS flag, l_partkey AS part FROM lineitem),
c AS (SELECT c0.*, market_id FROM c0 JOIN mk USING (slug) WHERE (open_ms IS NULL OR ts_ms >= open_ms) AND (close_ms IS NULL OR ts_ms <= close_ms)),
cb AS (SELECT * REPLACE (CASE WHEN part % 11 = 0 THEN NULL WHEN part % 2 = 0 THEN 'DOWN' ELSE 'UP' END AS side) FROM c)"""


@query("q_decode_day", "WITH " + EV + ", " + CELLS + """, u AS (
SELECT market_id, 'trade' AS kind, ts_ms, 1 AS sub, seq, 0 AS item, side, NULL AS ladder, p AS px, size, NULL::BIGINT AS bid, NULL::BIGINT AS ask, CASE WHEN n % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS taker, NULL::BIGINT AS cents FROM c WHERE flag = 'A' AND side IS NOT NULL AND p <= 1000 AND size > 0
UNION ALL SELECT market_id, 'book', ts_ms, 1, seq, i.item, CASE WHEN i.item = 0 THEN side ELSE 'UP' END, CASE WHEN n % 3 = 0 THEN 'asks' ELSE 'bids' END, CASE WHEN i.item = 0 THEN p ELSE p2 END, size, NULL, NULL, NULL, NULL FROM c, (VALUES (0), (1)) i(item) WHERE flag = 'N' AND n % 2 = 1 AND size >= 0 AND CASE WHEN i.item = 0 THEN side IS NOT NULL AND p <= 1000 ELSE p2 <= 1000 END
UNION ALL SELECT market_id, 'book', ts_ms, 1, seq, 0, side, NULL, NULL, NULL, p, p2, NULL, NULL FROM c WHERE flag = 'N' AND n % 2 = 0 AND side IS NOT NULL AND p <= p2 AND p2 <= 1000
UNION ALL SELECT market_id, 'book', ts_ms, 0, seq, 0, NULL, NULL, CASE WHEN p <= 1000 AND size > 0 THEN p END, CASE WHEN p <= 1000 AND size > 0 THEN size END, CASE WHEN p <= 1000 AND size > 0 THEN 1000 - p END, CASE WHEN p2 <= 1000 THEN 1000 - p2 END, NULL, NULL FROM c WHERE flag = 'R' AND n % 2 = 0
UNION ALL SELECT market_id, 'book', ts_ms, 0, seq, 0, side, NULL, CASE WHEN side = 'UP' AND p <= 1000 AND size > 0 THEN p END, CASE WHEN side = 'UP' AND p <= 1000 AND size > 0 THEN size END, CASE WHEN side = 'DOWN' AND p2 <= 1000 THEN p2 END, CASE WHEN side = 'DOWN' AND p <= 1000 AND size > 0 THEN p END, NULL, NULL FROM cb WHERE flag = 'R' AND n % 2 = 1 AND side IS NOT NULL
UNION ALL SELECT mk.market_id, 'spot', ts_ms, 1, event_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, cents FROM ev JOIN mk ON 'A' || ev.market_id % 3 = asset AND (open_ms IS NULL OR ts_ms >= open_ms) AND (close_ms IS NULL OR ts_ms <= close_ms) WHERE event_type = 'purchase'
UNION ALL SELECT mk.market_id, 'tick', ts_ms, 1, event_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, cents FROM ev JOIN mk ON 'A' || ev.market_id % 3 = asset AND stream = 'prices' AND (open_ms IS NULL OR ts_ms >= open_ms) AND (close_ms IS NULL OR ts_ms <= close_ms))
SELECT market_id, kind, ts_ms, seq, side, ladder, px::BIGINT AS px, size, bid, ask, taker, cents, row_number() OVER (PARTITION BY market_id ORDER BY ts_ms, CASE kind WHEN 'spot' THEN 0 WHEN 'book' THEN 1 WHEN 'trade' THEN 2 ELSE 3 END, sub, seq, item, side NULLS FIRST, ladder NULLS FIRST, px NULLS FIRST, size NULLS FIRST, bid NULLS FIRST, ask NULLS FIRST)::INT AS pos FROM u""")
def q_decode_day(spark, d):
    """Line items as text rows of four datasets and events as a price feed; suppliers are the markets, a seventh unknown."""
    k = F.col("s_suppkey")
    day = lambda n: F.lit(DAY0) + (k % 20 + n) * 86_400_000
    named = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
    markets = spark.read.parquet(f"{d}/supplier.parquet").where(k % 7 != 0).select(
        named("m", k).alias("market_id"), named("slug-", k).alias("slug"), named("A", k % 3).alias("asset"), named("u", k).alias("token_up"), named("d", k).alias("token_down"), F.when(k % 2 == 0, "prices").alias("stream"),
        F.lit(None).cast("bigint").alias("price_feed_id"), F.when(k % 5 != 0, day(0)).alias("open_ms"), F.when(k % 9 != 0, day(1)).alias("close_ms"))
    key, part, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    price = lambda p: F.format_string("%d.%03d", F.floor(p / 1000), p % 1000)
    p, p2, size = price(part % 1100), price(F.col("l_orderkey") % 1100), (F.col("l_quantity").cast("bigint") - 3).cast("string")
    token = F.when(part % 11 == 0, "x").when(n % 2 == 1, named("u", key)).otherwise(named("d", key))
    side = F.when(n % 3 == 0, "SELL").otherwise("BUY")
    lines_of = lambda which, payload, token=token: spark.read.parquet(f"{d}/lineitem.parquet").where(which).select(
        (F.col("l_orderkey") * 10 + n).alias("seq"), F.when(part % 3 != 0, named("m", key)).alias("condition_id"), named("slug-", key).alias("slug"), token.alias("asset_id"),
        (F.lit(DAY0) + (F.col("l_orderkey") * 60_000 + part * 1000) % 2_592_000_000).cast("string").alias("event_ts_ms"), payload.alias("payload"))
    snapshot = F.format_string('{"asks": [["%s", "%s"]], "bids": "%s:1"}', p, size, p2)
    of_token = F.when(part % 11 == 0, "x").when(part % 2 == 0, named("d", key)).otherwise(named("u", key))
    books = lines_of("l_returnflag = 'R' AND l_linenumber % 2 = 1", snapshot, of_token)
    orderbooks = lines_of("l_returnflag = 'R' AND l_linenumber % 2 = 0", snapshot)
    changes = lines_of("l_returnflag = 'N' AND l_linenumber % 2 = 1", F.format_string('{"price_changes": [{"asset_id": "%s", "side": "%s", "price": "%s", "size": "%s"}, {"asset_id": "%s", "side": "%s", "price": "%s", "size": "%s"}]}', token, side, p, size, named("u", key), side, p2, size))
    bounds = lines_of("l_returnflag = 'N' AND l_linenumber % 2 = 0", F.format_string('{"best_bid": "%s", "best_ask": "%s"}', p, p2))
    prints = lines_of("l_returnflag = 'A' AND l_partkey % 4 <> 0", F.format_string('{"price": "%s", "size": "%s", "side": "%s"}', p, size, side))
    flat = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'A' AND l_partkey % 4 = 0").select((F.col("l_orderkey") * 10 + n).alias("seq"), F.when(part % 3 != 0, named("m", key)).alias("condition_id"), named("slug-", key).alias("slug"), token.alias("asset_id"),
        (F.lit(DAY0) + (F.col("l_orderkey") * 60_000 + part * 1000) % 2_592_000_000).cast("string").alias("event_ts_ms"), p.alias("price"), size.alias("size"), side.alias("side"))  # the values stand in the row itself
    prints = prints.unionByName(flat, allowMissingColumns=True)
    feed = events(spark, d).select(named("A", F.col("market_id") % 3).alias("asset"), F.col("ts_ms").cast("string").alias("feed_ts_ms"), F.col("cents").cast("string").alias("value"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("paid"))
    out = decode.day_events(markets, {"prices": feed}, books, changes, bounds, prints, orderbooks, spot=feed.where("paid").drop("paid"))
    milli = lambda c: F.floor(c * 1000 + 0.5)
    best = lambda s, ladder: F.get(F.col(f"levels.{s}.{ladder}"), 0)
    return out.select("market_id", "kind", "ts_ms", "seq", "side", "ladder", milli(F.coalesce("px", best("UP", "asks").px)).alias("px"), F.coalesce("size", best("UP", "asks")["size"]).cast("bigint").alias("size"),
                      milli(F.coalesce("bid", best("DOWN", "bids").px)).alias("bid"), milli(F.coalesce("ask", best("DOWN", "asks").px)).alias("ask"), "taker", F.col("value").cast("bigint").alias("cents"), "pos")


@query("q_resolution", "WITH " + EV + """, c AS (SELECT market_id, ts_ms, CASE event_type WHEN 'view' THEN 'frame' WHEN 'click' THEN 'explicit' ELSE 'gamma' END AS source, CASE WHEN market_id % 4 = 0 AND cents % 50 = 0 THEN 'DOWN' ELSE 'UP' END AS outcome FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY CASE source WHEN 'frame' THEN 1 WHEN 'explicit' THEN 2 ELSE 3 END, ts_ms, outcome) AS rn FROM c), n AS (SELECT market_id, count(DISTINCT outcome) AS n FROM c GROUP BY 1)
SELECT market_id, CASE WHEN n = 1 THEN outcome END AS outcome, CASE WHEN n = 1 THEN source END AS source, CASE WHEN n = 1 THEN ts_ms END AS ts_ms, n > 1 AS disagree FROM r JOIN n USING (market_id) WHERE rn = 1""")
def q_resolution(spark, d):
    source = F.when(F.col("event_type") == "view", "frame").when(F.col("event_type") == "click", "explicit").otherwise("gamma")
    outcome = F.when((F.col("market_id") % 4 == 0) & (F.col("cents") % 50 == 0), "DOWN").otherwise("UP")
    return decode.resolution(events(spark, d).select("market_id", "ts_ms", source.alias("source"), outcome.alias("outcome")))


@query("q_mark", "WITH " + LV + """, q AS (SELECT o1, o2, o3, ts_ms, CASE WHEN o2 % 2 = 0 THEN ticks / 10000.0::DOUBLE END AS ub, 0.06::DOUBLE AS ua, o3 % 9000 AS ut, CASE WHEN o2 % 3 = 0 THEN ticks / 10000.0::DOUBLE END AS db, 0.5::DOUBLE AS da, o3 % 7000 AS dt, CASE WHEN o2 % 5 <> 0 THEN ticks / 10000.0::DOUBLE END AS tp, o3 % 8000 AS tt FROM lv),
m AS (SELECT *, CASE WHEN ub <= ua AND 9000 - ut <= 5000 THEN 1 WHEN db <= da AND 9000 - dt <= 5000 THEN 2 WHEN tp IS NOT NULL AND 9000 - tt <= 5000 THEN 3 END AS w FROM q)
SELECT o1, o2, o3, CASE w WHEN 1 THEN (ub + ua) / 2 WHEN 2 THEN 1 - (db + da) / 2 WHEN 3 THEN tp END AS mark, CASE w WHEN 1 THEN 'up_mid' WHEN 2 THEN 'down_mid' WHEN 3 THEN 'last_trade' ELSE CASE WHEN ub <= ua OR db <= da OR tp IS NOT NULL THEN 'stale' ELSE 'no_quote' END END AS mark_source, CASE w WHEN 1 THEN 9000 - ut WHEN 2 THEN 9000 - dt WHEN 3 THEN 9000 - tt END AS mark_age_ms FROM m""")
def q_mark(spark, d):
    px = F.col("ticks") / F.lit(10_000.0)
    q = lines(spark, d).select("o1", "o2", "o3", F.when(F.col("o2") % 2 == 0, px).alias("up_bid"), F.lit(0.06).alias("up_ask"), (F.col("o3") % 9000).alias("up_ts"), F.when(F.col("o2") % 3 == 0, px).alias("down_bid"), F.lit(0.5).alias("down_ask"), (F.col("o3") % 7000).alias("down_ts"), F.when(F.col("o2") % 5 != 0, px).alias("trade_px"), (F.col("o3") % 8000).alias("trade_ts"))
    return decode.mark(q, F.lit(9000).cast("bigint"), 5000).select("o1", "o2", "o3", "mark", "mark_source", "mark_age_ms")


@query("q_latest_by_id", "WITH " + LV + " SELECT book_id, ts_ms, o1, o2, o3, size FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts_ms DESC, o1 DESC, o2 DESC, o3 DESC, size DESC) AS rn FROM lv) WHERE rn = 1")
def q_latest_by_id(spark, d):
    return decode.latest_by_id(lines(spark, d), "book_id", ORDER[:5]).select("book_id", *ORDER[:5])


PATHS = """p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'data/polymarket/daily/' || (CASE WHEN event_id % 12 = 0 THEN 'book' ELSE 'nothing' END) || '/BTC-15M/2026-01-0' || (event_id % 9 + 1) || '.jsonl.gz'
    WHEN 1 THEN 'data/chainlink-twap-30s/daily/prices/ETHUSD/2026-01-02.csv.gz' WHEN 2 THEN 'data/predict-fun/orderbook/SOL-HOURLY/x.jsonl.gz' WHEN 3 THEN 'derived/klines/src/DOGE/5m/2026-02-03.csv.gz' WHEN 4 THEN 'data/predict-fun/markets/all.jsonl.gz' ELSE 'elsewhere/' || event_type END AS path FROM events)"""
META = "WITH " + PATHS + """, c AS (SELECT event_id, path, CASE WHEN event_id % 6 IN (2, 4) THEN 'predict' ELSE 'polymarket' END AS venue, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 12 = 0 THEN 'book' ELSE 'other' END WHEN 1 THEN 'twap30s' WHEN 2 THEN 'orderbook' WHEN 3 THEN 'klines' WHEN 4 THEN 'markets' ELSE 'other' END AS dataset,
    CASE event_id % 6 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' WHEN 3 THEN 'DOGE' END AS asset, CASE event_id % 6 WHEN 0 THEN '15m' WHEN 2 THEN '1h' WHEN 3 THEN '5m' END AS interval, CASE WHEN path LIKE '%.csv.gz' THEN 'csv.gz' WHEN path LIKE '%.jsonl.gz' THEN 'jsonl.gz' ELSE '' END AS ext FROM p)"""


def classified(spark, d):
    i = F.col("event_id")
    day = F.concat(F.lit("/BTC-15M/2026-01-0"), (i % 9 + 1).cast("string"), F.lit(".jsonl.gz"))
    path = (F.when(i % 6 == 0, F.concat(F.lit("data/polymarket/daily/"), F.when(i % 12 == 0, "book").otherwise("nothing"), day)).when(i % 6 == 1, "data/chainlink-twap-30s/daily/prices/ETHUSD/2026-01-02.csv.gz")
            .when(i % 6 == 2, "data/predict-fun/orderbook/SOL-HOURLY/x.jsonl.gz").when(i % 6 == 3, "derived/klines/src/DOGE/5m/2026-02-03.csv.gz").when(i % 6 == 4, "data/predict-fun/markets/all.jsonl.gz").otherwise(F.concat(F.lit("elsewhere/"), F.col("event_type"))))
    return paths.classify(spark.read.parquet(f"{d}/events.parquet").select("event_id", path.alias("path")))


@query("q_path_class", META + " SELECT * FROM c")
def q_path_class(spark, d):
    return classified(spark, d)


@query("q_match_query", META + " SELECT event_id FROM c WHERE dataset IN ('book', 'orderbook', 'klines', 'markets') AND (interval IS NULL OR interval = '5m')")
def q_match_query(spark, d):
    return paths.matches(classified(spark, d), dataset="Book, orderbook,klines,markets", interval="5m,none", venue=None).select("event_id")


@query("q_summarise", META + " SELECT array_to_string(list_sort(list(DISTINCT venue)), ',') AS venues, array_to_string(list_sort(list(DISTINCT dataset)), ',') AS datasets, array_to_string(list_sort(list(DISTINCT asset) FILTER (WHERE asset IS NOT NULL)), ',') AS assets, '5m,15m,1h' AS intervals, 'asset,interval' AS nullable FROM c")
def q_summarise(spark, d):
    out = paths.summarise(classified(spark, d))
    return out.select(*[F.array_join(c, ",").alias(c) for c in out.columns])


@query("q_parse_levels", "WITH " + LV + " SELECT o1, o2, o3, ticks, size, CASE WHEN size > 25 THEN 1 ELSE 2 END::INT AS n_levels, (CASE WHEN size > 25 THEN size ELSE 2 * size END)::DOUBLE AS total FROM lv")
def q_parse_levels(spark, d):
    r = lines(spark, d)
    px, size = (F.col("ticks") / 10_000).cast("string"), F.col("size").cast("string")
    bad = F.when(F.col("size") > 25, F.lit("1.5")).otherwise(px)
    form = F.col("o2") % 3
    pairs = F.concat(F.lit("[["), px, F.lit(","), size, F.lit("],["), bad, F.lit(","), size, F.lit("],[null,3]]"))
    objects = F.concat(F.lit('[{"price":"'), px, F.lit('","size":"'), size, F.lit('"},{"price":"'), bad, F.lit('","size":"'), size, F.lit('"}]'))
    plain = F.concat(px, F.lit(":"), size, F.lit("|"), bad, F.lit(":"), size, F.lit("|x:y"))
    levels = P.ladder(P.parse_levels(F.when(form == 0, pairs).when(form == 1, objects).otherwise(plain)))
    found = P.let(levels, lambda l: F.struct(F.size(l).alias("n_levels"), F.aggregate(l, F.lit(0.0), lambda a, x: a + x["size"]).alias("total")))
    return r.select("o1", "o2", "o3", "ticks", "size", found.alias("l")).select("o1", "o2", "o3", "ticks", "size", "l.*")


@query("q_labels", """WITH p AS (SELECT p_partkey, p_size * 900 AS s FROM part) SELECT p_partkey, CASE WHEN s % 86400 = 0 THEN (s // 86400)::VARCHAR || 'd' WHEN s % 3600 = 0 THEN (s // 3600)::VARCHAR || 'h' WHEN s % 60 = 0 THEN (s // 60)::VARCHAR || 'm' ELSE s::VARCHAR || 's' END AS label FROM p""")
def q_labels(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", X.interval_label(F.col("p_size") * 900).alias("label"))


@query("q_order_reason", """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS side, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderkey % 8)::DOUBLE END AS size, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 = 0 THEN floor(o_totalprice / 10000) END AS notional, (o_orderkey % 1201) / 1000.0::DOUBLE AS lim FROM orders),
w AS (SELECT *, coalesce(size, CASE WHEN lim > 0 THEN floor(notional / lim) END) AS want FROM o)
SELECT k, CASE WHEN side IS NULL THEN 'side' WHEN (size IS NULL) = (notional IS NULL) THEN 'size_or_notional' WHEN NOT lim BETWEEN 0 AND 1 THEN 'limit' WHEN notional IS NOT NULL AND lim <= 0 THEN 'notional_needs_limit' WHEN NOT want > 0 THEN 'size' WHEN abs(round_even(want / 2, 0) - want / 2) > 1e-6 THEN 'size_step' WHEN want < 4 THEN 'below_min_size' WHEN abs(round_even(lim / 0.01, 0) - lim / 0.01) > 1e-6 THEN 'off_tick' END AS reason FROM w""")
def q_order_reason(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = F.when(c % 9 == 0, F.lit(None).cast("string")).when(c % 2 == 0, "UP").otherwise("DOWN")
    size, notional = F.when(c % 3 != 0, (k % 8).cast("double")), F.when((c % 3 == 0) | (c % 7 == 0), F.floor(F.col("o_totalprice") / 10_000).cast("double"))
    return o.select(k.alias("k"), X.order_reason(side, size, notional, (k % 1201) / F.lit(1000.0), F.lit(4.0), F.lit(2.0), F.lit(0.01)).alias("reason"))


@query("q_throttle_ms", """WITH w AS (SELECT p_partkey % 5 AS asset, p_partkey AS a, p_partkey + p_size AS b, p_size * 10 AS ms FROM part) SELECT asset, max(ms)::INT AS throttle_ms FROM w GROUP BY 1""")
def q_throttle_ms(spark, d):
    from tickloom.plans.data import throttle_ms

    p = spark.read.parquet(f"{d}/part.parquet")
    w = p.select((F.col("p_partkey") % 5).alias("asset"), F.col("p_partkey").alias("from"), (F.col("p_partkey") + F.col("p_size")).alias("to"), (F.col("p_size") * 10).alias("ms"))
    return throttle_ms(w, 0, 1 << 60)


@query("q_edge_at_signal", "WITH " + LV + ", " + DEPTH + ", " + OD + """, m AS (SELECT od.*, ticks, size, coalesce(sum(size) OVER (PARTITION BY order_id ORDER BY ticks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM od JOIN dp USING (book_id) WHERE ladder = 'asks' AND ticks <= limit_ticks),
k AS (SELECT *, greatest(0, least(size, qty - before))::BIGINT AS taken FROM m WHERE qty > before), s AS (SELECT k.*, CASE o_orderstatus WHEN 'F' THEN 10000 WHEN 'O' THEN 0 ELSE 5000 END AS value FROM k JOIN orders ON order_id = o_orderkey)
SELECT limit_ticks, sum(taken)::BIGINT AS contracts, sum(taken * (value - ticks))::BIGINT AS pnl_ticks, sum(taken * (value - ticks) * (value - ticks))::DOUBLE / (sum(taken) * 1e8) AS brier FROM s GROUP BY 1""")
def q_edge_at_signal(spark, d):
    """At each signal take depth, settle, and report edge and Brier score by limit."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    outcome = F.when(F.col("o_orderstatus") == "F", "UP").when(F.col("o_orderstatus") == "O", "DOWN").otherwise("TIE")
    settled = walked(spark, d).join(o.select(F.col("o_orderkey").alias("order_id"), outcome.alias("outcome")), "order_id")
    gain = (X.contract_value(F.lit("UP"), F.col("outcome")) * 10_000).cast("bigint") - F.col("ticks")
    return settled.groupBy("limit_ticks").agg(F.sum("taken").alias("contracts"), F.sum(F.col("taken") * gain).alias("pnl_ticks"), report.ratio(F.sum(F.col("taken") * gain * gain), F.sum("taken") * F.lit(1e8)).alias("brier"))
