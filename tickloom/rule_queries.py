"""More operators bound to the driver's tables: rules on cells, records, client books, quotes and counters.

Each SQL states the rule in its own form, so that it doesn't repeat the operator's expression.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import parsing as P
from tickloom.functions import prices as X
from tickloom.operators import book, decode, report, temporal
from tickloom.plans import data
from tickloom.queries import EV, FL, LV, META, ORDER, TR, _ms, classified, events, fills, lines, query, trades
from tickloom.sources import paths


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").withColumn("k", F.col("p_partkey"))


def _pick(by, *values):
    """The value at place ``by``, which counts from 0; None is null."""
    out = None
    for i, v in enumerate(values):
        v = F.lit(None).cast("string") if v is None else v if not isinstance(v, str) else F.lit(v)
        out = F.when(by == i, v) if out is None else out.when(by == i, v)
    return out


# ---- cells ----------------------------------------------------------------------------------

@query("q_strict_decimal", """WITH p AS (SELECT p_partkey AS k, p_partkey || '.' || p_size AS n FROM part)
SELECT k, CASE k % 12 WHEN 0 THEN n::DOUBLE WHEN 1 THEN -(n::DOUBLE) WHEN 2 THEN k::DOUBLE WHEN 3 THEN k / 1000.0::DOUBLE WHEN 4 THEN ('0.' || k)::DOUBLE END AS value FROM p""")
def q_strict_decimal(spark, d):
    n = F.concat(F.col("k").cast("string"), F.lit("."), F.col("p_size").cast("string"))
    k = F.col("k").cast("string")
    cell = _pick(F.col("k") % 12, n, F.concat(F.lit("-"), n), F.concat(F.lit("+"), k, F.lit(".")), F.concat(k, F.lit("e-3")), F.concat(F.lit("."), k), "", " 12", "0x1F", "1e999", "NaN", "1,5", None)
    return _part(spark, d).select("k", P.strict_decimal(cell).alias("value"))


@query("q_iso_times", """WITH o AS (SELECT event_id AS k, epoch_us(ts) // 1000000 * 1000 AS t FROM events)
SELECT k, CASE k % 9 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - 19800000 + 123 WHEN 3 THEN t + 12600000 + 500 WHEN 6 THEN t END AS iso,
    CASE k % 9 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - 19800000 + 123 WHEN 3 THEN t + 12600000 + 500 WHEN 6 THEN t WHEN 7 THEN t WHEN 8 THEN t END AS any_unit FROM o""")
def q_iso_times(spark, d):
    at = F.col("ts").cast("timestamp_ntz")
    o = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("k"), F.floor(_ms("ts") / 1000).alias("s"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("text"))
    text, seconds = F.col("text"), F.col("s").cast("string")
    cell = _pick(F.col("k") % 9, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")), F.concat(text, F.lit("+00")), F.concat(text, F.lit(".1239+05:30")), F.concat(text, F.lit(".5-0330")), text,
                 "2024-02-30 00:00:00Z", F.concat(F.lit(" "), text, F.lit("+00:00 ")), seconds, F.concat(seconds, F.lit("000999")))  # us, cut to ms
    return o.withColumn("cell", cell).select("k", P.iso_ms(F.col("cell")).alias("iso"), P.epoch_ms(F.col("cell")).alias("any_unit"))


@query("q_strict_ladder", "WITH " + LV + """ SELECT o1, o2, o3, size, CASE WHEN o2 % 4 IN (0, 3) THEN ticks END AS first_ticks, CASE WHEN o2 % 4 IN (0, 3) THEN 2 END AS levels FROM lv""")
def q_strict_ladder(spark, d):
    r = lines(spark, d)
    level = lambda ticks, size: F.struct((ticks / F.lit(10_000.0)).alias("px"), size.cast("double").alias("size"))
    t = F.col("ticks")
    good = F.array(level(t, F.col("size")), level(t + 1, F.lit(0)))
    twice = F.array(level(t, F.col("size")), level(t, F.lit(2)))  # a tick that comes twice
    unread = F.array(level(t, F.col("size")), F.struct(F.lit(None).cast("double").alias("px"), F.lit(1.0).alias("size")))
    found = P.strict_ladder(F.when(F.col("o2") % 4 == 1, twice).when(F.col("o2") % 4 == 2, unread).otherwise(good))
    return r.select("o1", "o2", "o3", "size", found.alias("l")).select("o1", "o2", "o3", "size", X.to_ticks(F.get("l", 0).px).cast("bigint").alias("first_ticks"), F.when(F.col("l").isNotNull(), F.size("l")).alias("levels"))


@query("q_mirror", "WITH " + LV + " SELECT o1, o2, o3, size, 10000 - ticks AS mirrored, 2 * size AS depth FROM lv")
def q_mirror(spark, d):
    r = lines(spark, d)
    both = X.mirror(F.array(F.struct((F.col("ticks") / F.lit(10_000.0)).alias("px"), F.col("size").alias("size")), F.struct(F.lit(0.5).alias("px"), F.col("size").alias("size"))))
    return r.select("o1", "o2", "o3", "size", both.alias("m")).select("o1", "o2", "o3", "size", F.round(F.get("m", 0).px * 10_000).cast("bigint").alias("mirrored"), (F.get("m", 0)["size"] + F.get("m", 1)["size"]).alias("depth"))


@query("q_rounding", """SELECT o_orderkey AS k, floor(o_totalprice / 7 * 1e5 + 0.5)::BIGINT AS fee_e5, floor(o_totalprice / 7 * 100 + 1e-9)::BIGINT AS cents, floor(o_totalprice / 7 * 100 + 0.5)::BIGINT AS shown_cents FROM orders""")
def q_rounding(spark, d):
    x = F.col("o_totalprice") / 7
    e5 = lambda c, n: F.round(c * n).cast("bigint")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), e5(X.round_fee(x), 1e5).alias("fee_e5"), e5(X.floor_cents(x), 100).alias("cents"), e5(report.rounded(x, 2), 100).alias("shown_cents"))


@query("q_queue_models", "WITH " + LV + """, q AS (SELECT o1, o2, o3, size, (o3 % 97)::DOUBLE AS a, size::DOUBLE AS b FROM lv)
SELECT o1, o2, o3, size, CASE WHEN a > 0 THEN round((b * b) / (b * b + a * a) * 1e6)::BIGINT END AS power, CASE WHEN a > 0 THEN round((b * b) / ((a + b) * (a + b)) * 1e6)::BIGINT END AS power2,
    CASE WHEN a > 0 THEN round((1 - (a / (a + b)) * (a / (a + b))) * 1e6)::BIGINT END AS power3, CASE WHEN a > 0 THEN round(ln(1 + b) / (ln(1 + b) + ln(1 + a)) * 1e6)::BIGINT END AS log, CASE WHEN a > 0 THEN round(ln(1 + b) / ln(1 + a + b) * 1e6)::BIGINT END AS log2 FROM q""")
def q_queue_models(spark, d):
    models = ["power", "power2", "power3", "log", "log2"]
    chance = [F.round(X.queue_probability((F.col("o3") % 97).cast("double"), F.col("size").cast("double"), m) * 1e6).cast("bigint").alias(m) for m in models]
    return lines(spark, d).select("o1", "o2", "o3", "size", *chance)


_MUL = lambda a, b: f"(({a})::HUGEINT * {b} % 4294967296)::BIGINT"


@query("q_seeded_uniform", f"""WITH s AS (SELECT event_id AS k, ((event_id % 1000)::HUGEINT * 7919 + (event_id % 50 + 1)::HUGEINT * 2654435769) % 4294967296 AS s FROM events),
a AS (SELECT k, s::BIGINT AS s FROM s), b AS (SELECT k, {_MUL("xor(s, s >> 16)", 569420461)} AS z FROM a), c AS (SELECT k, {_MUL("xor(z, z >> 15)", 1935289751)} AS z FROM b)
SELECT k, xor(z, z >> 15)::BIGINT AS draw FROM c""")
def q_seeded_uniform(spark, d):
    k = F.col("event_id")
    u = X.seeded_uniform(k % 1000 * 7919, k % 50 + 1)
    return spark.read.parquet(f"{d}/events.parquet").select(k.alias("k"), (u * 4294967296).cast("bigint").alias("draw"))


# ---- records --------------------------------------------------------------------------------

@query("q_outcome_rules", """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' END END AS listed,
    CASE p_size % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 2 THEN 'TIE' END AS paid, CASE WHEN p_size > 25 THEN 'UP' WHEN p_size < 25 THEN 'DOWN' ELSE 'TIE' END AS moved,
    CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN p_size % 3 = 1 THEN 'rate' ELSE 'unknown' END ELSE 'unknown' END AS fee, CASE WHEN p_partkey % 4 = 1 AND p_size % 3 = 1 THEN p_size / 1000.0::DOUBLE END AS rate,
    CASE WHEN p_partkey % 3 <> 0 THEN CASE p_size % 5 WHEN 0 THEN 'prices' WHEN 1 THEN 'prices' WHEN 2 THEN 'twap30s' WHEN 3 THEN 'twap60s' END END AS stream,
    CASE WHEN p_partkey % 5 <> 0 THEN CASE p_size % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' END END AS side, CASE p_size % 5 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 2 THEN 'DOWN' END AS labelled,
    (p_partkey % 3 = 0 AND p_size % 2 = 0) AS rules_ok FROM part""")
def q_outcome_rules(spark, d):
    k, s = F.col("k"), F.col("p_size")
    pair = F.when(s % 4 == 0, F.array(F.lit("1"), F.lit("0"))).when(s % 4 == 1, F.array(F.lit("0"), F.lit("1"))).when(s % 4 == 2, F.array(F.lit("0.5"), F.lit("0.5"))).otherwise(F.array(F.lit("0.99"), F.lit("0.01")))
    enabled = F.when(k % 4 == 0, F.lit(False)).when(k % 4 <= 2, F.lit(True))
    rate = F.when(k % 4 == 1, s / F.lit(1000.0))  # enabled without a rate, or not stated at all, is unknown
    tokens = F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    token = _pick(s % 3, "a", "b", "c")
    label = _pick(s % 5, "UP", " no", "NO ", "maybe", None)
    fee = X.fee_model(enabled, rate, s % 3)
    tick = F.when(k % 3 == 0, F.lit(0.001)).when(k % 3 == 1, F.lit(0.00015)).otherwise(F.lit(0.0))
    return _part(spark, d).select(
        "k", X.resolved_outcome(k % 2 == 0, pair).alias("listed"), X.outcome_of_pair(F.get(pair, 0).cast("double"), F.get(pair, 1).cast("double")).alias("paid"), X.outcome_of_prices(F.lit(25), s).alias("moved"),
        fee.model.alias("fee"), fee.rate.alias("rate"), X.settlement_stream(k % 3 != 0, F.when(s % 5 == 1, 0).when(s % 5 == 2, 30).when(s % 5 == 3, 60).when(s % 5 == 4, 45)).alias("stream"),
        X.side_of_token(token, tokens).alias("side"), X.side_of_label(label, F.array(F.lit("Yes"), F.lit("No"))).alias("labelled"), X.market_rules_ok(tick, (s % 2 == 0).cast("double")).alias("rules_ok"))


@query("q_market_records", """SELECT 'm' || p_partkey AS market_id, CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR || 'h' ELSE (p_size * 15)::VARCHAR || 'm' END AS interval, p_partkey::DOUBLE AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'UP' END AS outcome, p_partkey * 1000 AS open_ms, (p_partkey + p_size) * 1000 AS close_ms,
    CASE p_size % 3 WHEN 0 THEN 'prices' WHEN 1 THEN 'twap30s' END AS stream, 'u' || p_partkey AS token_up, 'd' || p_partkey AS token_down, NULL::BIGINT AS price_feed_id, 'rate' AS fee FROM part
UNION ALL SELECT p_partkey::VARCHAR, '15m', p_size::DOUBLE, CASE WHEN p_size < 20 THEN 'UP' WHEN p_size > 20 THEN 'DOWN' ELSE 'TIE' END, p_partkey * 1000, (p_partkey + 900) * 1000, 'prices', NULL, NULL, p_partkey % 10, 'unknown' FROM part""")
def q_market_records(spark, d):
    """Records of both venues from parts, in one table."""
    p, k, s = _part(spark, d), F.col("k"), F.col("p_size")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    config = F.when(s % 3 != 2, F.struct(F.when(s % 3 == 1, 30).alias("twapLookbackSeconds")))
    schedule = F.struct(F.lit(0.07).alias("rate"), F.lit(1).alias("exponent"))
    first = p.select(name("m").alias("condition_id"), name("s").alias("slug"), F.lit("BTC").alias("asset"), (s * 900).alias("interval_sec"), F.concat(k.cast("string"), F.lit("0" * 18)).alias("strike_value"), (k % 2 == 0).alias("resolved"),
                     F.array(F.lit("1"), F.lit("0")).alias("outcome_prices"), k.alias("start_sec"), (k + s).alias("end_sec"), F.array(name("u"), name("d")).alias("token_ids"),
                     F.struct(config.alias("cryptoMarketConfig"), F.lit(True).alias("feesEnabled"), schedule.alias("feeSchedule")).alias("raw"))
    second = p.select(k.alias("market_id"), name("c").alias("category_slug"), F.lit("ETH").alias("asset"), F.lit("15m").alias("interval_label"), s.cast("string").alias("start_price"), F.lit(" 20 ").alias("end_price"),
                      k.alias("start_sec"), (k + 900).alias("end_sec"), (k % 10).cast("string").alias("price_feed_id"))
    both = decode.polymarket_records(first).unionByName(decode.predict_records(second))
    return both.select("market_id", "interval", "strike", "outcome", "open_ms", "close_ms", "stream", "token_up", "token_down", "price_feed_id", F.col("fee.model").alias("fee"))


@query("q_generic_records", """SELECT 'c' || c_custkey AS id, CASE c_custkey % 15 WHEN 1 THEN 'no market id' WHEN 2 THEN 'token_ids' WHEN 3 THEN 'token_ids' WHEN 4 THEN 'labels' WHEN 5 THEN 'labels differ' WHEN 6 THEN 'label side' WHEN 7 THEN 'trading end' WHEN 8 THEN 'fee' WHEN 9 THEN 'rules'
    WHEN 10 THEN 'resolution' WHEN 11 THEN 'gamma resolution' WHEN 12 THEN 'not an object' END AS reason, CASE c_custkey % 15 WHEN 13 THEN 'explicit DOWN 1735776000000 gamma UP 1735776000000' WHEN 14 THEN 'gamma TIE 1735776000000' ELSE '' END AS evidence FROM customer""")
def q_generic_records(spark, d):
    """User records as JSON lines; most break one rule each, some say how their market ended."""
    k = F.col("c_custkey").cast("string")
    case = F.col("c_custkey") % 15
    market = F.when(case == 1, F.lit("")).otherwise(F.concat(F.lit('"market_id":"c'), k, F.lit('",')))
    tokens = F.when(case == 2, F.lit('["a","a"]')).when(case == 3, F.lit("[1,2]")).otherwise(F.concat(F.lit('["u'), k, F.lit('","d'), k, F.lit('"]')))
    labels = F.when(case == 4, F.lit('["Yes"," "]')).when(case == 5, F.lit('["Yes"," yes"]')).when(case == 6, F.lit('["No","Up"]')).otherwise(F.lit('["Yes","No"]'))
    more = (F.when(case == 7, F.lit(',"trading_end_ts_ms":"soon"')).when(case == 8, F.lit(',"fee":{"model":"rate","rate":1.5}')).when(case == 9, F.lit(',"tick_size":0.00015,"min_size":1'))
            .when(case == 10, F.lit(',"resolution":{"outcome":"UP"}')).when(case == 13, F.lit(',"resolution":{"outcome":"DOWN","resolved_ts_ms":1735776000000}')).otherwise(F.lit("")))
    prices = F.when(case == 11, F.lit('[\\"0.9\\",\\"0.1\\"]')).when(case == 13, F.lit('[\\"1\\",\\"0\\"]')).otherwise(F.lit('[\\"0.5\\",\\"0.5\\"]'))
    ended = F.when(case.isin(11, 13, 14), F.concat(F.lit(',"umaResolutionStatus":"resolved","umaEndDate":"2025-01-02T00:00:00Z","outcomePrices":"'), prices, F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(F.lit("{"), market, F.lit('"token_ids":'), tokens, F.lit(',"labels":'), labels, F.lit(',"gamma":{"slug":"c'), k, F.lit('"'), ended, F.lit("}"), more, F.lit("}"))
    text = F.when(case == 12, F.lit("[1]")).otherwise(text)
    found = decode.generic_records(spark.read.parquet(f"{d}/customer.parquet").select(text.alias("value"), F.concat(F.lit("c"), k).alias("id")), keep=["id"])
    return found.select("id", "reason", F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x.source, x.outcome, x.ts_ms.cast("string"))), " ").alias("evidence"))


@query("q_duplicated", """SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2 HAVING count(*) > 1""")
def q_duplicated(spark, d):
    return decode.duplicated(spark.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", "c_name", "c_nationkey")


@query("q_frame_markets", """WITH f AS (SELECT o_orderkey AS seq, 't' || o_custkey % 40 AS a, CASE WHEN o_orderkey % 3 <> 0 THEN 't' || (o_custkey % 40 + CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 40 END) END AS b FROM orders),
t AS (SELECT 't' || i AS id, 'm' || i % 20 % 17 AS market_id FROM range(0, 60) r(i) WHERE i % 7 <> 0),
h AS (SELECT seq, x.market_id AS x, y.market_id AS y FROM f LEFT JOIN t x ON a = x.id LEFT JOIN t y ON b = y.id)
SELECT seq, CASE WHEN x IS NULL OR y IS NULL OR x = y THEN coalesce(x, y) END AS market_id, coalesce(x <> y, false) AS conflict FROM h""")
def q_frame_markets(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    named = lambda x: F.concat(F.lit("t"), x.cast("string"))
    frames = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("seq"), named(c % 40).alias("a"), F.when(k % 3 != 0, named(c % 40 + F.when(k % 5 == 0, 20).otherwise(40))).alias("b"))
    i = F.col("id")
    tokens = spark.range(60).where(i % 7 != 0).select(named(i).alias("id"), F.concat(F.lit("m"), (i % 20 % 17).cast("string")).alias("market_id"))
    return decode.conflicts(frames, tokens)


@query("q_poisoned", """SELECT o_custkey AS market_id, arg_min(o_orderstatus || o_orderpriority, o_orderkey) AS reason, count(*) AS bad FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def q_poisoned(spark, d):
    frames = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("market_id"), F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", "o_orderpriority").alias("reason"))
    return decode.poisoned(frames, F.col("reason").startswith("P"))


@query("q_row_markets", """WITH m AS (SELECT 'c' || c_custkey AS market_id, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || c_nationkey END AS slug FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT slug, max(market_id) AS by_slug FROM m GROUP BY 1)
SELECT o_orderkey AS k, coalesce(m.market_id, by_slug) AS market_id FROM orders LEFT JOIN m ON m.market_id = 'c' || o_custkey LEFT JOIN g ON g.slug = 'n' || o_orderkey % 40 WHERE coalesce(m.market_id, by_slug) IS NOT NULL""")
def q_row_markets(spark, d):
    c = F.col("c_custkey")
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    markets = spark.read.parquet(f"{d}/customer.parquet").where(c % 3 != 0).select(named("c", c).alias("market_id"), F.when(c % 4 != 0, named("n", F.col("c_nationkey"))).alias("slug"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), named("c", F.col("o_custkey")).alias("cid"), named("n", F.col("o_orderkey") % 40).alias("slug"))
    return decode.with_market(rows, markets, "cid", "slug").select("k", "market_id")


@query("q_before_settlement", "SELECT p_partkey AS market_id, p_size AS min_size, p_partkey * 1000 AS close_ts_ms, 0 AS hidden FROM part")
def q_before_settlement(spark, d):
    markets = _part(spark, d).select(F.col("k").alias("market_id"), F.col("p_size").alias("min_size"), (F.col("k") * 1000).alias("trading_end_ts_ms"), F.lit("UP").alias("outcome"), (F.col("k") * 2000).alias("resolved_ms"))
    seen = decode.before_settlement(markets, generic=True)
    return seen.select("market_id", "min_size", "close_ts_ms", F.lit(len({"outcome", "resolved_ms"} & set(seen.columns))).alias("hidden"))


# ---- books and quotes -----------------------------------------------------------------------

@query("q_client_book", "WITH " + LV + """, c AS (SELECT book_id, ladder, ticks, o1 AS ord, (sum(size) - 10)::BIGINT AS size, bool_or(o1 % 40 = 0) AS snap FROM lv GROUP BY ALL),
s AS (SELECT book_id, ladder, max(ord) AS since FROM c WHERE snap GROUP BY 1, 2), b AS (SELECT book_id, ladder, o1 AS ord, min(ticks) AS t FROM lv WHERE flag = 'R' AND o3 % 20 = 0 GROUP BY ALL),
l AS (SELECT book_id, ladder, ticks, arg_max(size, ord) AS size, max(ord) AS ord FROM c GROUP BY 1, 2, 3)
SELECT l.book_id, l.ladder, lpad(ticks::VARCHAR, 5, '0') AS price, size FROM l LEFT JOIN s USING (book_id, ladder) WHERE size > 0 AND ord >= coalesce(since, 0)
AND NOT EXISTS (SELECT 1 FROM b WHERE b.book_id = l.book_id AND b.ladder = l.ladder AND b.ord >= l.ord AND CASE l.ladder WHEN 'asks' THEN l.ticks < t ELSE l.ticks > t END)""")
def q_client_book(spark, d):
    """Every order is one feed row of a book; some rows are snapshots, some carry a best price."""
    r = lines(spark, d)
    changes = r.groupBy("book_id", "ladder", "ticks", F.col("o1").alias("ord")).agg((F.sum("size") - 10).alias("size"))
    changes = changes.withColumns({"snapshot": F.col("ord") % 40 == 0, "price": F.lpad(F.col("ticks").cast("string"), 5, "0")})
    bounds = r.where("flag = 'R' AND o3 % 20 = 0").groupBy("book_id", "ladder", F.col("o1").alias("ord")).agg(F.min("ticks").alias("ticks"))
    return book.rebuild(changes, ["book_id"], bounds).select("book_id", "ladder", "price", "size")


@query("q_opening_quotes", "WITH " + LV + """, x AS (SELECT book_id, o1, nullif(last_value(CASE WHEN o2 % 2 = 1 THEN coalesce(t, -1) END IGNORE NULLS) OVER w, -1) AS up_ticks, nullif(last_value(CASE WHEN o2 % 2 = 0 THEN coalesce(t, -1) END IGNORE NULLS) OVER w, -1) AS down_ticks, row_number() OVER w AS rn
FROM (SELECT *, CASE WHEN size > 5 THEN ticks END AS t FROM lv) WINDOW w AS (PARTITION BY book_id ORDER BY ts_ms, o1, o2, o3, size, ticks ROWS UNBOUNDED PRECEDING))
SELECT book_id, arg_min(up_ticks, rn) AS up_ticks, arg_min(down_ticks, rn) AS down_ticks FROM x WHERE up_ticks IS NOT NULL AND down_ticks IS NOT NULL GROUP BY 1""")
def q_opening_quotes(spark, d):
    tops = lines(spark, d).select("book_id", *ORDER, F.when(F.col("o2") % 2 == 1, "UP").otherwise("DOWN").alias("side"), F.when(F.col("size") > 5, F.col("ticks")).alias("ask_ticks"))
    return book.opening_quotes(tops, "book_id", ORDER)


@query("q_opening_snapshot", "WITH " + LV + """, m AS (SELECT s_suppkey AS market_id, (SELECT min(ts_ms) FROM lv) + s_suppkey % 400 * 86400000 AS open_ms FROM supplier),
c AS (SELECT lv.*, market_id, open_ms FROM lv JOIN m ON book_id = market_id WHERE ts_ms < open_ms), x AS (SELECT market_id, open_ms, ladder, ticks, arg_max(size, (ts_ms, o1, o2, o3, size)) AS size FROM c GROUP BY ALL)
SELECT market_id, open_ms AS ts_ms, true AS snapshot, ladder, ticks, size FROM x""")
def q_opening_snapshot(spark, d):
    r = lines(spark, d).withColumn("market_id", F.col("book_id")).withColumn("snapshot", F.lit(False))
    first = r.agg(F.min("ts_ms")).scalar()
    k = F.col("s_suppkey")
    markets = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("market_id"), (first + k % 400 * 86_400_000).alias("open_ms"))
    return book.opening_snapshot(r, markets, ORDER)


@query("q_record_grid", "WITH " + EV + """, n AS (SELECT market_id, ts_ms, event_id, cents, lead(ts_ms) OVER (PARTITION BY market_id ORDER BY ts_ms, event_id) AS nxt FROM ev),
g AS (SELECT market_id, event_id, cents, unnest(CASE WHEN nxt IS NULL THEN [ts_ms] ELSE range((ts_ms + 86399999) // 86400000 * 86400000, nxt, 86400000) END) AS "at" FROM n) SELECT market_id, event_id, cents, "at" FROM g""")
def q_record_grid(spark, d):
    s = events(spark, d).select("market_id", F.col("ts_ms").alias("ts"), F.col("event_id").alias("ord"), "event_id", "cents")
    return book.record_grid(s, "market_id", 86_400_000).select("market_id", "event_id", "cents", "at")


@query("q_asof_last_k", "WITH " + EV + """, v AS (SELECT market_id, ts_ms, event_id, cents FROM ev WHERE event_type = 'view'), a AS (SELECT event_id, market_id, ts_ms - 60000 AS at FROM ev WHERE event_type = 'purchase'),
r AS (SELECT a.event_id, v.cents, row_number() OVER (PARTITION BY a.event_id ORDER BY v.ts_ms DESC, v.event_id DESC) AS back FROM a LEFT JOIN v ON v.market_id = a.market_id AND v.ts_ms <= a.at)
SELECT event_id, coalesce(string_agg(cents::VARCHAR, ',' ORDER BY back DESC), '') AS seen FROM r WHERE back <= 4 GROUP BY 1""")
def q_asof_last_k(spark, d):
    e = events(spark, d)
    asks = e.where("event_type = 'purchase'").select("event_id", "market_id", "ts_ms")
    views = e.where("event_type = 'view'").select("market_id", F.col("ts_ms").alias("seen_ms"), F.col("event_id").alias("seen_id"), "cents")
    found = temporal.asof_last(asks, views, ["market_id"], "ts_ms", "seen_ms", "cents", 4, ["seen_id"], lag_ms=60_000)
    return found.select("event_id", F.array_join(F.transform("last", lambda x: x.cast("string")), ",").alias("seen"))


# ---- panels and plans -----------------------------------------------------------------------

@query("q_maker_fills", "WITH " + FL + """, m AS (SELECT filled, requested % 40 AS ahead, CASE WHEN quoted_ticks % 3 <> 0 THEN avg_ticks * 10 END AS wait, CASE WHEN levels_walked <> 2 THEN avg_ticks - quoted_ticks - 5 END AS mk FROM fl WHERE liquidity = 'maker' AND filled > 0)
SELECT count(*) AS fills, sum(filled)::BIGINT AS size, sum(mk * filled)::DOUBLE / sum(filled) FILTER (WHERE mk IS NOT NULL) AS mk_1s_mean, count(mk) AS mk_1s_fills, (sum(filled) FILTER (WHERE mk IS NOT NULL))::BIGINT AS mk_1s_size,
    list_sort(list(ahead))[count(*) // 2 + 1] AS median_ahead_at_join, list_sort(list(wait) FILTER (WHERE wait IS NOT NULL))[count(wait) // 2 + 1] AS median_in_queue_ms FROM m""")
def q_maker_fills(spark, d):
    f = fills(spark, d).withColumns({"ahead_at_join": F.col("requested") % 40, "in_queue_ms": F.when(F.col("quoted_ticks") % 3 != 0, F.col("avg_ticks") * 10), "mk_1s": F.when(F.col("levels_walked") != 2, F.col("avg_ticks") - F.col("quoted_ticks") - 5)})
    return report.maker_fills(f, ["mk_1s"], ["ahead_at_join", "in_queue_ms"])


@query("q_orders_panel", """SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS reason, count(*) AS orders, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1""")
def q_orders_panel(spark, d):
    p = F.col("o_orderpriority")
    return report.orders_panel(spark.read.parquet(f"{d}/orders.parquet").select(F.when(~p.startswith("1"), p).alias("reason")))


@query("q_fee_models", """SELECT CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'rate' ELSE 'unknown' END AS model, count(*) AS markets FROM part GROUP BY 1""")
def q_fee_models(spark, d):
    s = F.col("p_size") % 3
    return report.fee_models(_part(spark, d).select(F.when(s < 2, F.struct(F.when(s == 0, "none").otherwise("rate").alias("model"))).alias("fee")))


@query("q_crosscheck", """SELECT count(*) AS checks, count(*) FILTER (WHERE o_orderstatus IS NOT DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' END) AS matches,
    count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' END) AS mismatches FROM orders""")
def q_crosscheck(spark, d):
    k = F.col("o_orderkey") % 3
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("actual"), F.when(k == 0, "F").when(k == 1, "O").alias("claimed"))
    return report.crosscheck(o, "claimed", "actual")


@query("q_marked_extras", "WITH " + TR + """, m AS (SELECT *, CASE WHEN o3 % 3 = 0 THEN 'marked' ELSE how END AS h, o3 % 4 AS x FROM tr)
SELECT (sum(pnl) FILTER (WHERE h <> 'marked'))::BIGINT AS realised_pnl, (sum(pnl) FILTER (WHERE h = 'marked'))::BIGINT AS marked_pnl, count(DISTINCT market_id) FILTER (WHERE h = 'marked') AS marked_markets, count(*) FILTER (WHERE h = 'marked' AND x = 0) AS zero_legs, max(o3) FILTER (WHERE h = 'marked') AS max_mark_age_ms FROM m""")
def q_marked_extras(spark, d):
    o3 = F.col("o3")
    t = trades(spark, d).withColumns({"how": F.when(o3 % 3 == 0, "marked").otherwise(F.col("how")), "exit_ticks": o3 % 4, "mark_age_ms": o3})
    return report.marked_extras(t)


@query("q_over_budget", "WITH " + EV + """, w AS (SELECT market_id, event_id, avg(cents) OVER r AS m, count(*) OVER r AS n FROM ev WINDOW r AS (PARTITION BY market_id ORDER BY event_id ROWS 4 PRECEDING)) SELECT market_id, min(event_id) AS at FROM w WHERE n = 5 AND m > 5000 GROUP BY 1""")
def q_over_budget(spark, d):
    return report.over_budget(events(spark, d), "market_id", "event_id", "cents", 5000, size=5)


DAYS = "dy AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS dataset FROM events)"


def _days(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd").alias("day"), F.col("event_type").alias("dataset"))


@query("q_complete_days", "WITH " + DAYS + " SELECT day FROM dy GROUP BY day HAVING count(DISTINCT dataset) >= 5")
def q_complete_days(spark, d):
    return data.complete_days(_days(spark, d), 5)


@query("q_last_days", "WITH " + DAYS + " SELECT DISTINCT day FROM dy WHERE day > (SELECT max(day) FROM (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS r FROM dy) WHERE r = 8)")
def q_last_days(spark, d):
    return data.last_window(_days(spark, d), 7)


@query("q_first_gap", """WITH c AS (SELECT DISTINCT strftime(DATE '2024-01-01' + (s_suppkey * 3)::INT, '%Y-%m-%d') AS day FROM supplier), w AS (SELECT strftime(r, '%Y-%m-%d') AS day FROM range(DATE '2024-01-02', DATE '2024-12-31' + 1, INTERVAL 1 DAY) t(r))
SELECT min(day) AS first, max(day) AS last, count(*) AS days FROM w WHERE day NOT IN (SELECT day FROM c)""")
def q_first_gap(spark, d):
    captured = spark.read.parquet(f"{d}/supplier.parquet").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") * 3).cast("int")).cast("string").alias("day")).distinct()
    return data.first_gap(data.day_range(spark, "2024-01-02", "2024-12-31"), captured)


@query("q_run_files", META + """ SELECT event_id, dataset, CASE event_id % 6 WHEN 0 THEN '2026-01-0' || (event_id % 9 + 1) WHEN 1 THEN '2026-01-02' WHEN 3 THEN '2026-02-03' END AS day FROM c
WHERE venue = 'polymarket' AND dataset IN ('book', 'twap30s', 'klines') AND (asset IS NULL OR asset IN ('BTC', 'ETH')) AND (interval IS NULL OR interval = '15m')""")
def q_run_files(spark, d):
    meta = classified(spark, d).withColumn("day", paths.day_of(F.col("path")))
    return paths.for_run(meta, "polymarket", ["BTC", "ETH"], ["book", "twap30s", "klines"], ["15m"]).select("event_id", "dataset", "day")


@query("q_settlement_files", META + " SELECT event_id, dataset FROM c WHERE dataset NOT IN ('prices', 'twap30s', 'twap60s') OR dataset IN (SELECT CASE p_size % 2 WHEN 0 THEN 'twap60s' ELSE 'prices' END FROM part)")
def q_settlement_files(spark, d):
    markets = _part(spark, d).select(F.when(F.col("p_size") % 2 == 0, "twap60s").otherwise("prices").alias("stream"))
    return data.settlement_paths(classified(spark, d), markets).select("event_id", "dataset")


@query("q_market_days", """SELECT count(DISTINCT (p_partkey % 5, p_size // 4, p_partkey % 3)) AS market_days, count(*) FILTER (WHERE p_size % 4 = 0) AS prices, count(*) FILTER (WHERE p_size % 4 = 1) AS twap30s, count(*) FILTER (WHERE p_size % 4 = 2) AS twap60s FROM part""")
def q_market_days(spark, d):
    k, s = F.col("k"), F.col("p_size")
    stream = _pick(s % 4, "prices", "twap30s", "twap60s", None)
    return data.market_days(_part(spark, d).select((k % 5).alias("asset"), (s * 21_600_000).cast("bigint").alias("open_ms"), (k % 3).alias("interval"), stream.alias("stream")))
