"""Operators on interval sets, total orders and result records, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import prices as X
from tickloom.operators import ordering, temporal
from tickloom.plans import windows
from tickloom.queries import EV, _ms, events, query
from tickloom.sources import records

# ---- total order ----------------------------------------------------------------------------


@query("q_session_position", "WITH " + EV + """, m AS (SELECT market_id, min(ts_ms) AS open_ms, max(ts_ms) AS close_ms, row_number() OVER (ORDER BY min(ts_ms), market_id) - 1 AS k FROM ev GROUP BY 1),
x AS (SELECT market_id, max(ts_ms) OVER (PARTITION BY market_id ORDER BY event_id) AS t, 1 AS phase, event_id AS s FROM ev
    UNION ALL SELECT market_id, open_ms, 0, 0 FROM m UNION ALL SELECT market_id, close_ms, 2, 0 FROM m UNION ALL SELECT market_id, close_ms, 3, 0 FROM m)
SELECT market_id, k, t, phase, s, row_number() OVER (ORDER BY t, phase, s, k) - 1 AS place FROM x JOIN m USING (market_id)""")
def q_session_position(spark, d):
    """Each row of a session with its place in the one order of all markets, and its market's place among them."""
    e = events(spark, d)
    markets = e.groupBy("market_id").agg(F.min("ts_ms").alias("open_ms"), F.max("ts_ms").alias("close_ms"))
    index = ordering.position(markets, ["open_ms", "market_id"], "k").select("market_id", "k")
    rows = temporal.session_order(markets, e, order=("event_id",)).join(index, "market_id")
    return ordering.position(rows, ["t", "phase", "s", "k"]).select("market_id", "k", "t", "phase", "s", "place")


# ---- interval sets --------------------------------------------------------------------------

#: Windows of customers from their orders, as long as their price says; urgent ones are wanted, others captured.
SETS = """WITH o AS (SELECT o_custkey AS k, epoch_ms(o_orderdate) AS s, CASE WHEN o_orderpriority LIKE '5%' AND o_totalprice > 300000 THEN NULL ELSE epoch_ms(o_orderdate) + floor(o_totalprice / 4000)::BIGINT * 86400000 END AS e, o_orderpriority < '3' AS wanted FROM orders),
i AS (SELECT * FROM o WHERE e IS NULL OR s < e), p AS (SELECT k, s AS t FROM i UNION SELECT k, e FROM i WHERE e IS NOT NULL),
g AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS n FROM p),
h AS (SELECT k, t, n, EXISTS (SELECT 1 FROM i WHERE i.k = g.k AND wanted AND s <= t AND (e IS NULL OR e > t)) AS a, EXISTS (SELECT 1 FROM i WHERE i.k = g.k AND NOT wanted AND s <= t AND (e IS NULL OR e > t)) AS b FROM g)
"""


def _sets_sql(what: str, on: str, same: str) -> str:
    """Neighbouring pieces of which ``same`` agrees are one."""
    return f"""SELECT '{what}' AS what, k, min(t) AS start, CASE WHEN bool_or(n IS NULL) THEN NULL ELSE max(n) END AS "end", {same} AS names FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) AS isle
    FROM (SELECT *, coalesce((lag(n) OVER w <> t OR lag({same}) OVER w <> {same})::INT, 1) AS new FROM h WHERE {on} WINDOW w AS (PARTITION BY k ORDER BY t))) GROUP BY k, isle, {same}"""


@query("q_window_algebra", SETS + " UNION ALL ".join([
    _sets_sql("overlay", "a OR b", "CASE WHEN a AND b THEN 'captured wanted' WHEN a THEN 'wanted' ELSE 'captured' END"), _sets_sql("union", "a OR b", "''"), _sets_sql("intersection", "a AND b", "''"), _sets_sql("difference", "a AND NOT b", "''")]))
def q_window_algebra(spark, d):
    """Pieces of wanted and captured windows by name, and their union, intersection and difference."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    start = _ms("o_orderdate")
    end = F.when(F.col("o_orderpriority").startswith("5") & (F.col("o_totalprice") > 300_000), None).otherwise(start + F.floor(F.col("o_totalprice") / 4000) * 86_400_000)
    rows = o.select(F.col("o_custkey").alias("k"), start.alias("start"), end.alias("end"), (F.col("o_orderpriority") < "3").alias("wanted"))
    wanted, captured = rows.where("wanted"), rows.where("NOT wanted")
    out = windows.overlay({"wanted": wanted, "captured": captured}, ["k"]).select(F.lit("overlay").alias("what"), "k", "start", "end", F.concat_ws(" ", "names").alias("names"))
    for what in ("union", "intersection", "difference"):
        out = out.unionByName(getattr(windows, what)(wanted, captured, ["k"]).select(F.lit(what).alias("what"), "k", "start", "end", F.lit("").alias("names")))
    return out


# ---- records --------------------------------------------------------------------------------

@query("q_trade_records", """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_quantity::BIGINT AS q, l_linenumber AS n, l_orderkey % 11 AS kind FROM lineitem),
r AS (SELECT id, kind, p, q, n, CASE WHEN kind IN (0, 1) THEN 'malformed' WHEN kind = 2 THEN 'market_id' WHEN kind = 3 THEN 'side' WHEN kind = 4 OR n = 7 THEN 'size' WHEN kind = 5 THEN 'pnl' WHEN kind = 6 THEN 'entry_px' END AS refused FROM l WHERE kind <> 7)
SELECT id, refused, CASE WHEN kind NOT IN (0, 1, 2) THEN 'm' || p END AS market_id, CASE WHEN kind NOT IN (0, 1, 4) AND n <> 7 THEN q::DOUBLE END AS size, CASE WHEN kind NOT IN (0, 1, 6) THEN p % 101 / 100.0::DOUBLE END AS entry_px,
    CASE WHEN kind > 1 AND kind <> 8 THEN n / 4.0::DOUBLE ELSE 0 END AS fees, CASE WHEN kind = 9 THEN 'settled' ELSE 'exit' END AS how, CASE WHEN kind = 9 THEN 'TIE' END AS outcome FROM r""")
def q_trade_records(spark, d):
    """Trade lines with faults of each kind: unreadable, of another type, out of range, missing; and what is left of them."""
    r = spark.read.parquet(f"{d}/lineitem.parquet")
    p, n, kind = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey") % 11
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    px = F.format_string("%d.%02d", F.floor(p % 101 / 100), p % 101 % 100)
    size = F.when(n == 7, F.lit("-1")).when(kind == 4, text(F.col("l_quantity").cast("bigint"))).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    fields = {"market_id": F.when(kind == 2, F.lit('""')).otherwise(text(F.concat(F.lit("m"), p.cast("string")))), "side": F.when(kind == 3, F.lit('"LEFT"')).otherwise(F.lit('"UP"')), "size": size, "pnl": F.when(kind == 5, F.lit("null")).otherwise(F.lit("-1.5e0")),
              "entry_px": F.when(kind == 6, F.lit("1.01")).otherwise(px), "exit_px": F.lit("null"), "fees": F.when(kind == 8, F.lit('"none"')).otherwise((n / 4).cast("string")),
              "how": F.when(kind == 9, F.lit('"settled"')).otherwise(F.lit("3")), "outcome": F.when(kind == 9, F.lit('"TIE"')).otherwise(F.lit('"WON"'))}
    line = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), F.lit("}"))
    line = F.when(kind == 0, F.concat(F.lit("["), line, F.lit("]"))).when(kind == 1, F.concat(line, F.lit(" {"))).when(kind == 7, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), line))
    rows = r.select((F.col("l_orderkey") * 10 + n).alias("id"), line.alias("value"))
    return records.judged_records(rows, records.TRADE).select("id", "refused", "market_id", "size", "entry_px", "fees", "how", "outcome")


# ---- orders ---------------------------------------------------------------------------------

@query("q_effective_order", """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 'LEFT' WHEN l_linenumber % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS side, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity::DOUBLE - 3 + (l_partkey % 4) / 8.0::DOUBLE END AS size,
    CASE WHEN l_partkey % 3 = 0 OR l_partkey % 31 = 0 THEN l_extendedprice::DOUBLE / 1000 END AS notional, CASE WHEN l_partkey % 7 <> 0 THEN (l_orderkey % 105) / 100.0::DOUBLE + (l_partkey % 2) * 0.001::DOUBLE END AS lim, l_returnflag = 'R' AS red, (l_suppkey % 9)::DOUBLE AS held FROM lineitem),
w AS (SELECT *, CASE WHEN notional IS NOT NULL THEN CASE WHEN lim > 0 THEN floor(notional / lim * 100 + 1e-9) / 100 END ELSE size END AS want FROM l),
s AS (SELECT *, CASE WHEN red THEN floor(least(want, held) * 100 + 1e-9) / 100 ELSE want END AS sent FROM w),
r AS (SELECT *, CASE WHEN side = 'LEFT' OR (size IS NULL) = (notional IS NULL) OR lim > 1 OR want IS NULL OR want <= 0 OR sent <= 0 THEN 'invalid' WHEN abs(sent * 100 - round_even(sent * 100, 0)) > 1e-6 THEN 'size_step' WHEN sent < 5 - 1e-9 THEN 'below_min_size'
    WHEN lim IS NOT NULL AND abs(lim * 100 - round_even(lim * 100, 0)) > 1e-7 THEN 'off_tick' END AS reason FROM s)
SELECT id, CASE WHEN reason IS NULL THEN floor(sent * 100 + 0.5)::BIGINT END AS cents, CASE WHEN reason IS NULL THEN lim END AS lim, reason FROM r""")
def q_effective_order(spark, d):
    """Orders of each fault: an unknown side, both or neither amount, limits out of range, sizes cut to what is held, off the grid or too small."""
    r = spark.read.parquet(f"{d}/lineitem.parquet")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    size = F.when(p % 3 != 0, F.col("l_quantity").cast("double") - 3 + (p % 4) / 8.0)
    notional = F.when((p % 3 == 0) | (p % 31 == 0), F.col("l_extendedprice").cast("double") / 1000)
    lim = F.when(p % 7 != 0, F.col("l_orderkey") % 105 / 100.0 + (p % 2) * 0.001)
    side = F.when(n == 7, "LEFT").when(n % 2 == 1, "UP").otherwise("DOWN")
    order = X.effective_order(side, size, notional, lim, F.col("l_returnflag") == "R", (F.col("l_suppkey") % 9).cast("double"), F.lit(5.0), F.lit(0.01))
    out = r.select((F.col("l_orderkey") * 10 + n).alias("id"), order.alias("o"))
    return out.select("id", F.floor(F.col("o.size") * 100 + 0.5).alias("cents"), F.col("o.limit").alias("lim"), "o.reason")
