"""Report panels over trades, fills, markets and account samples.

Money is in whole micro-dollars (``pnl`` columns are BIGINT), so sums don't depend on how rows are
partitioned. Ratios are null where their denominator is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.prices import contract_value
from tickloom.sources.tables import written

from .ordering import position
from .running import running

DAY_MS = 86_400_000


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def day(ms: Column) -> Column:
    """The UTC day of an epoch time; ``unknown`` for null and 0."""
    return F.when(ms.isNull() | (ms == 0), "unknown").otherwise(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")).cast("string"))


def summary(trades: DataFrame) -> DataFrame:
    """One row: trades, net_pnl, win_rate, profit_factor, collateral, return_on_collateral, avg_hold_ms and markets of closed trades."""
    closed, win, loss = F.col("pnl").isNotNull(), F.col("pnl") > 0, F.col("pnl") < 0
    wins, losses = F.sum(F.when(win, F.col("pnl"))), F.abs(F.sum(F.when(loss, F.col("pnl"))))
    put = F.sum(F.when(closed, F.col("entry_ticks") * F.col("size") * 100))
    return trades.agg(
        F.count_if(closed).alias("trades"), F.countDistinct("market_id").alias("markets_traded"), F.sum("pnl").alias("net_pnl"), ratio(F.count_if(win), F.count_if(closed)).alias("win_rate"),
        ratio(wins, losses).alias("profit_factor"), put.alias("collateral"), ratio(F.sum("pnl"), put).alias("return_on_collateral"),
        F.floor(F.avg(F.when(closed, F.col("closed_ms") - F.col("opened_ms"))) + 0.5).cast("bigint").alias("avg_hold_ms"))


def daily(trades: DataFrame) -> DataFrame:
    return trades.where("pnl IS NOT NULL").groupBy(day(F.col("closed_ms")).alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))


def daily_ratios(trades: DataFrame) -> DataFrame:
    """Sharpe over the sample deviation, Sortino over the downside of all days, both times sqrt(365), and the days' counts and extremes."""
    d = daily(trades).withColumn("x", F.col("pnl").cast("double"))
    n, down = F.count(F.lit(1)), F.sqrt(F.sum(F.pow(F.least("x", F.lit(0.0)), F.lit(2.0))) / F.count(F.lit(1)))
    year = F.sqrt(F.lit(365.0))
    return d.agg(n.alias("trading_days"), F.count_if(F.col("pnl") > 0).alias("winning_days"), F.max("pnl").alias("best_day"), F.min("pnl").alias("worst_day"),
                 F.when(n >= 2, ratio(F.avg("x"), F.stddev_samp("x")) * year).alias("sharpe"), F.when(n >= 2, ratio(F.avg("x"), down) * year).alias("sortino"))


def equity(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Closed trades with equity: net pnl up to each, in closing order."""
    closed = trades.where("pnl IS NOT NULL").withColumn("_at", F.coalesce("closed_ms", F.lit(0)))
    return running(closed, F.floor(F.col("_at") / DAY_MS), ["_at", *order], F.col("pnl"), "equity").drop("_at")


def rounded(x: Column, digits: int) -> Column:
    """A report's figure: halves go away from zero; what is not finite is null."""
    scale = float(10**digits)
    return F.when(F.abs(x) < F.lit(float("inf")), F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


def return_over_drawdown(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: net pnl over the largest fall of equity, to two digits; null if equity never falls."""
    points = equity(trades, order)
    net = points.agg(F.sum("pnl")).scalar()
    fall = F.col("max_drawdown")
    return drawdown(points, "closed_ms", "equity", order).select(F.when(fall > 0, rounded(ratio(net, fall), 2)).alias("return_over_max_drawdown"))


def drawdown(points: DataFrame, ts: str, value: str, order: Sequence[str], block_ms: int = DAY_MS) -> DataFrame:
    """One row: the largest fall below the running peak, which starts at 0, and its share of that peak.

    Of equal falls the first counts; without a positive peak the share is null.
    """
    at = F.coalesce(F.col(ts), F.lit(0))
    peaks = running(points.withColumn("_at", at), F.floor(at / block_ms), ["_at", *order], F.greatest(F.col(value), F.lit(0).cast(points.schema[value].dataType)), "peak", "max")
    fall = peaks.withColumn("fall", F.col("peak") - F.col(value))
    worst = fall.agg(F.max("fall").alias("fall"), F.max_by(F.struct("peak", "fall"), F.struct(F.col("fall"), -F.col("_at"), *[-F.col(c) for c in order])).alias("w"))
    some = F.col("fall") > 0
    return worst.select(F.when(some, F.col("fall")).otherwise(0).alias("max_drawdown"), F.when(some & (F.col("w.peak") > 0), -ratio(F.col("fall"), F.col("w.peak"))).alias("max_drawdown_pct"))


def losing_run(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the most losses in a row in closing order; a trade of 0 ends a run.

    Runs are told apart by how many other trades came before, a running count by days.
    """
    closed = trades.where("pnl IS NOT NULL").withColumn("_at", F.coalesce("closed_ms", F.lit(0)))
    runs = running(closed, F.floor(F.col("_at") / DAY_MS), ["_at", *order], (F.col("pnl") >= 0).cast("bigint"), "_run")
    lengths = runs.where("pnl < 0").groupBy("_run").agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("worst_losing_run"))


def peak_capital(trades: DataFrame) -> DataFrame:
    """One row: the most collateral held at once. At one time, closings come before openings."""
    timed = trades.where("opened_ms IS NOT NULL AND closed_ms IS NOT NULL").withColumn("c", F.col("entry_ticks") * F.col("size") * 100)
    steps = timed.select(F.col("closed_ms").alias("t"), F.lit(0).alias("p"), (-F.col("c")).alias("d"))
    steps = steps.unionAll(timed.select(F.col("opened_ms").alias("t"), F.lit(1).alias("p"), F.col("c").alias("d"))).groupBy("t", "p").agg(F.sum("d").alias("d"))
    return running(steps, F.floor(F.col("t") / DAY_MS), ["t", "p"], F.col("d"), "held").agg(F.coalesce(F.max("held"), F.lit(0)).alias("peak_capital"))


def holding_ratio(trades: DataFrame) -> DataFrame:
    """One row: the time in which at least one trade was open, over the whole span.

    Before each opening stands the latest closing so far; a later opening begins a new stretch.
    """
    spans = trades.where("opened_ms IS NOT NULL AND closed_ms >= opened_ms").groupBy("opened_ms").agg(F.max("closed_ms").alias("closed_ms"))
    seen = running(spans, F.floor(F.col("opened_ms") / DAY_MS), ["opened_ms"], F.col("closed_ms"), "upto", "max")
    before = _lag(seen, F.floor(F.col("opened_ms") / DAY_MS), "opened_ms", "upto")
    covered = F.greatest(F.lit(0), F.col("closed_ms") - F.greatest("opened_ms", F.coalesce("_lag", "opened_ms")))
    return before.agg(ratio(F.sum(covered), F.max("closed_ms") - F.min("opened_ms")).alias("holding_ratio"), F.sum(covered).alias("held_ms"))


def _lag(df: DataFrame, block: Column, order: str, value: str) -> DataFrame:
    """``df`` with _lag: ``value`` of the row before in ``order``, across blocks."""
    rows = df.withColumn("_block", block)
    last = rows.groupBy("_block").agg(F.max_by(value, order).alias("_last")).select(F.col("_block").alias("_b"), F.lag("_last").over(Window.orderBy("_block")).alias("_before"))
    inside = rows.withColumn("_in", F.lag(value).over(Window.partitionBy("_block").orderBy(order)))
    return inside.join(last, F.col("_block") == F.col("_b")).withColumn("_lag", F.coalesce("_in", "_before")).drop("_block", "_b", "_before", "_in")


def edges(trades: DataFrame) -> DataFrame:
    """One row over settled trades: edge per contract (weighted, 0 if none), per trade (null if none), and the Brier score."""
    value = contract_value(F.col("side"), F.col("outcome"))
    entry = F.col("entry_ticks") / F.lit(10_000.0)
    e = value * 10_000 - F.col("entry_ticks")
    settled = trades.where((F.col("how") == "settled") & F.col("outcome").isNotNull() & F.col("entry_ticks").isNotNull())
    return settled.agg(F.coalesce(ratio(F.sum((e * F.col("size")).cast("bigint")), F.sum("size") * 10_000), F.lit(0.0)).alias("edge_per_contract"), ratio(F.sum(e.cast("bigint")), F.count(F.lit(1)) * 10_000).alias("edge_per_trade"),
                       ratio(F.sum((e * e).cast("bigint")), F.count(F.lit(1)) * F.lit(1e8)).alias("brier"), F.count(F.lit(1)).alias("settled"), F.count_if(entry > 0.5).alias("above_half"))


def calibration(trades: DataFrame, buckets: int = 10) -> DataFrame:
    """Settled trades by entry price in half-open buckets: trades, implied and realised mean, edge. A price of 1 is in none; empty ones are left out."""
    width = 10_000 // buckets
    settled = trades.where((F.col("how") == "settled") & F.col("outcome").isNotNull() & (F.col("entry_ticks") >= 0) & (F.col("entry_ticks") < 10_000))
    value = (contract_value(F.col("side"), F.col("outcome")) * 10_000).cast("bigint")
    out = settled.groupBy(F.floor(F.col("entry_ticks") / width).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("trades"), F.sum("entry_ticks").alias("entry"), F.sum(value).alias("value"))
    per = F.col("trades") * 10_000
    return out.select("bucket", "trades", ratio(F.col("entry"), per).alias("implied"), ratio(F.col("value"), per).alias("realized"), ratio((F.col("value") - F.col("entry")) * 100, per).alias("edge_cents"))


def baselines(markets: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """One row in ticks: what buying UP, DOWN or the dearer side (UP on ties) of every settled market with opening quotes gains.

    With ``trades`` each buys as many contracts as the trades have on average, else one.
    """
    known = markets.where("outcome IS NOT NULL AND up_ticks IS NOT NULL AND down_ticks IS NOT NULL")
    gain = lambda side, ticks: (contract_value(side, F.col("outcome")) * 10_000).cast("bigint") - ticks
    favourite = F.when(F.col("up_ticks") >= F.col("down_ticks"), "UP").otherwise("DOWN")
    out = known.agg(F.sum(gain(F.lit("UP"), F.col("up_ticks"))).alias("always_up"), F.sum(gain(F.lit("DOWN"), F.col("down_ticks"))).alias("always_down"), F.sum(gain(favourite, F.greatest("up_ticks", "down_ticks"))).alias("always_favourite"))
    if trades is None:
        return out
    size = trades.agg(F.coalesce(F.avg("size"), F.lit(0.0)).alias("_size"))
    return out.crossJoin(size).select(*[(F.col(c) * F.col("_size")).alias(c) for c in out.columns])  # one row each


def at_share(df: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = (), ranges: int = 64) -> DataFrame:
    """Values at place floor(share * n) of the sorted ones (0-based, the last if beyond), for each key.

    Equal values are counted first. Then the distinct values are cut at about even ranks into
    ``ranges`` ranges, whose counts tell in which range each place lies; only those are sorted, each
    by itself, so no task sorts all values of a key.
    """
    own = F.struct(*keys).alias("_key") if keys else F.struct(F.lit(0).alias("all")).alias("_key")
    counts = written(df.where(F.col(value).isNotNull()).groupBy(own, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "at-share")  # read three times
    cuts = counts.groupBy("_key").agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    rows = counts.join(cuts, "_key").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sizes = rows.groupBy("_key", "_range").agg(F.sum("_n").alias("_in"))
    so_far = Window.partitionBy("_key").orderBy("_range")
    sizes = sizes.withColumns({"_before": F.sum("_in").over(so_far) - F.col("_in"), "_all": F.sum("_in").over(Window.partitionBy("_key"))})
    place = lambda q: F.least(F.col("_all") - 1, F.floor(F.lit(q) * F.col("_all")))
    inside = lambda q: (F.col("_before") <= place(q)) & (place(q) < F.col("_before") + F.col("_in"))
    wanted = F.lit(False)
    for q in shares.values():
        wanted = wanted | inside(q)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_range").orderBy("_v"))
    ranked = rows.join(sizes.where(wanted), ["_key", "_range"]).withColumn("_upto", upto)
    picked = [F.min(F.when(inside(q) & (F.col("_upto") > place(q)), F.col("_v"))).alias(name) for name, q in shares.items()]
    return ranked.groupBy("_key").agg(*picked).select(*[F.col(f"_key.{k}") for k in keys], *shares) if keys else ranked.agg(*picked)


def slippage(fills: DataFrame) -> DataFrame:
    """One row over taker openings: how often they filled at the quote, walked, or got nothing; slippage in ticks at the median and the worst 1 %; its cost."""
    orders = fills.where((F.col("action") == "open") & ~F.col("liquidity").eqNullSafe("maker"))
    filled = F.col("filled") > 0
    slip = F.when(filled & F.col("quoted_ticks").isNotNull(), F.col("avg_ticks") - F.col("quoted_ticks"))
    n = F.count(F.lit(1))
    counts = orders.agg(n.alias("orders"), ratio(F.count_if(filled & (F.col("levels_walked") == 1)), n).alias("fills_at_quote"), ratio(F.count_if(filled & (F.col("levels_walked") > 1)), n).alias("partial_fills"),
                        ratio(F.count_if(~filled), n).alias("unfilled"), (-F.sum(slip * F.col("filled"))).alias("pnl_lost_ticks"), ratio(F.sum("unfilled_size"), F.sum("requested")).alias("unfilled_size_ratio"))
    return counts.crossJoin(at_share(orders.withColumn("slip", slip), "slip", {"median_slip": 0.5, "worst_slip": 0.99}))  # one row each


def activity(fills: DataFrame) -> DataFrame:
    got = fills.where("filled > 0")
    maker = F.col("liquidity") == "maker"
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("filled"))), F.lit(0).cast("bigint"))
    return got.agg(F.count(F.lit(1)).alias("fills"), F.sum("filled").alias("contracts"), F.sum(F.col("filled") * F.col("avg_ticks")).alias("value_ticks"), size(~F.coalesce(maker, F.lit(False))).alias("taker_contracts"), size(maker).alias("maker_contracts"))


def split(trades: DataFrame, *keys: str) -> DataFrame:
    """pnl, trades and win_rate by keys; null keys are ``unknown``."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys]
    return trades.where("pnl IS NOT NULL").groupBy(*named).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), ratio(F.count_if(F.col("pnl") > 0), F.count(F.lit(1))).alias("win_rate"))


def market_rows(markets: DataFrame, trades: DataFrame, key: str = "market_id") -> DataFrame:
    """Every market, entered or not, with its trades, contracts and pnl."""
    own = trades.where("pnl IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("contracts"), F.sum("pnl").alias("pnl"), F.min("opened_ms").alias("first_ms"))
    zero = F.lit(0).cast("bigint")
    out = markets.join(own, key, "left")
    return out.withColumns({"entered": F.col("trades").isNotNull(), "trades": F.coalesce("trades", zero), "contracts": F.coalesce("contracts", zero), "pnl": F.coalesce("pnl", zero)})


def split_by_market(trades: DataFrame, markets: DataFrame, key: str = "market_id") -> DataFrame:
    """(name, pnl, trades, place): trades by asset and interval of their market, the largest gains and losses first.

    ``name`` is both with a space between; a market without an asset, or that isn't known, is ``unknown``.
    """
    meta = markets.select(key, F.col("asset").cast("string").alias("_a"), F.col("interval").cast("string").alias("_i"))
    name = F.trim(F.concat(F.coalesce("_a", F.lit("unknown")), F.lit(" "), F.coalesce("_i", F.lit(""))))
    out = trades.where("pnl IS NOT NULL").join(meta, key, "left").groupBy(name.alias("name")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.abs("pnl").desc(), "name")))  # a row for each asset and interval


def by_settlement(rows: DataFrame, trades: DataFrame | None = None, stream: str = "stream", key: str = "market_id") -> DataFrame:
    """Markets by settlement stream, ``unknown`` without one: markets, entered, trades, pnl, and with ``trades`` the edge of those that settled.

    ``rows`` are those of ``market_rows``. Edges are per contract (weighted by size, 0 if no size) and per trade, null without a settled trade.
    """
    named = rows.withColumn(stream, F.coalesce(F.col(stream).cast("string"), F.lit("unknown")))
    out = named.groupBy(stream).agg(F.count(F.lit(1)).alias("markets"), F.count_if("entered").alias("entered"), F.sum("trades").alias("trades"), F.sum("pnl").alias("pnl"))
    if trades is None:
        return out
    gain = (contract_value(F.col("side"), F.col("t.outcome")) * 10_000).cast("bigint") - F.col("entry_ticks")
    settled = trades.where("pnl IS NOT NULL AND how = 'settled' AND outcome IS NOT NULL AND entry_ticks IS NOT NULL").alias("t").join(named.select(key, stream).alias("r"), key)
    edge = settled.groupBy(stream).agg(F.coalesce(ratio(F.sum(gain * F.col("size")), F.sum("size") * 10_000), F.lit(0.0)).alias("edge_per_contract"), ratio(F.sum(gain), F.count(F.lit(1)) * 10_000).alias("edge_per_trade"))
    return out.join(edge, stream, "left")


#: More values of a parameter than a grid is shown for.
SWEEP_LABELS = 1000


def sweep(cells: DataFrame, y: str, x: str, metric: str, xs: Sequence | None = None) -> DataFrame:
    """The metric on a grid of two parameters, one column x_<value> for each of ``xs``, or for each that occurs, in order; holes are null.

    Of several cells of one place the first in the order of the metric counts. More than SWEEP_LABELS values are refused.
    """
    if xs is None:
        xs = [r[0] for r in cells.where(F.col(x).isNotNull()).select(x).distinct().orderBy(x).limit(SWEEP_LABELS + 1).collect()]
        if len(xs) > SWEEP_LABELS:
            raise ValueError(f"{x} has more than {SWEEP_LABELS} values")
    return cells.groupBy(y).pivot(x, list(xs)).agg(F.min(metric)).select(y, *[F.col(f"`{v}`").alias(f"x_{v}") for v in xs])


def sweep_extent(cells: DataFrame, y: str, x: str, metric: str) -> DataFrame:
    """One row beside the grid: how many cells, the labels of both parameters in order, and the metric's extremes."""
    labels = lambda c: F.array_sort(F.collect_set(c))
    return cells.agg(F.count(F.lit(1)).alias("cells"), labels(x).alias("x_labels"), labels(y).alias("y_labels"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def downsample(points: DataFrame, index: str, value: str, n: int, most: int) -> DataFrame:
    """At most ``most`` of ``n`` points with a 0-based index: both ends and each bucket's lowest and highest, the first of equals."""
    if n <= most:
        return points
    buckets, inner = (most - 2) // 2, n - 2
    i = F.col(index) - 1
    b = F.floor((i * buckets + buckets - 1) / inner)
    # the bucket b holds floor(b * inner / buckets) <= i < floor((b + 1) * inner / buckets)
    b = F.when(F.floor((b + 1) * inner / buckets) <= i, b + 1).when(F.floor(b * inner / buckets) > i, b - 1).otherwise(b)
    ends = points.where(F.col(index).isin(0, n - 1))
    row = F.struct(*points.columns)
    picked = points.where((F.col(index) > 0) & (F.col(index) < n - 1)).groupBy(b.alias("_b")).agg(F.min_by(row, F.struct(F.col(value), F.col(index))).alias("low"), F.max_by(row, F.struct(F.col(value), -F.col(index))).alias("high"))
    return ends.unionByName(picked.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("p")).select("p.*"))


def account_series(samples: DataFrame, step_ms: int, key: str = "key") -> DataFrame:
    """(ts, value, position_value, open_positions) at each multiple of ``step_ms`` from the first sample on, and at the last.

    ``samples`` have ts, ord, cash, marked, position_value and final. The last time is that of the
    last final sample, or of the last sample if none is final; it is a point even off the grid.
    Each instance counts with its latest sample so far. A sample changes the sums by its
    difference to the instance's sample before, so the series is a running sum of changes.
    """
    w = Window.partitionBy(key).orderBy("ts", "ord")
    v = F.col("cash") + F.col("marked") + F.col("position_value")
    open_now = (F.col("position_value") > 0).cast("bigint")
    change = lambda x: x - F.coalesce(F.lag(x).over(w), F.lit(0).cast("bigint"))
    last = samples.agg(F.coalesce(F.max(F.when(F.col("final"), F.col("ts"))), F.max("ts"))).scalar()
    grid = F.least(F.ceil(F.col("ts") / step_ms) * step_ms, last)
    deltas = samples.select("ts", grid.alias("at"), change(v).alias("dv"), change(F.col("position_value")).alias("dp"), change(open_now).alias("do"))
    steps = deltas.where(F.col("ts") <= last).groupBy(F.col("at").alias("ts")).agg(F.sum("dv").alias("dv"), F.sum("dp").alias("dp"), F.sum("do").alias("do"))
    span = samples.agg((F.ceil(F.min("ts") / step_ms) * step_ms).alias("a"), F.coalesce(F.max(F.when(F.col("final"), F.col("ts"))), F.max("ts")).alias("b"))
    on_grid = F.when(F.col("a") <= F.col("b"), F.sequence("a", F.floor(F.col("b") / step_ms) * step_ms, F.lit(step_ms).cast("bigint")))
    points = span.where("b IS NOT NULL").select(F.explode(F.array_distinct(F.concat(F.coalesce(on_grid, F.array().cast("array<bigint>")), F.array("b")))).alias("ts"))
    out = points.join(steps, "ts", "left").select("ts", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("dv", "dp", "do")])
    block = F.floor(F.col("ts") / (step_ms * 1000))
    for c, name in (("dv", "value"), ("dp", "position_value"), ("do", "open_positions")):
        out = running(out, block, ["ts"], F.col(c), name)
    return out.select("ts", "value", "position_value", "open_positions")


def maker_fills(fills: DataFrame, markouts: Sequence[str], medians: Sequence[str] = ("ahead_at_join",)) -> DataFrame:
    """One row over maker fills: how many, their size, medians (place n / 2 of the sorted values), and of each markout its mean by size, fills and size.

    Only fills with a value count for a median or a markout; without any it is null.
    """
    made = fills.where((F.col("liquidity") == "maker") & (F.col("filled") > 0))
    zero = F.lit(0).cast("bigint")
    out = [F.count(F.lit(1)).alias("fills"), F.coalesce(F.sum("filled"), zero).alias("size")]
    for m in markouts:
        size = F.sum(F.when(F.col(m).isNotNull(), F.col("filled")))
        out += [ratio(F.sum(F.col(m) * F.col("filled")), size).alias(f"{m}_mean"), F.count(m).alias(f"{m}_fills"), F.coalesce(size, zero).alias(f"{m}_size")]
    panel = made.agg(*out)
    for c in medians:
        panel = panel.crossJoin(at_share(made, c, {f"median_{c}": 0.5}))  # one row each
    return panel


def orders_panel(orders: DataFrame) -> DataFrame:
    """(reason, orders, share): orders by why they were refused, null for those taken, and their share of all."""
    out = orders.groupBy("reason").agg(F.count(F.lit(1)).alias("orders"))
    return out.withColumn("share", F.col("orders") / F.sum("orders").over(Window.partitionBy()))  # a row for each reason


# The counters of resting orders that add up over markets.
MAKER_COUNTS = ["submitted", "rested", "orders_with_maker_fill", "fully_filled", "cancelled", "expired"]
MAKER_SIZES = ["rested_size", "maker_filled_size", "taker_on_arrival_size"]


def maker_rates(stats: DataFrame, *keys: str) -> DataFrame:
    """Resting orders over the markets of each of ``keys``: counters, and how much of what rested was filled, by size and by order.

    Negative and missing counters count as 0. Groups that submitted none are left out; rates without a base are null.
    """
    count = lambda c, t: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).cast(t).alias(c)
    out = stats.groupBy(*keys).agg(*[count(c, "bigint") for c in MAKER_COUNTS], *[count(c, "double") for c in MAKER_SIZES]).where("submitted > 0")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"fill_rate_size": rate("maker_filled_size", "rested_size"), "fill_rate_orders": rate("orders_with_maker_fill", "rested")})


def log_budget(lines: DataFrame, order: Sequence[str], text: str = "line", chars: int = 512, limit: int = 2 << 20) -> DataFrame:
    """``lines`` in ``order``, each cut to ``chars`` characters, as long as those before it took fewer than ``limit`` bytes of UTF-8, line ends included.

    Running sums are made within ranges of the order and the ranges' totals are added, so no task holds the log.
    """
    cut = position(lines.withColumn(text, F.substring(text, 1, chars)), order, "_place")
    spent = running(cut, F.floor(F.col("_place") / 100_000), ["_place"], F.octet_length(text).cast("bigint") + 1, "_spent")
    return spent.where(F.col("_spent") - F.octet_length(text) - 1 < limit).drop("_place", "_spent")


def fee_models(markets: DataFrame) -> DataFrame:
    return markets.groupBy(F.coalesce(F.col("fee.model"), F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("markets"))


def crosscheck(checks: DataFrame, claimed: str, actual: str) -> DataFrame:
    hit = F.col(claimed).eqNullSafe(F.col(actual))
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.count_if(hit).alias("matches"), F.count_if(~hit).alias("mismatches"))


def marked_extras(trades: DataFrame) -> DataFrame:
    """One row: pnl realised and merely marked, markets still marked, legs marked at 0, the oldest mark."""
    marked = F.col("how") == "marked"
    zero = F.lit(0).cast("bigint")
    return trades.agg(F.coalesce(F.sum(F.when(~marked, F.col("pnl"))), zero).alias("realised_pnl"), F.coalesce(F.sum(F.when(marked, F.col("pnl"))), zero).alias("marked_pnl"),
                      F.countDistinct(F.when(marked, F.col("market_id"))).alias("marked_markets"), F.count_if(marked & (F.col("exit_ticks") == 0)).alias("zero_legs"), F.max(F.when(marked, F.col("mark_age_ms"))).alias("max_mark_age_ms"))


def on_resolved(trades: DataFrame, markets: DataFrame, key: str = "market_id") -> DataFrame:
    """One row: how many markets have an outcome, and the trades and pnl in those alone, to compare with baselines."""
    resolved = markets.where("outcome IS NOT NULL").select(key).distinct()
    own = trades.join(resolved, key, "left_semi").agg(F.count(F.lit(1)).alias("trades"), F.coalesce(F.sum("pnl"), F.lit(0)).alias("net_pnl"))
    return resolved.agg(F.count(F.lit(1)).alias("markets")).crossJoin(own)  # one row each


def over_budget(costs: DataFrame, key: str, order: str, cost: str, limit: float, size: int = 2000) -> DataFrame:
    """(key, at): where the mean of the last ``size`` costs, once there are so many, first exceeds ``limit``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)
    seen = costs.withColumns({"_mean": F.avg(cost).over(w), "_n": F.count(cost).over(w)})
    return seen.where((F.col("_n") == size) & (F.col("_mean") > limit)).groupBy(key).agg(F.min(order).alias("at"))
