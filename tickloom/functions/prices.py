"""Expressions on prices, fees and outcomes. Prices become whole ticks of 1e-4 dollars, which add up exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS, EPS = 10_000, 1e-9


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves upward, for negatives too."""
    low = F.floor(x)
    return (low + F.when(x - low >= 0.5, 1).otherwise(0)).cast("bigint")


def to_ticks(px: Column) -> Column:
    return round_half_up(px * TICKS).cast("int")


def from_ticks(ticks: Column) -> Column:
    return ticks / F.lit(float(TICKS))


def mirror_ticks(ticks: Column) -> Column:
    """The other token's price: what one dollar leaves."""
    return F.lit(TICKS) - ticks


def mirror(levels: Column) -> Column:
    """A ladder of one token as the opposite ladder of the other."""
    return F.transform(levels, lambda x: F.struct(from_ticks(mirror_ticks(to_ticks(x.px))).alias("px"), x["size"].alias("size")))


def contract_value(side: Column, outcome: Column) -> Column:
    """What a contract pays: 1, 0, a half for a tie, null while unsettled."""
    return F.when(outcome == "TIE", 0.5).when(outcome.isNotNull(), F.when(side == outcome, 1.0).otherwise(0.0))


def round_fee(x: Column) -> Column:
    return F.floor(x * 1e5 + 0.5) / F.lit(1e5)


def floor_cents(x: Column) -> Column:
    return F.floor(x * 100 + 1e-9) / F.lit(100.0)


def curve_fee(size: Column, px: Column, rate: Column) -> Column:
    """The fee of one fill on the curve rate * p * (1 - p), rounded; unknown rates cost nothing."""
    return F.coalesce(round_fee(size * rate * px * (1 - px)), F.lit(0.0))


def flat_fee(notional: Column, bps: Column) -> Column:
    return notional * bps / F.lit(10_000.0)


def outcome_of_pair(up: Column, down: Column) -> Column:
    """The outcome that a pair of payouts stands for."""
    return F.when((up == 1) & (down == 0), "UP").when((up == 0) & (down == 1), "DOWN").when((up == 0.5) & (down == 0.5), "TIE")


def outcome_of_prices(start: Column, end: Column) -> Column:
    """The outcome of a price that moved from ``start`` to ``end``."""
    return F.when(end > start, "UP").when(end < start, "DOWN").when(end == start, "TIE")


def resolved_outcome(resolved: Column, prices: Column) -> Column:
    """The outcome of a market record: only exact prices of a resolved market count."""
    return F.when(resolved, F.when((F.get(prices, 0) == "1") & (F.get(prices, 1) == "0"), "UP").when((F.get(prices, 0) == "0") & (F.get(prices, 1) == "1"), "DOWN"))


def pair_outcome(prices: Column) -> Column:
    """The outcome of a listing's two final prices: UP for 1 and 0, DOWN for 0 and 1, TIE for a half each; else null."""
    at = lambda i: F.trim(F.get(prices, i)).try_cast("double")
    known = (F.size(prices) == 2) & F.forall(prices, lambda x: F.trim(x).rlike(r"^(0|1|0\.5)$"))
    return F.when(known, F.when((at(0) == 1) & (at(1) == 0), "UP").when((at(0) == 0) & (at(1) == 1), "DOWN").when((at(0) == 0.5) & (at(1) == 0.5), "TIE"))


def fee_model(enabled: Column, rate: Column, exponent: Column) -> Column:
    """struct(model, rate): none, rate (exponent 1 alone), or unknown."""
    model = F.when(enabled == F.lit(False), "none").when(enabled & (exponent == 1) & rate.isNotNull(), "rate").otherwise("unknown")
    return F.struct(model.alias("model"), F.when(model == "rate", rate).alias("rate"))


def interval_label(seconds: Column) -> Column:
    """5m, 1h, 1d: the largest unit that divides the seconds."""
    out = F.when(seconds.isNull() | (seconds <= 0), F.lit(None).cast("string"))
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        out = out.when(seconds % size == 0, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit)))
    return out.otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def side_of_token(token: Column, tokens: Column) -> Column:
    """UP or DOWN by the token's place in a pair of two different tokens."""
    at = F.array_position(tokens, token)
    return F.when((F.size(tokens) == 2) & (F.size(F.array_distinct(tokens)) == 2), F.when(at == 1, "UP").when(at == 2, "DOWN"))


def side_of_label(side: Column, labels: Column) -> Column:
    """UP or DOWN by its name, or by a market's pair of labels, whatever case and spaces; null for anything else."""
    plain = lambda x: F.lower(F.trim(x))
    by_label = F.when(plain(side) == plain(F.get(labels, 0)), "UP").when(plain(side) == plain(F.get(labels, 1)), "DOWN")
    return F.when(side.isin("UP", "DOWN"), side).otherwise(by_label)


def settlement_stream(has_config: Column, lookback: Column) -> Column:
    """Which price stream settles a market: the plain prices, or their average over 30 or 60 s."""
    return F.when(has_config, F.when(lookback.isNull() | (lookback == 0), "prices").when(lookback == 30, "twap30s").when(lookback == 60, "twap60s"))


def market_rules_ok(tick: Column, least: Column) -> Column:
    """Whether a market's tick lies on the grid and its least size is positive."""
    scaled = tick * TICKS
    return F.coalesce((tick > 0) & (F.abs(F.rint(scaled) - scaled) <= 1e-6) & (least > 0), F.lit(False))


def order_reason(side: Column, size: Column, notional: Column, limit: Column, least: Column, step: Column, tick: Column) -> Column:
    """Why an order is not taken, in the order in which the rules apply; null if it is."""
    want = F.coalesce(size, F.when(limit > 0, F.floor(notional / limit)))
    off = lambda x, unit: F.abs(F.rint(x / unit) - x / unit) > 1e-6
    return (F.when(~side.isin("UP", "DOWN") | side.isNull(), "side").when(size.isNull() == notional.isNull(), "size_or_notional")
            .when(limit.isNull() | ~limit.between(0, 1), "limit").when(notional.isNotNull() & (limit <= 0), "notional_needs_limit").when(~(want > 0), "size")
            .when(off(want, step), "size_step").when(want < least, "below_min_size").when(off(limit, tick), "off_tick"))


def queue_probability(ahead: Column, behind: Column, model: str = "power", power: float = 2.0) -> Column:
    """The chance that a cancelled contract stood ahead of an order: one of power, power2, power3, log, log2.

    ``power``: f(behind) / (f(ahead) + f(behind)) with f(x) = x^power; ``power2`` and ``power3`` weigh
    the place in the whole queue; the ``log`` models put ln(1 + x) for f. Null unless there is a
    queue ahead and both amounts are readable.
    """
    total = ahead + behind
    if model == "power":
        f = lambda x: F.pow(x, F.lit(power))
        out = f(behind) / (f(behind) + f(ahead))
    elif model == "power2":
        out = F.pow(behind, F.lit(power)) / F.pow(total, F.lit(power))
    elif model == "power3":
        out = 1 - F.pow(ahead / total, F.lit(power))
    elif model == "log":
        out = F.log1p(behind) / (F.log1p(behind) + F.log1p(ahead))
    elif model == "log2":
        out = F.log1p(behind) / F.log1p(total)
    else:
        raise ValueError(f"unknown queue model {model}")
    return F.when((ahead > 0) & (ahead <= 1e15) & (behind >= 0) & (behind <= 1e15), F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


def seeded_uniform(seed: Column, draw: Column) -> Column:
    """The ``draw``-th number (from 1) of the splitmix32 stream of a seed, in [0, 1): each row by itself, without state."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    low = lambda x: x.bitwiseAND(mask)
    shift = lambda x, n: F.shiftrightunsigned(x, n)

    def times(x: Column, k: int) -> Column:  # modulo 2^32, in two halves so that no product leaves 63 bits
        high = low(shift(x, 16) * k)
        return low(F.shiftleft(high, 16) + low(x.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * k))

    s = low(low(seed.cast("bigint")) + low(draw.cast("bigint") * 0x9E3779B9))
    z = times(s.bitwiseXOR(shift(s, 16)), 0x21F0AAAD)
    z = times(z.bitwiseXOR(shift(z, 15)), 0x735A2D97)
    return low(z.bitwiseXOR(shift(z, 15))) / F.lit(4294967296.0)


def quote_guard(up_ask: Column, down_ask: Column, set_ms: Sequence[Column], now: Column, ask_sum: tuple[float, float] | None = None, max_age_ms: int | None = None, reduce_only: Column | None = None, include_exits: bool = False) -> Column:
    """``quote_guard`` where the quotes refuse a taker order, else null.

    With ``ask_sum`` both asks must be there and add up to a sum in that range; with ``max_age_ms`` each of the times
    ``set_ms`` of the best prices must be there and that recent. Orders that reduce pass, unless ``include_exits``.
    """
    bad = F.lit(False)
    if ask_sum is not None:
        bad = bad | ~F.coalesce((up_ask + down_ask).between(ask_sum[0] - EPS, ask_sum[1] + EPS), F.lit(False))
    if max_age_ms is not None:
        for t in set_ms:
            bad = bad | ~F.coalesce(now - t <= max_age_ms, F.lit(False))
    if reduce_only is not None and not include_exits:
        bad = bad & ~reduce_only
    return F.when(bad, "quote_guard")


def floor_cents(x: Column) -> Column:
    return F.floor(x * 100 + 1e-9) / 100


def effective_order(side: Column, size: Column, notional: Column, limit: Column, reduce_only: Column, held: Column, least: Column | None = None, tick: Column | None = None) -> Column:
    """(size, limit, reason) of an order as it would be sent: size is null and reason set if it isn't taken.

    Just one of ``size`` and ``notional`` is given; a notional buys whole contracts at the limit, or with market rules
    (``least`` size and ``tick``) hundredths of one. An order that only reduces is cut to what is ``held``. With rules the
    size that would be sent must lie on the grid of hundredths and reach ``least``, and the limit lie on the tick. Orders
    against these rules are refused with their reason; ``invalid`` stands for all that isn't an order.
    """
    rules = least is not None and tick is not None
    cut = floor_cents if rules else F.floor
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    bought = F.when(yes(real(notional) & (notional > 0) & (limit > 0) & (notional / limit < 1e300)), cut(notional / limit).cast("double"))
    want = F.when(notional.isNotNull(), bought).otherwise(F.when(yes(real(size)), size.cast("double")))
    least_open = F.lit(EPS)
    sent = F.when(reduce_only, (floor_cents if rules else lambda c: c)(F.least(want, F.coalesce(held, F.lit(0.0))))).otherwise(want)
    fine = yes(side.isin("UP", "DOWN")) & (size.isNull() != notional.isNull()) & (limit.isNull() | yes(real(limit) & limit.between(0, 1))) & yes(want > 0) & yes(F.when(reduce_only, sent > least_open).otherwise(sent > 0))
    reason = F.when(~fine, "invalid")
    if rules:
        ticks, unit = to_ticks(limit), to_ticks(tick)
        reason = (reason.when(F.abs(sent * 100 - F.rint(sent * 100)) > 1e-6, "size_step").when(sent < least - EPS, "below_min_size")
                  .when(limit.isNotNull() & ((ticks % unit != 0) | (F.abs(from_ticks(ticks) - limit) > EPS)), "off_tick"))
    return F.struct(F.when(reason.isNull(), sent).alias("size"), F.when(reason.isNull(), limit).alias("limit"), reason.alias("reason"))
