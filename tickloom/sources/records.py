"""Result records from JSON lines under typed schemas, and what was refused, counted in the same pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.operators.ordering import position

NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
KINDS = {"number": ("double", NUMBER), "text": ("string", "^STRING$"), "flag": ("boolean", "^BOOLEAN$")}


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind, what makes its value right, and what stands for a wrong or missing one.

    A ``required`` field that isn't right makes the row invalid, one that is ``checked`` if it is there and isn't right.
    """

    name: str
    kind: str = "number"
    required: bool = False
    checked: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] | None = None
    default: object = None
    longest: int | None = None
    filled: bool = False  # text that must not be empty

    def read(self, record: Column) -> tuple[Column, Column]:
        """(value, whether the row may stay) from a variant."""
        type_, shape = KINDS[self.kind]
        found = F.try_variant_get(record, f"$.{self.name}", "variant")
        shown = F.schema_of_variant(found)
        value = F.when(shown.rlike(shape), F.try_variant_get(record, f"$.{self.name}", type_))
        right = value.isNotNull()
        if self.kind == "number":
            right = right & ~F.isnan(value) & (F.abs(value) < float("inf"))
        if self.low is not None:
            right = right & (value >= self.low)
        if self.high is not None:
            right = right & (value <= self.high)
        if self.choices is not None:
            right = right & value.isin(*self.choices)
        if self.filled:
            right = right & (value != "")
        right = F.coalesce(right, F.lit(False))
        kept = F.when(right, F.substring(value, 1, self.longest) if self.longest else value)
        kept = kept if self.default is None else F.coalesce(kept, F.lit(self.default).cast(type_))
        missing = found.isNull() | (shown == "VOID")
        stays = right if self.required else right | F.coalesce(missing, F.lit(True)) if self.checked else F.lit(True)
        return kept.cast(type_), stays


# The fields of result records, what they may hold, and what stands for those that are missing.
SIDES, OUTCOMES = ("UP", "DOWN"), ("UP", "DOWN", "TIE")
REJECT_REASONS = ("fok_unfilled", "quote_guard", "below_min_size", "size_step", "off_tick")
TRADE = (
    Field("market_id", "text", required=True, filled=True), Field("side", "text", required=True, choices=SIDES), Field("size", required=True, low=0), Field("pnl", required=True),
    Field("entry_px", checked=True, low=0, high=1), Field("exit_px", checked=True, low=0, high=1), Field("fees", default=0.0), Field("opened_ms"), Field("closed_ms"), Field("how", "text", default="exit"),
    Field("outcome", "text", choices=OUTCOMES))
FILL = (
    Field("market_id", "text", required=True, filled=True), Field("side", "text", required=True, choices=SIDES), Field("requested", required=True), Field("filled", required=True), Field("ts_ms"),
    Field("action", "text", choices=("reduce",), default="open"), Field("unfilled"), Field("avg_px"), Field("worst_px"), Field("quoted_px"), Field("levels_walked", default=0.0), Field("fee", default=0.0), Field("realised", default=0.0),
    Field("tag", "text", longest=64), Field("liquidity", "text", choices=("maker",), default="taker"), Field("order_id", "text", longest=16), Field("queue_ahead_at_join"), Field("queue_ahead_at_fill"), Field("time_in_queue_ms"),
    Field("markout_1s"), Field("markout_10s"), Field("markout_60s"), Field("markout_settle"), Field("reject_reason", "text", choices=REJECT_REASONS))
RECORD = (Field("key", "text", required=True), *[Field(c, required=True) for c in ("ts", "cash", "marked", "position_value")], Field("final", "flag", required=True))
SCHEMAS = {"trade": TRADE, "fill": FILL, "record": RECORD}
MALFORMED = "malformed"


def judged_records(lines: DataFrame, fields: tuple[Field, ...], column: str = "value") -> DataFrame:
    """``lines`` without ``column``, with the record's fields and ``refused``: malformed, the first field that is wrong, or null.

    Blank lines drop out. A line that is no JSON object is malformed. Values of another JSON type than the field's are
    wrong: a number in quotes is text.
    """
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    # the parser stops where a value ends; a field after it shows that nothing else came in between
    rows = lines.where(F.coalesce(text, F.lit("")) != "").withColumn("_all", F.try_parse_json(F.concat(F.lit('{"_v":'), text, F.lit(',"_end":0}'))))
    rows = rows.withColumn("_v", F.try_variant_get("_all", "$._v", "variant"))
    isobject = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT") & F.try_variant_get("_all", "$._end", "int").isNotNull(), F.lit(False))
    read = {f.name: f.read(F.col("_v")) for f in fields}
    reason = F.when(~isobject, MALFORMED)
    for name, (_, stays) in read.items():
        reason = reason.when(~stays, name)
    out = rows.withColumns({"_reason": reason, **{f"_f_{n}": v for n, (v, _) in read.items()}})  # what is left of a refused row may be partial
    return out.select(*[c for c in lines.columns if c != column], *[F.col(f"_f_{f.name}").alias(f.name) for f in fields], F.col("_reason").alias("refused"))


def fill_rows(rows: DataFrame) -> DataFrame:
    """Fills whose ``unfilled`` is missing get what was requested and not filled."""
    return rows.withColumn("unfilled", F.coalesce("unfilled", F.greatest(F.lit(0.0), F.col("requested") - F.col("filled"))))


def counted_records(lines: DataFrame, kind: str, column: str = "value", order: tuple[str, ...] = (), max_rows: int | None = None) -> tuple[DataFrame, Observation]:
    """(rows, counts): the valid records of ``kind``, and an observation of what was refused, filled by the first action on them.

    The counts are rows, malformed (no JSON object), one for each field by which a row was refused, and with ``max_rows``
    truncated, the valid rows past that many in ``order``, which are dropped. No second pass is made for them. A sort
    of the rows reads them twice and counts them twice: write them first.
    """
    fields = SCHEMAS[kind]
    judged = judged_records(lines, fields, column)
    names = [MALFORMED, *[f.name for f in fields if f.required or f.checked]]
    counts = [F.count_if(F.col("refused").isNull()).alias("rows"), *[F.count_if(F.col("refused") == n).alias(n) for n in names]]
    if max_rows is not None:
        judged = position(judged, [F.col("refused").isNotNull(), *order], "_place")
        past = F.col("refused").isNull() & (F.col("_place") >= max_rows)
        judged = judged.withColumn("refused", F.when(past, "truncated").otherwise(F.col("refused"))).drop("_place")
        counts.append(F.count_if(F.col("refused") == "truncated").alias("truncated"))
    seen = Observation(f"{kind} records")
    kept = judged.observe(seen, *counts).where("refused IS NULL").drop("refused")
    return (fill_rows(kept) if kind == "fill" else kept), seen


def sifted(rows: DataFrame, reasons: dict[str, Column], name: str = "rows") -> tuple[DataFrame, Observation]:
    """(kept, counts): ``rows`` for which no reason holds, and an observation of how many fell to each, by the first that holds.

    For rows that come late or lie outside a market's window, say: ``{"late": ..., "outside": ...}``.
    """
    first = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons.items()])
    marked = rows.withColumn("_refused", first)
    seen = Observation(name)
    counts = [F.count_if(F.col("_refused").isNull()).alias("kept"), *[F.count_if(F.col("_refused") == r).alias(r) for r in reasons]]
    return marked.observe(seen, *counts).where("_refused IS NULL").drop("_refused"), seen
