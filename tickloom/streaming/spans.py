"""Points of a stream joined with the spans of another that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_within(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, keys: Sequence[str], longest: str, late: str = "1 minute") -> DataFrame:
    """Points with the closed spans of the same ``keys`` that hold them, both sides streams of event time (timestamps).

    Rows of either side may come up to ``late`` behind the latest time seen on their side (of spans: their end), and before or
    after what they meet. No span is longer than ``longest``; one that is fails the query. A span's state is dropped when
    the points' time has passed its end, a point's when no span that begins so early can still come. So state
    is bounded by the spans that are open and the points of their time.
    """
    limit = F.expr(f"interval {longest}")
    fits = F.when(F.col(end) - limit <= F.col(start), F.col(end)).otherwise(F.raise_error(F.lit(f"a span is longer than {longest}")).cast("timestamp"))
    p, s = points.withWatermark(ts, late).alias("p"), spans.withColumn(end, fits).withWatermark(end, late).alias("s")
    on = (F.col(f"p.{ts}") >= F.col(f"s.{start}")) & (F.col(f"p.{ts}") <= F.col(f"s.{end}")) & (F.col(f"p.{ts}") >= F.col(f"s.{end}") - limit)
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return p.join(s, on).select("p.*", *[f"s.{c}" for c in spans.columns if c not in keys])
