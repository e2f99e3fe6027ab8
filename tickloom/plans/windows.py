"""Algebra of interval sets, such as capture windows: union, intersection and difference by where intervals begin and end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(sets: dict[str, DataFrame], keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, names): the pieces of each key's line on which the same of ``sets`` hold, with their names in order.

    Intervals are half open, [start, end); a null end is open, and so is a null start. Empty and turned intervals don't
    count. Pieces that no set holds are left out; neighbours always differ in their names. Intervals of one set may
    overlap. Times may be numbers, dates or timestamps.
    """
    names = sorted(sets)
    edges = None
    for n in names:
        rows = sets[n].select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s IS NULL OR _e IS NULL OR _s < _e")
        for at, step in (("_s", 1), ("_e", -1)):
            some = (rows if at == "_s" else rows.where("_e IS NOT NULL")).select(*keys, F.col(at).alias("_at"), *[F.lit(step if x == n else 0).alias(f"_{x}") for x in names])
            edges = some if edges is None else edges.unionByName(some)
    sums = edges.groupBy(*keys, "_at").agg(*[F.sum(f"_{x}").alias(f"_{x}") for x in names])
    along = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at"))  # a null start comes before all times
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    held = F.array_compact(F.array(*[F.when(F.sum(f"_{x}").over(upto) > 0, F.lit(x)) for x in names]))
    pieces = sums.select(*keys, "_at", held.alias("names"))
    before = F.lag("names").over(along)
    changes = pieces.withColumn("_new", before.isNull() | (before != F.col("names"))).where("_new")
    out = changes.select(*keys, F.col("_at").alias(start), F.lead("_at").over(along).alias(end), "names")
    return out.where(F.size("names") > 0)


def _merged(pieces: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Pieces that touch become one."""
    along = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start))
    touches = F.lag(end).over(along) == F.col(start)
    island = F.sum((~F.coalesce(touches, F.lit(False))).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.max_by(end, F.struct(F.col(end).isNull(), F.col(end)))
    return pieces.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min_by(start, F.struct(F.col(start).isNotNull(), F.col(start))).alias(start), ends.alias(end)).drop("_i")


def where_held(sets: dict[str, DataFrame], keys: Sequence[str], keep: Column, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end) of the pieces of ``overlay`` for which ``keep``, a condition on ``names``, holds; what touches is one."""
    return _merged(overlay(sets, keys, start, end).where(keep), keys, start, end)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    return where_held({"a": a, "b": b}, keys, F.lit(True), start, end)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    return where_held({"a": a, "b": b}, keys, F.size("names") == 2, start, end)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of ``a`` isn't in ``b``: of wanted and captured windows, the gaps."""
    return where_held({"a": a, "b": b}, keys, F.col("names") == F.array(F.lit("a")), start, end)


def usable_datasets(wanted: DataFrame, captured: DataFrame, degrading: Sequence[str]) -> DataFrame:
    """The (day, dataset) of ``wanted`` that a run reads: datasets that degrade only on days inside one of their capture windows.

    ``captured`` has dataset, first and last (days, a null last is open). Other datasets are read on every wanted day.
    """
    firm = wanted.where(~F.col("dataset").isin(*degrading))
    hit = wanted.where(F.col("dataset").isin(*degrading)).alias("w").join(captured.alias("c"), (F.col("w.dataset") == F.col("c.dataset")) & (F.col("w.day") >= F.col("c.first")) & (F.col("c.last").isNull() | (F.col("w.day") <= F.col("c.last"))), "left_semi")
    return firm.unionByName(hit)
