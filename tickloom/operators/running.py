"""Running totals and maxima over a whole ordered table without one task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, block: Column, order: Sequence[str], value: Column, out: str, how: str = "sum") -> DataFrame:
    """``df`` with ``out``: the sum (or max) of ``value`` over all rows up to this one.

    Rows are ordered by ``block``, an expression that never falls along ``order`` (a day, say),
    then by ``order``. Each block is one window; only the blocks' totals meet in one task.
    """
    fold = F.sum if how == "sum" else F.max
    rows = df.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_block").agg(fold(value).alias("_total"))
    before = fold("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("_block").alias("_b"), before.alias("_before"))
    within = rows.withColumn("_in", fold(value).over(inside))
    joined = within.join(totals, within["_block"].eqNullSafe(totals["_b"]))
    upto = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in") if how == "sum" else F.greatest("_before", "_in")
    return joined.withColumn(out, upto).drop("_block", "_b", "_before", "_in")
