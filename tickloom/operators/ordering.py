"""Places in one total order over a whole table, without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.tables import written


def position(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in the order of ``order``, which should tell all rows apart.

    Rows are dealt by ranges of the order and each range is numbered by itself; the counts of the ranges before it, one
    number each, make places of the whole. The dealt rows are a table in the shared folder, so that a range has the same
    rows whenever it is read. Rows that ``order`` doesn't tell apart get different places, in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # an id is its partition's number and, in the lower 33 bits, the row's number in the partition
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "position")
    dealt = dealt.withColumns({"_range": F.shiftright("_id", 33), "_own": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))  # a row for each range
    return dealt.join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before", "_id")
