"""Numbers over a whole table in a given order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut

_WITHIN = (1 << 33) - 1


def numbered_by(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... plus ``start`` in the order of the given columns, which should tell all rows apart.

    Rows are range-partitioned and sorted; a row's number is its place in the partition plus the rows of the
    partitions before, of which there is one count a partition. An empty table stays empty.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))
    number = F.col("__id").bitwiseAND(_WITHIN) + 1 + F.col("__b") + start
    return placed.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, number).drop("__id", "__p", "__b")
