"""Positions in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import staged


def with_position(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the position 1..n of each row in ``order``, which must end in a unique column.

    The sort is range-partitioned; each row keeps its slot (partition, place within it) in a written
    table, and the sizes of the partitions before give the offset. The offsets are as many as the
    sort had partitions.
    """
    slots = staged(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), name)
    part = F.shiftright("_slot", 33)
    place = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = slots.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    return (
        slots.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + place + 1).cast("long"))
        .drop("_slot", "_part", "_before")
    )
