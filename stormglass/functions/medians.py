"""Exact medians of groups of any size, without sorting a column or holding a group.

A mergeable quantile sketch proposes cuts around the middle, a second pass counts the values between
them, and only the cell that holds the middle goes on: to another round while it is large, else its few
values are collected. The sketch only proposes; what is returned follows from exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import broadcast_list, staged

HELD = 65_536  # values of one group that may be collected: half a megabyte
ACCURACY = 10_000  # a cut is off by about one in so many ranks
MIDDLE = (0.45, 0.499, 0.5, 0.501, 0.55)
EVEN = tuple(i / 16 for i in range(1, 16))


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _column, _value): the columns by number, below each other."""
    cells = [
        F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_value"))
        for i, c in enumerate(columns)
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def _beside(rows: DataFrame, state: DataFrame, ids: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Rows with the state of their group; a null key is a group like any other."""
    state = staged(state.select(*[F.col(k).alias(f"_of_{k}") for k in ids], *carried), "medians")
    same = reduce(Column.__and__, [rows[k].eqNullSafe(state[f"_of_{k}"]) for k in ids])
    joined = rows.join(broadcast_list(state, state.count()), same)
    return joined.drop(*[f"_of_{k}" for k in ids])


def _inside() -> Column:
    return F.col("_value").between(F.col("_lo"), F.col("_hi"))


def _narrowed(rows: DataFrame, state: DataFrame, ids: Sequence[str], cuts: int) -> DataFrame:
    """State after counting the cells between the cuts: points at cuts and open ranges between them."""
    value = F.col("_value")

    def under(compare) -> Column:
        one = [F.coalesce(compare(F.get("_cuts", F.lit(i))).cast("int"), F.lit(0)) for i in range(cuts)]
        return reduce(Column.__add__, one)

    cell = under(lambda c: c < value) + under(lambda c: c <= value)
    counted = (
        _beside(rows, state, ids, ["_n", "_before", "_lo", "_hi", "_cuts"])
        .where(_inside())
        .groupBy(*ids, "_n", "_before", cell.alias("_cell"))
        .agg(F.count(value).alias("_size"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    )
    order = Window.partitionBy(*ids).orderBy("_cell")  # at most two cells a cut and one more
    upto = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_size"))

    def holder(position: Column) -> Column:
        mine = (F.col("_below") < position) & (position <= F.col("_upto"))
        return F.max(F.when(mine, F.struct("_cell", "_below", "_size", "_min", "_max")))

    found = placed.groupBy(*ids, "_n").agg(
        holder(F.floor((F.col("_n") + 1) / 2)).alias("_low"), holder(F.floor(F.col("_n") / 2) + 1).alias("_high")
    )
    apart = F.col("_low._cell") != F.col("_high._cell")
    settled = apart | (F.col("_low._min") == F.col("_low._max"))
    median = F.col("_low._max") * 0.5 + F.col("_high._min") * 0.5
    return found.select(
        *ids,
        "_n",
        F.col("_low._below").alias("_before"),
        F.col("_low._size").alias("_size"),
        F.col("_low._min").alias("_lo"),
        F.col("_low._max").alias("_hi"),
        F.when(settled, median).alias("_median"),
    )


def _collected(rows: DataFrame, state: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Medians of groups whose bracket holds few values."""
    held = (
        _beside(rows, state, ids, ["_n", "_before", "_lo", "_hi"])
        .where(_inside())
        .groupBy(*ids, "_n", "_before")
        .agg(F.array_sort(F.collect_list("_value")).alias("_values"))
    )

    def at(position: Column) -> Column:
        return F.get("_values", (position - F.col("_before") - 1).cast("int"))

    middle = at(F.floor((F.col("_n") + 1) / 2)) * 0.5 + at(F.floor(F.col("_n") / 2) + 1) * 0.5
    return held.select(*ids, middle.alias("_median"))


def medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], held: int = HELD
) -> DataFrame:
    """Interpolated median of each column per key, under the column's name; null where none has a value.

    Nulls do not count; NaN counts as greater than any number. Without keys there is one row, also for
    an empty table. ``df`` is read twice or more, so hand in a table or a staged frame. Groups of up to
    ``held`` values take two passes, larger ones two more per factor of several hundred.
    """
    ids = [*keys, "_column"]
    every = _long(df, keys, columns)
    rows = every.where(F.col("_value").isNotNull())
    value = F.col("_value")
    state = staged(
        every.groupBy(*ids).agg(
            F.count(value).alias("_n"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
            F.array_distinct(F.percentile_approx(value, list(MIDDLE), ACCURACY)).alias("_cuts"),
        ).withColumns({"_before": F.lit(0).cast("long"), "_size": F.col("_n")}),
        "medians",
    )
    parts = [state.where("_n = 0").select(*ids, F.lit(None).cast("double").alias("_median"))]
    few = [state.where((F.col("_n") > 0) & (F.col("_n") <= held))]
    large, cuts = state.where(F.col("_n") > held), len(MIDDLE)
    while not large.isEmpty():
        narrowed = staged(_narrowed(rows, large, ids, cuts), "medians")
        parts.append(narrowed.where("_median IS NOT NULL").select(*ids, "_median"))
        still = narrowed.where("_median IS NULL").drop("_median")
        few.append(still.where(F.col("_size") <= held))
        rest = still.where(F.col("_size") > held)
        if rest.isEmpty():
            break
        sketched = (
            _beside(rows, rest, ids, ["_n", "_before", "_size", "_lo", "_hi"])
            .where(_inside())
            .groupBy(*ids, "_n", "_before", "_size", "_lo", "_hi")
            .agg(F.array_distinct(F.percentile_approx(value, list(EVEN), ACCURACY)).alias("_cuts"))
        )
        large, cuts = staged(sketched, "medians"), len(EVEN)
    kept = [*ids, "_n", "_before", "_lo", "_hi"]
    parts.append(_collected(rows, reduce(DataFrame.unionByName, [f.select(*kept) for f in few]), ids))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_column") == i, F.col("_median"))).alias(c) for i, c in enumerate(columns)]
    )
