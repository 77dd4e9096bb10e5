"""Interval join on instants: every point with every closed interval that holds it, as an equality join.

The axis is halved again and again; an interval falls into at most 14 aligned pieces, however long it is,
and a point looks only for the pieces above it on the levels in use. Laying intervals out as days, as
``events.in_events`` does for a short list, would grow with their length and cannot tell instants apart.

Who wants totals per interval and not the pairs takes ``interval_totals``: the pairs grow with the square of
the rows, the totals do not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass.functions.staging import broadcast_list, staged

DEPTH = 6  # levels below an interval's length: its ends are rounded outwards to one part in 32 and checked
LOW = 8  # cells of up to 2 ** LOW points meet by a shuffle; the larger ones are few
START, POINT, END = 0, 1, 2  # order at one instant: an interval is closed


def ticks(df: DataFrame, name: str) -> Column:
    """A date, timestamp or whole number as a long that grows with it, whatever the session's time zone."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    raise TypeError(f"{name}: no interval join on {kind.simpleString()}")


def pieces(intervals: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """Intervals once per aligned piece ``_cell`` of size 2 ** ``_level``, counted from ``low``.

    Ends are cut to [low, high]; a missing end is open. The pieces of an interval do not overlap.
    """
    first = F.greatest(F.coalesce(ticks(intervals, start), F.lit(low)), F.lit(low)) - low
    last = F.least(F.coalesce(ticks(intervals, end), F.lit(high)), F.lit(high)) - low
    cut = intervals.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    leaf = F.greatest(F.length(F.bin(F.col("_last") - F.col("_first"))) - DEPTH, F.lit(0)).cast("int")
    cut = cut.withColumn("_leaf", leaf)
    cut = cut.withColumns(
        {"_from": F.expr("shiftright(_first, _leaf)"), "_to": F.expr("shiftright(_last, _leaf)") + 1}
    )
    found = []
    for k in range(DEPTH + 1):
        a, b = F.shiftright(F.col("_from") + (2**k - 1), k), F.shiftright("_to", k)
        level = (F.col("_leaf") + k).cast("int").alias("_level")
        found.append(F.when((a < b) & (a % 2 == 1), F.struct(level, a.alias("_cell"))))
        found.append(F.when((a < b) & (b % 2 == 1), F.struct(level, (b - 1).alias("_cell"))))
    whole = F.filter(F.array(*found), lambda piece: piece.isNotNull())
    return cut.select(*intervals.columns, F.inline(whole))


def _check_types(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> None:
    if len({type(df.schema[c].dataType) for df, c in ((points, at), (intervals, start), (intervals, end))}) > 1:
        raise TypeError("instants and ends of intervals must have one type")


def interval_join(
    points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, on: Sequence[str] = ()
) -> DataFrame:
    """Columns of both sides, one row per point and interval with start <= at <= end and equal ``on``.

    A null start or end is open; a null instant, or an interval that ends before it starts, matches
    nothing; repeated rows match each for itself. The three columns have one type: date, timestamp or
    whole number. ``points`` is read twice and ``intervals`` once. Column names other than ``on`` must
    differ. Pieces are broadcast only behind a check of their number; else both sides are shuffled by
    (on, level, piece).
    """
    _check_types(points, intervals, at, start, end)
    clashing = (set(points.columns) & set(intervals.columns)) - set(on)
    if clashing:
        raise ValueError(f"columns on both sides: {sorted(clashing)}")
    tick = ticks(points, at)
    low, high = points.agg(F.min(tick), F.max(tick)).first()
    low, high = low or 0, high or 0
    if high - low >= 2**62:
        raise ValueError("instants too far apart")
    cut = staged(pieces(intervals, start, end, low, high), "pieces")
    levels = [r["_level"] for r in cut.select("_level").distinct().collect()]  # at most 64
    spread = points.where(F.col(at).isNotNull()).withColumns(
        {"_tick": tick - low, "_level": F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))}
    )
    located = spread.withColumn("_cell", F.expr("shiftright(_tick, _level)")).drop("_tick")
    joined = located.join(broadcast_list(cut, cut.count()), [*on, "_level", "_cell"])
    inside = (F.col(start).isNull() | (F.col(at) >= F.col(start))) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    kept = [*points.columns, *[c for c in intervals.columns if c not in on]]
    return joined.where(inside).select(*kept)


def _counted(instants: DataFrame, order: Sequence[str], kind: str) -> DataFrame:
    """Rows with ``_upto``, the number of points up to the row in ``order``, itself included."""
    slots = staged(instants.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "instants")
    parts = slots.withColumn("_part", F.shiftright("_slot", 33))
    point = F.count_if(F.col(kind) == POINT)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(point.alias("_points")).select(
        "_part", F.coalesce(F.sum("_points").over(earlier), F.lit(0)).alias("_before")
    )
    running = point.over(Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("_within", running).join(F.broadcast(offsets), "_part")
    return placed.withColumn("_upto", F.col("_before") + F.col("_within")).drop("_slot", "_part", "_within", "_before")


def _cells(base: DataFrame, levels: Sequence[int], merged: Sequence[Column]) -> DataFrame:
    """Totals of the aligned cells that hold 2 ** level of the cells ``_cell`` of ``base``."""
    spread = base.withColumn("_up", F.explode(F.array(*map(F.lit, levels))))
    return spread.groupBy("_up", F.expr("shiftright(_cell, _up)").alias("_cell")).agg(*merged)


def interval_totals(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    sums: Mapping[str, Column],
    maxima: Mapping[str, Column],
) -> DataFrame:
    """Intervals that hold a point, with ``sums`` and ``maxima`` over their points, in linear space.

    The same rows as the join grouped by interval, but no pair is laid out. Points are numbered in the order
    of time, so that an interval is a range of numbers. It is cut where its ends part in the binary tree of
    numbers; each half consists of whole cells of the tree, one per binary digit of its length at most.
    Equal halves are added up once. Nothing is subtracted, so no digits are lost. A null start or end is open,
    a null instant or a backward interval matches nothing, repeated rows count each for itself.
    """
    _check_types(points, intervals, at, start, end)
    numbered = staged(intervals.withColumn("_row", F.monotonically_increasing_id()), "intervals")
    inputs = {**sums, **maxima}
    merged = [*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]]
    lowest, highest = F.lit(-(2**63)), F.lit(2**63 - 1)
    ends = [
        F.struct(F.lit(START).alias("_kind"), F.coalesce(ticks(numbered, start), lowest).alias("_tick")),
        F.struct(F.lit(END).alias("_kind"), F.coalesce(ticks(numbered, end), highest).alias("_tick")),
    ]
    marks = numbered.select("_row", F.inline(F.array(*ends)))
    rows = points.where(F.col(at).isNotNull()).select(
        F.lit(POINT).alias("_kind"), ticks(points, at).alias("_tick"), *[c.alias(n) for n, c in inputs.items()]
    )
    everything = rows.unionByName(marks, allowMissingColumns=True)
    # Equal instants are told apart, so that a hot one is no single task's.
    spread = everything.withColumn("_place", F.monotonically_increasing_id())
    placed = staged(_counted(spread, ["_tick", "_kind", "_place"], "_kind").drop("_tick", "_place"), "placed")

    leaves = placed.where(F.col("_kind") == POINT).select((F.col("_upto") - 1).alias("_cell"), *inputs)
    low = staged(_cells(leaves, range(LOW + 1), merged).withColumnRenamed("_up", "_level"), "low-cells")
    number = leaves.count()
    top = low.where(F.col("_level") == LOW).drop("_level")
    levels = range(1, max(number.bit_length() - LOW, 1) + 1)
    high = _cells(top, levels, merged).select((F.col("_up") + LOW).alias("_level"), "_cell", *inputs)

    first = F.max(F.when(F.col("_kind") == START, F.col("_upto"))).alias("_first")
    last = F.max(F.when(F.col("_kind") == END, F.col("_upto") - 1)).alias("_last")
    ranges = placed.where(F.col("_kind") != POINT).groupBy("_row").agg(first, last).where("_first <= _last")
    cut = ranges.withColumn("_bit", F.length(F.bin(F.col("_first").bitwiseXOR(F.col("_last")))) - 1)
    cut = cut.withColumn("_mid", F.expr("IF(_first = _last, _first, shiftleft(shiftright(_last, _bit), _bit))"))
    sizes = F.array(F.col("_first") - F.col("_mid"), F.col("_last") + 1 - F.col("_mid"))  # left halves are negative
    halves = staged(cut.select("_row", "_mid", F.explode(sizes).alias("_size")).where("_size != 0"), "halves")

    digits = F.filter(F.sequence(F.lit(0), F.lit(number.bit_length())), lambda j: F.call_function("getbit", F.abs("_size"), j) == 1)
    pieces_of = halves.select("_mid", "_size").distinct().select("_mid", "_size", F.explode(digits).alias("_level"))
    left = "shiftright(_mid, _level) - shiftright(-_size, _level)"
    right = "shiftright(_mid, _level) + shiftleft(shiftright(_size, _level + 1), 1)"
    found = staged(pieces_of.withColumn("_cell", F.expr(f"IF(_size < 0, {left}, {right})")), "halves-in-cells")
    key = ["_level", "_cell"]
    met = found.where(F.col("_level") <= LOW).join(low, key).unionByName(
        found.where(F.col("_level") > LOW).join(broadcast_list(high, (number >> LOW) + 64), key)
    )
    totals = met.groupBy("_mid", "_size").agg(*merged)
    per_row = halves.join(totals, ["_mid", "_size"]).groupBy("_row").agg(*merged)
    return numbered.join(per_row, "_row").drop("_row")
