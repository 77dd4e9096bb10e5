"""Sliding statistics whose work per row does not grow with the frame.

A series is cut into blocks as long as the frame. A frame then consists of the end of one block and the
beginning of the next, so a summary running forwards and one running backwards through every block, merged
pairwise, give each frame. Nothing is subtracted, so no digits are lost; counts, sums, squared deviations
and co-moments merge. Spark's own sliding frames add up every row anew and are cheaper only while short.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stormglass.functions import rolling as R
from stormglass.functions import values as V

DIRECT = 64  # rows up to which Spark's sliding frames are used: they are the cheaper ones there


@dataclass(frozen=True)
class Frame:
    """The last ``n`` rows: ``mean``, ``deviation`` (sample), ``highest`` or ``correlation`` of x with y.

    Null until ``at_least`` values (else all n) are there; a correlation always needs n pairs.
    """

    kind: str
    n: int
    x: str
    y: str | None = None
    at_least: int | None = None


def direct(frame: Frame, w: WindowSpec) -> Column:
    """The frame by Spark's sliding window."""
    x = F.col(frame.x)
    if frame.kind == "correlation":
        return R.rolling_correlation(x, F.col(frame.y), w, frame.n)
    aggregate = {"mean": F.avg, "deviation": F.stddev_samp, "highest": F.max}[frame.kind]
    return R.rolling(aggregate, x, w, frame.n, frame.at_least)


def _summary(frame: Frame, w: WindowSpec) -> Column:
    """Mergeable summary of a running window; pairs count only where both values are there."""
    x = F.col(frame.x)
    count, spread = F.count(x).over(w), lambda c: F.var_pop(c).over(w) * F.count(c).over(w)
    if frame.kind == "highest":
        return F.struct(count.alias("n"), F.max(x).over(w).alias("high"))
    if frame.kind == "mean":
        return F.struct(count.alias("n"), F.sum(x).over(w).alias("sum"))
    ends = lambda c, s: [
        F.sum(c).over(w).alias(f"sum{s}"),
        spread(c).alias(f"squares{s}"),
        F.min(c).over(w).alias(f"low{s}"),
        F.max(c).over(w).alias(f"high{s}"),
    ]
    if frame.kind == "deviation":
        return F.struct(count.alias("n"), *ends(x, ""))
    y = F.col(frame.y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    count = F.count(x).over(w)
    shared = (F.covar_pop(x, y).over(w) * count).alias("shared")
    return F.struct(count.alias("n"), *ends(x, "_x"), *ends(y, "_y"), shared)


def _merged(frame: Frame, old: Column, new: Column) -> Column:
    """The statistic of two adjoining summaries; ``old`` is null where ``new`` is the whole frame."""

    def zero(part: Column, name: str) -> Column:
        return F.coalesce(part.getField(name), F.lit(0))

    a, b = zero(old, "n"), zero(new, "n")
    n = a + b
    enough = n >= (frame.at_least or frame.n)

    def total(name: str) -> Column:
        return zero(old, name) + zero(new, name)

    def shift(suffix: str) -> Column:
        """Difference of the means, 0 if one side is empty."""
        apart = zero(new, f"sum{suffix}") / F.nullif(b, F.lit(0)) - zero(old, f"sum{suffix}") / F.nullif(a, F.lit(0))
        return F.coalesce(apart, F.lit(0.0))

    def squares(suffix: str) -> Column:
        """Sum of squared deviations, exactly 0 if all values are the same."""
        low = F.least(old.getField(f"low{suffix}"), new.getField(f"low{suffix}"))
        high = F.greatest(old.getField(f"high{suffix}"), new.getField(f"high{suffix}"))
        merged = total(f"squares{suffix}") + shift(suffix) * shift(suffix) * a * b / F.nullif(n, F.lit(0))
        return F.when(low == high, 0.0).otherwise(merged)

    if frame.kind == "highest":
        return F.when(enough, F.greatest(old.getField("high"), new.getField("high")))
    if frame.kind == "mean":
        return F.when(enough, V.ratio(total("sum"), n))
    if frame.kind == "deviation":
        return F.when(enough & (n > 1), F.sqrt(squares("") / (n - 1)))
    shared = total("shared") + shift("_x") * shift("_y") * a * b / F.nullif(n, F.lit(0))
    spread = F.sqrt(squares("_x")) * F.sqrt(squares("_y"))
    return F.when((n == frame.n) & (n > 1), V.ratio(shared, spread))


def with_frames(
    df: DataFrame, keys: Sequence[str], frames: Mapping[str, Frame], order: str = "date", direct_up_to: int = DIRECT
) -> DataFrame:
    """Add each frame's statistic, per series of ``keys`` in ``order`` (unique within a series).

    Frames of up to ``direct_up_to`` rows share one sort with other windows over the series. Longer ones
    cost two more sorts for each different length, on the same shuffle, and the same time at any length.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    short = {name: direct(f, w) for name, f in frames.items() if f.n <= direct_up_to}
    long = {name: f for name, f in frames.items() if f.n > direct_up_to}
    if short:
        df = df.withColumns(short)
    if not long:
        return df
    df = df.withColumn("_place", F.row_number().over(w) - 1)
    lengths = sorted({f.n for f in long.values()})
    for n in lengths:
        df = df.withColumn(f"_block_{n}", F.floor(F.col("_place") / n))
        block = Window.partitionBy(*keys, f"_block_{n}")
        # Ascending first: Spark would move an ascending window past the look back below and sort once more.
        for direction, by in (("new", F.col(order).asc()), ("old", F.col(order).desc())):
            running = R.upto(block.orderBy(by))
            df = df.withColumns(
                {f"_{direction}_{name}": _summary(f, running) for name, f in long.items() if f.n == n}
            )
    columns = {}
    for name, f in long.items():
        whole = (F.col("_place") + 1) % f.n == 0
        columns[f"_old_{name}"] = F.when(~whole, F.lag(f"_old_{name}", f.n - 1).over(w))
    df = df.withColumns(columns)
    df = df.withColumns({name: _merged(f, F.col(f"_old_{name}"), F.col(f"_new_{name}")) for name, f in long.items()})
    helpers = [f"_{d}_{name}" for d in ("old", "new") for name in long]
    return df.drop("_place", *[f"_block_{n}" for n in lengths], *helpers)
