"""Row-frame window helpers for series ordered by date.

Rolling frames count rows and give null until they hold enough non-null values. A series has at most
one row per day, so the window of one asset (or of a date-level table) is bounded by the calendar
(``values.CALENDAR_DAYS``) whatever share of all raw rows that asset has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from stormglass.functions import values as V


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("date")


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def forward_fill(value: Column, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(upto(w))


def change(filled: Column, w: WindowSpec, periods: int = 1) -> Column:
    """Relative change against ``periods`` rows before; a zero base gives null."""
    return V.ratio(filled, F.lag(filled, periods).over(w)) - 1


def rolling(
    aggregate: Callable[[Column], Column],
    value: Column,
    w: WindowSpec,
    n: int,
    at_least: int | None = None,
) -> Column:
    frame = last_rows(w, n)
    enough = F.count(value).over(frame) >= (n if at_least is None else at_least)
    return F.when(enough, aggregate(value).over(frame))


def rolling_correlation(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    frame = last_rows(w, n)
    both = x.isNotNull() & y.isNotNull()
    x_paired, y_paired = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(x_paired).over(frame) * F.stddev_samp(y_paired).over(frame)
    value = V.ratio(F.covar_samp(x_paired, y_paired).over(frame), spread)
    return F.when(F.count(x_paired).over(frame) == n, value)


def compounded(returns: Column, w: WindowSpec) -> Column:
    """Running product of 1 + r, a null return counting as 0."""
    return F.product(1 + F.coalesce(returns, F.lit(0.0))).over(upto(w))


def drawdown(level: Column, w: WindowSpec) -> Column:
    """Distance below the running peak."""
    return V.ratio(level, F.max(level).over(upto(w))) - 1
