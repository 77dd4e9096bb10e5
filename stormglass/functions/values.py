"""Null-safe scalar helpers. Missing is always null, never NaN, and no expression raises under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The days a nanosecond timestamp can hold. Any other date counts as unreadable, so a
# table with one row per date never has more than CALENDAR_DAYS rows, however large the panel is.
FIRST_DAY = "1677-09-22"
LAST_DAY = "2262-04-11"
CALENDAR_DAYS = 213_503


def day(value: Column) -> Column:
    """Calendar day of a date, timestamp or text; unreadable or out of the calendar gives null."""
    parsed = value.try_cast("date")
    inside = parsed.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    return F.when(inside, parsed)


def moment(value: Column) -> Column:
    """Timestamp of a date or text, within the same calendar."""
    parsed = value.try_cast("timestamp")
    return F.when(day(value).isNotNull(), parsed)


# Words that count as a missing cell.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def missing(cell: Column) -> Column:
    """Whether a cell of text is empty or says that it is."""
    return cell.isNull() | cell.isin(*MISSING_WORDS)


def number(value: Column) -> Column:
    """Double of a number or text; unreadable text and NaN give null."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def finite(value: Column) -> Column:
    """NaN and both infinities give null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: share of rows where the condition holds; a null condition does not count at all."""
    return F.avg(F.when(condition, 1.0).when(condition.isNotNull(), 0.0))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs; null where one side is constant.

    Each side has its own window over the complete pairs, so no division by zero can be raised.
    """
    x_paired = F.when(y.isNotNull(), x)
    y_paired = F.when(x.isNotNull(), y)
    return ratio(F.covar_samp(x, y), F.stddev_samp(x_paired) * F.stddev_samp(y_paired))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, ties to even; zero where there is nothing to share."""
    return F.coalesce(F.bround(ratio(part, whole) * 100, 1), F.lit(0.0))


def percent_text(fraction: Column, decimals: int, signed: bool = False) -> Column:
    """Fraction as fixed-decimal percent text, ``nan%`` where it is missing."""
    sign = "+" if signed else ""
    text = F.format_string(f"%{sign}.{decimals}f%%", F.bround(fraction * 100, decimals))
    return F.when(fraction.isNotNull(), text).otherwise("nan%")


def class_of(asset: Column, classes, default: str) -> Column:
    """First class whose member list holds the asset."""
    result = None
    for name, members in classes:
        test = asset.isin(list(members))
        result = F.when(test, name) if result is None else result.when(test, name)
    return F.lit(default) if result is None else result.otherwise(default)


def renamed(asset: Column, names) -> Column:
    """Display name of an asset; an asset without one keeps its own."""
    result = None
    for raw, shown in names:
        result = F.when(asset == raw, shown) if result is None else result.when(asset == raw, shown)
    return asset if result is None else result.otherwise(asset)
