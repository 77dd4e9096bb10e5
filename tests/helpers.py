"""Hand-written panels."""

from __future__ import annotations

from datetime import date, timedelta

START = date(2020, 1, 6)  # a Monday


def days(n, start=START, weekdays=False):
    out, day = [], start
    while len(out) < n:
        if not weekdays or day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def panel(spark, rows):
    """rows: (date, asset, price or None) or with a group as fourth."""
    full = [
        (r[0], None, r[2], r[2], r[2], r[2], 1.0, r[1], r[3] if len(r) > 3 else "g", "s") for r in rows
    ]
    return spark.createDataFrame(
        full,
        "date date, open double, high double, low double, close double, adj_close double, "
        "volume double, asset string, group string, source string",
    )


def labelled(spark, rows):
    """rows: (asset, date, daily_return, drawdown, label[, group])."""
    full = [(*r[:5], r[5] if len(r) > 5 else "g", 0.1) for r in rows]
    return spark.createDataFrame(
        full,
        "asset string, date date, daily_return double, drawdown double, final_crisis_label int, "
        "group string, rolling_corr_econ_std_90d double",
    )


def values(df, key, column):
    return {r[key]: r[column] for r in df.collect()}
