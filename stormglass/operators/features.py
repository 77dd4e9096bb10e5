"""Per-asset features on one shuffle and one sort by (asset, date), long frames on two more sorts per length."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import rolling as R
from stormglass.functions.sliding import Frame, with_frames


def _definitions(profile: Profile) -> tuple[dict[str, Callable | Frame], dict[str, Callable | Frame]]:
    """Features on the price, and features on those; each is a frame or built from the asset's window."""
    price, filled, ret = F.col("_price"), F.col("_filled"), F.col("daily_return")
    short, medium = profile.short_window, profile.medium_window
    levels = {
        "daily_return": lambda w: R.change(filled, w),
        f"rolling_mean_{short}d": Frame("mean", short, "_price"),
        "drawdown": lambda w: R.drawdown(price, w),
        "rolling_high": Frame("highest", medium, "_price"),
        **{f"ma_{n}": Frame("mean", n, "_price") for n in profile.moving_averages},
        **{f"return_{n}d": lambda w, n=n: R.change(filled, w, n) for n in profile.return_periods},
    }
    derived = {
        "log_return": lambda w: F.log1p(F.when(ret != -1, ret)),
        "daily_change": lambda w: F.col("close") - F.col("open"),
        "cumulative_return": lambda w: R.compounded(ret, w) - 1,
        profile.short_volatility: Frame("deviation", short, "daily_return"),
        profile.medium_volatility: Frame("deviation", medium, "daily_return"),
        "max_drawdown": lambda w: F.min("drawdown").over(Window.partitionBy("asset")),
    }
    return levels, derived


def feature_columns(profile: Profile) -> list[str]:
    levels, derived = _definitions(profile)
    return [*levels, *derived]


def asset_features(
    panel: DataFrame, profile: Profile, only: Collection[str] | None = None
) -> DataFrame:
    """Returns, volatility, drawdown and averages of a panel with one row per (asset, date).

    The effective price is the adjusted close, else the close. Returns carry the last price over gaps;
    averages and drawdown use the price as it is. ``only`` leaves out features nobody reads; returns
    and drawdown are always there.
    """
    w = R.by_asset()
    levels, derived = _definitions(profile)

    def kept(definitions: dict) -> list[str]:
        return [n for n in definitions if only is None or n in only or n in ("daily_return", "drawdown")]

    def added(df: DataFrame, definitions: dict[str, Callable | Frame]) -> DataFrame:
        wanted = {n: definitions[n] for n in kept(definitions)}
        frames = {n: d for n, d in wanted.items() if isinstance(d, Frame)}
        columns = {n: make(w) for n, make in wanted.items() if n not in frames}
        return with_frames(df.withColumns(columns), ["asset"], frames)

    priced = panel.withColumn("_price", F.coalesce("adj_close", "close"))
    filled = priced.withColumn("_filled", R.forward_fill(F.col("_price"), w))
    done = added(added(filled, levels), derived)
    return done.select(*panel.columns, *kept(levels), *kept(derived))
