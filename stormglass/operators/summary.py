"""One pass over a labelled panel from which several reports are cut.

``asset_summary`` holds one row per asset with the moments of all its rows, of its crisis rows and of the
others. Every function below reads that table, which has as many rows as there are assets, instead of the
panel, and gives the rows of the function of the same name in ``stats``, ``breadth`` or ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import values as V
from stormglass.functions.ranking import with_position
from stormglass.operators import breadth as B
from stormglass.operators import events as E
from stormglass.operators.labels import is_crisis
from stormglass.operators.stats import best_first

SLICES = ("all", "crisis", "normal")


def asset_summary(labelled: DataFrame, profile: Profile) -> DataFrame:
    """Per asset: the median return, the first known group on crisis days, and a struct per slice of rows.

    One asset has at most one row per day, so the median's buffer is bounded by the calendar. A row
    without a label counts as normal.
    """
    inside = {"all": F.lit(True), "crisis": is_crisis(), "normal": ~F.coalesce(is_crisis(), F.lit(False))}

    def moments(rows: Column) -> Column:
        at = lambda name: F.when(rows, F.col(name))
        ret, fall = at("daily_return"), at("drawdown")
        return F.struct(
            F.count_if(rows).alias("rows"),
            F.count(ret).alias("returns"),
            F.avg(ret).alias("mean"),
            F.stddev_samp(ret).alias("std"),
            F.min(ret).alias("least"),
            F.max(ret).alias("greatest"),
            V.share(ret > 0).alias("hit_rate"),
            F.avg(fall).alias("mean_drawdown"),
            F.min(fall).alias("max_drawdown"),
            F.avg(at(profile.short_volatility)).alias("short_volatility"),
            F.avg(at(profile.medium_volatility)).alias("medium_volatility"),
        )

    known = is_crisis() & F.col("group").isNotNull()
    return labelled.groupBy("asset").agg(
        F.median("daily_return").alias("median_return"),
        F.min_by("group", F.when(known, F.col("date"))).alias("group"),
        *[moments(inside[name]).alias(name) for name in SLICES],
    )


def _regimes(summary: DataFrame) -> DataFrame:
    """One row per asset and regime that has rows."""
    rows = F.array(*[F.struct(F.lit(name).alias("regime"), f"{name}.*") for name in ("crisis", "normal")])
    return summary.select("asset", F.inline(rows)).where("rows > 0")


def stats_per_asset(summary: DataFrame, profile: Profile) -> DataFrame:
    return summary.select(
        "asset",
        F.col("all.rows").alias("count"),
        F.col("all.mean").alias("mean_return"),
        "median_return",
        F.col("all.std").alias("std_return"),
        F.col("all.least").alias("min_return"),
        F.col("all.greatest").alias("max_return"),
        F.col("all.mean_drawdown"),
        F.col("all.max_drawdown"),
        F.col("all.short_volatility").alias(f"mean_volatility_{profile.short_window}d"),
        F.col("all.hit_rate"),
    ).orderBy(*best_first("mean_return"))


def regime_stats(summary: DataFrame, profile: Profile) -> DataFrame:
    return _regimes(summary).select(
        "asset",
        "regime",
        F.col("rows").alias("count"),
        F.col("mean").alias("mean_return"),
        F.col("std").alias("std_return"),
        F.col("short_volatility").alias(f"mean_volatility_{profile.short_window}d"),
        "max_drawdown",
        "hit_rate",
    )


def return_ranking(summary: DataFrame) -> DataFrame:
    means = summary.where("crisis.rows > 0").select(
        "asset", "crisis.mean", "crisis.std", F.col("crisis.returns").alias("count")
    )
    return with_position(means, best_first("mean"))


def risk_detail(summary: DataFrame, profile: Profile) -> DataFrame:
    return _regimes(summary).select(
        "asset",
        "regime",
        F.col("short_volatility").alias(f"mean_volatility_{profile.short_window}d"),
        F.col("medium_volatility").alias(f"mean_volatility_{profile.medium_window}d"),
        "max_drawdown",
        F.col("mean").alias("mean_return"),
        (F.col("std") * F.sqrt(F.lit(float(profile.annual_days)))).alias("annualized_vol"),
    )


def risk_summary(summary: DataFrame, profile: Profile) -> DataFrame:
    return summary.select(
        "asset",
        F.col("all.short_volatility").alias(profile.short_volatility),
        F.col("all.mean_drawdown").alias("drawdown"),
    )


def asset_regime_mean(summary: DataFrame) -> DataFrame:
    return _regimes(summary).select("asset", "regime", F.col("mean").alias("mean_return"))


def _crisis_assets(summary: DataFrame) -> DataFrame:
    crisis = summary.where("crisis.rows > 0")
    return crisis.select("asset", F.col("crisis.mean").alias("mean_return"), "crisis.max_drawdown", "group")


def market_breadth(summary: DataFrame, profile: Profile) -> DataFrame:
    return B.breadth_of(_crisis_assets(summary), profile, strict_decline=False)


def breadth_by_group(summary: DataFrame) -> DataFrame:
    return B.group_breadth_of(_crisis_assets(summary))


def overall_verdict(summary: DataFrame, profile: Profile) -> DataFrame:
    return E.overall_text(
        summary.agg(*E.pair_of(profile, F.col("crisis.rows"), F.col("crisis.mean"))), profile
    )
