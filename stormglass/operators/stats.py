"""Return, drawdown and volatility statistics of a labelled panel.

``count`` counts rows unless it is a count of a column; return statistics ignore missing returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import values as V
from stormglass.functions.ranking import with_position
from stormglass.operators.labels import is_crisis, regime


def best_first(column: str) -> list[Column]:
    """Descending, empty values last, ties by asset."""
    return [F.col(column).desc_nulls_last(), F.col("asset").asc()]


def stats_per_asset(labelled: DataFrame, profile: Profile) -> DataFrame:
    ret, fall = F.col("daily_return"), F.col("drawdown")
    return (
        labelled.groupBy("asset")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(ret).alias("mean_return"),
            F.median(ret).alias("median_return"),
            F.stddev_samp(ret).alias("std_return"),
            F.min(ret).alias("min_return"),
            F.max(ret).alias("max_return"),
            F.avg(fall).alias("mean_drawdown"),
            F.min(fall).alias("max_drawdown"),
            F.avg(profile.short_volatility).alias(f"mean_volatility_{profile.short_window}d"),
            V.share(ret > 0).alias("hit_rate"),
        )
        .orderBy(*best_first("mean_return"))
    )


def regime_stats(labelled: DataFrame, profile: Profile) -> DataFrame:
    ret = F.col("daily_return")
    return labelled.groupBy("asset", regime().alias("regime")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(ret).alias("mean_return"),
        F.stddev_samp(ret).alias("std_return"),
        F.avg(profile.short_volatility).alias(f"mean_volatility_{profile.short_window}d"),
        F.min("drawdown").alias("max_drawdown"),
        V.share(ret > 0).alias("hit_rate"),
    )


def return_ranking(labelled: DataFrame, ret: str = "daily_return") -> DataFrame:
    """Mean return per asset on crisis days, ranked by position."""
    means = (
        labelled.where(is_crisis())
        .groupBy("asset")
        .agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), F.count(ret).alias("count"))
    )
    return with_position(means, best_first("mean"))


def risk_detail(labelled: DataFrame, profile: Profile) -> DataFrame:
    ret = F.col("daily_return")
    return labelled.groupBy("asset", regime().alias("regime")).agg(
        F.avg(profile.short_volatility).alias(f"mean_volatility_{profile.short_window}d"),
        F.avg(profile.medium_volatility).alias(f"mean_volatility_{profile.medium_window}d"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(ret).alias("mean_return"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(profile.annual_days)))).alias("annualized_vol"),
    )


def risk_summary(features: DataFrame, profile: Profile) -> DataFrame:
    return features.groupBy("asset").agg(
        F.avg(profile.short_volatility).alias(profile.short_volatility),
        F.avg("drawdown").alias("drawdown"),
    )


def asset_regime_mean(labelled: DataFrame, ret: str = "daily_return") -> DataFrame:
    return labelled.groupBy("asset", regime().alias("regime")).agg(F.avg(ret).alias("mean_return"))


def top_by(df: DataFrame, column: str, n: int, absolute: bool = False) -> DataFrame:
    """First n rows by value or by absolute value."""
    key = F.abs(F.col(column)) if absolute else F.col(column)
    return df.orderBy(key.desc_nulls_last(), F.col(df.columns[0]).asc()).limit(n)


def regime_comparison(regime_means: DataFrame, profile: Profile, n: int) -> DataFrame:
    """Crisis next to normal mean for the n assets with the largest absolute crisis mean."""
    crisis = regime_means.where("regime = 'crisis'").select(
        "asset", F.col("mean_return").alias("crisis_return")
    )
    normal = regime_means.where("regime = 'normal'").select(
        "asset", F.col("mean_return").alias("normal_return")
    )
    top = top_by(crisis, "crisis_return", n, absolute=True)
    return top.join(normal, "asset", "left").select(
        "asset",
        V.class_of(F.col("asset"), profile.classes, profile.default_class).alias("class"),
        (F.col("crisis_return") * 100).alias("crisis_pct"),
        (F.col("normal_return") * 100).alias("normal_pct"),
    )
