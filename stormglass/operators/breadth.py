"""How many assets hold up on crisis days, overall and by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import values as V
from stormglass.functions.staging import staged
from stormglass.operators.labels import is_crisis


def _per_asset(rows: DataFrame, ret: str, fall: str) -> DataFrame:
    """Mean return, deepest fall and first known group per asset.

    Rows are summed by (asset, group) first, so that text is only a grouping key and never part of a
    hash aggregate's buffer on the large side.
    """
    sums = rows.groupBy("asset", "group").agg(
        F.sum(ret).alias("_sum"),
        F.count(ret).alias("_count"),
        F.min(fall).alias("_fall"),
        F.min("date").alias("_first"),
    )
    grouped = F.col("group").isNotNull()
    return sums.groupBy("asset").agg(
        V.ratio(F.sum("_sum"), F.sum("_count")).alias("mean_return"),
        F.min("_fall").alias("max_drawdown"),
        F.min_by("group", F.when(grouped, F.col("_first"))).alias("group"),
    )


def breadth_of(per_asset: DataFrame, profile: Profile, strict_decline: bool) -> DataFrame:
    """Breadth from (asset, mean_return, max_drawdown); without ``strict_decline`` a missing mean declines."""
    per_asset = staged(per_asset, "breadth")
    is_benchmark = F.col("asset") == profile.benchmark.asset
    benchmark = (
        per_asset.agg(
            F.max(F.when(is_benchmark, F.col("mean_return"))).alias("mean"),
            F.max(F.when(is_benchmark, F.col("max_drawdown"))).alias("fall"),
        )
        .select(F.struct("mean", "fall"))
        .scalar()
    )
    counts = per_asset.agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.count_if(F.col("mean_return") > 0).alias("advance_count"),
        F.count_if(F.col("mean_return") <= 0).alias("_fallers"),
        F.count_if(F.col("mean_return") > benchmark.getField("mean")).alias("_better"),
        F.count_if(F.col("max_drawdown") > benchmark.getField("fall")).alias("_shallower"),
    ).where("total_assets > 0")
    n, label = F.col("total_assets"), profile.benchmark.label
    decline = F.col("_fallers") if strict_decline else n - F.col("advance_count")
    return counts.select(
        "total_assets",
        "advance_count",
        decline.alias("decline_count"),
        V.percent(F.col("advance_count"), n).alias("pct_positive_crisis"),
        V.percent(F.col("_better"), n).alias(f"pct_outperform_{label}"),
        V.percent(F.col("_shallower"), n).alias("pct_low_drawdown"),
        benchmark.getField("mean").alias(f"{label}_mean_crisis_return"),
        benchmark.getField("fall").alias(f"{label}_max_drawdown"),
    )


def market_breadth(labelled: DataFrame, profile: Profile) -> DataFrame:
    """Assets without any return count as declining."""
    rows = _per_asset(labelled.where(is_crisis()), "daily_return", "drawdown")
    return breadth_of(rows, profile, strict_decline=False)


def group_breadth_of(per_asset: DataFrame) -> DataFrame:
    """Breadth per group from (asset, group, mean_return)."""
    counts = (
        per_asset.where(F.col("group").isNotNull())
        .groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("mean_return") > 0).alias("advance"),
            F.count_if(F.col("mean_return") <= 0).alias("decline"),
        )
    )
    return counts.withColumn("pct_positive", V.percent(F.col("advance"), F.col("total")))


def breadth_by_group(labelled: DataFrame) -> DataFrame:
    """An asset without any return is neither advancing nor declining."""
    return group_breadth_of(_per_asset(labelled.where(is_crisis()), "daily_return", "drawdown"))


def _crisis_returns(period: DataFrame) -> DataFrame:
    return period.where(is_crisis() & F.col("period_return").isNotNull())


def period_breadth(period: DataFrame, profile: Profile) -> DataFrame:
    """Same over a period panel; only a mean of 0 or less counts as declining."""
    rows = _per_asset(_crisis_returns(period), "period_return", "period_drawdown")
    return breadth_of(rows, profile, strict_decline=True)


def period_breadth_by_group(period: DataFrame) -> DataFrame:
    means = (
        _crisis_returns(period)
        .where(F.col("group").isNotNull())
        .groupBy("group", "asset")
        .agg(F.avg("period_return").alias("mean_return"))
    )
    counts = means.groupBy("group").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("mean_return") > 0).alias("advance"),
    )
    return counts.select(
        "group",
        "total",
        "advance",
        (F.col("total") - F.col("advance")).alias("decline"),
        V.percent(F.col("advance"), F.col("total")).alias("pct_positive"),
    )
