"""Fixed-weight portfolios against the benchmark.

Member series are cut out of the panel by a pushed filter; everything after the daily sum has one row
per date.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import rolling as R
from stormglass.functions import values as V
from stormglass.functions.staging import broadcast_list, staged


def normalized_weights(spark: SparkSession, weights: Mapping[str, float]) -> DataFrame:
    """Weights divided by their sum; a sum of 0 gives no rows."""
    given = spark.createDataFrame(
        [(a, float(w)) for a, w in weights.items()], "asset string, weight double"
    )
    total = given.agg(F.sum("weight")).scalar()
    shares = given.withColumn("weight", V.ratio(F.col("weight"), total))
    return broadcast_list(shares.where(F.col("weight").isNotNull()), len(weights))


def member_returns(panel: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Returns of the members, each on its own calendar, with their weights."""
    w = R.by_asset()
    members = panel.where(F.col("asset").isin(list(weights))).select(
        "date", "asset", V.number(F.col("adj_close")).alias("_price")
    )
    filled = members.withColumn("_filled", R.forward_fill(F.col("_price"), w))
    returns = filled.select("date", "asset", R.change(F.col("_filled"), w).alias("daily_return"))
    shares = normalized_weights(panel.sparkSession, weights)
    return returns.where(F.col("daily_return").isNotNull()).join(shares, "asset")


def portfolio_daily(panel: DataFrame, weights: Mapping[str, float], profile: Profile) -> DataFrame:
    """Portfolio return on the dates on which every member has a return.

    The benchmark column is empty unless the benchmark is a member.
    """
    returns = staged(member_returns(panel, weights), "members")
    members = returns.agg(F.count_distinct("asset")).scalar()
    benchmark = F.when(F.col("asset") == profile.benchmark.asset, F.col("daily_return"))
    daily = returns.groupBy("date").agg(
        F.count(F.lit(1)).alias("_present"),
        F.sum(F.col("weight") * F.col("daily_return")).alias("portfolio"),
        F.max(benchmark).alias("benchmark"),
    )
    return daily.where(F.col("_present") == members).drop("_present")


def strategies(daily: DataFrame) -> DataFrame:
    """Long (date, strategy, daily_return) with the level 1 + cumulative return."""
    long = daily.unpivot(["date"], ["portfolio", "benchmark"], "strategy", "daily_return")
    present = long.dropna(subset=["daily_return"])
    w = Window.partitionBy("strategy").orderBy("date")
    return present.withColumn("level", R.compounded(F.col("daily_return"), w))


def cumulative_returns(daily: DataFrame) -> DataFrame:
    return strategies(daily).select(
        "date", "strategy", (F.col("level") - 1).alias("cumulative_return")
    )


def strategy_drawdowns(daily: DataFrame) -> DataFrame:
    """Percent below the strategy's running peak; the start value 1 is not part of the peak."""
    w = Window.partitionBy("strategy").orderBy("date")
    return strategies(daily).select(
        "date", "strategy", (R.drawdown(F.col("level"), w) * 100).alias("drawdown")
    )


def strategy_stats(daily: DataFrame, profile: Profile) -> DataFrame:
    """Total and annualised return, volatility, Sharpe ratio and deepest drawdown."""
    w = Window.partitionBy("strategy").orderBy("date")
    levels = strategies(daily).withColumn("_drawdown", R.drawdown(F.col("level"), w))
    days = F.lit(float(profile.annual_days))
    totals = levels.groupBy("strategy").agg(
        (F.max_by("level", "date") - 1).alias("total_return"),
        F.count(F.lit(1)).alias("_n"),
        (F.stddev_samp("daily_return") * F.sqrt(days)).alias("annual_volatility"),
        F.min("_drawdown").alias("max_drawdown"),
    )
    grown = totals.withColumn(
        "annual_return", F.pow(1 + F.col("total_return"), days / F.col("_n")) - 1
    )
    sharpe = F.when(
        F.col("annual_volatility") > 0, V.ratio(F.col("annual_return"), F.col("annual_volatility"))
    ).otherwise(0.0)
    return grown.select(
        "strategy", "total_return", "annual_return", "annual_volatility",
        sharpe.alias("sharpe_ratio"), "max_drawdown",
    )


def drawdown_comparison(daily: DataFrame) -> DataFrame:
    """Deepest drawdowns next to each other; no row unless the benchmark is a member."""
    deepest = (
        strategy_drawdowns(daily)
        .groupBy()
        .pivot("strategy", ["portfolio", "benchmark"])
        .agg(F.min("drawdown"))
        .where(F.col("benchmark").isNotNull())
    )
    return deepest.select(
        F.col("portfolio").alias("portfolio_max_drawdown"),
        F.col("benchmark").alias("benchmark_max_drawdown"),
        (F.col("benchmark") - F.col("portfolio")).alias("difference"),
        (F.col("portfolio") > F.col("benchmark")).alias("improved"),
    )
