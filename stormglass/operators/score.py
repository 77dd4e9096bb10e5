"""Defensive-asset metrics on crisis days and the weighted composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import values as V
from stormglass.functions.ranking import with_position
from stormglass.functions.staging import broadcast_days, staged
from stormglass.operators.labels import is_crisis
from stormglass.operators.stats import best_first

MIN_RETURNS = 5
MIN_PAIRS = 10


def _with_benchmark(rows: DataFrame, ret: str, profile: Profile) -> DataFrame:
    """Each row next to the benchmark's return of its date; ``_paired`` where the benchmark has a row."""
    benchmark = (
        rows.where(F.col("asset") == profile.benchmark.asset)
        .groupBy("date")
        .agg(F.max(ret).alias("_benchmark"))
        .withColumn("_paired", F.lit(True))
    )
    return rows.join(broadcast_days(benchmark), "date", "left")


def defensive_metrics(
    labelled: DataFrame,
    profile: Profile,
    ret: str = "daily_return",
    fall: str = "drawdown",
    average_rolling: bool = True,
    assets: list[str] | None = None,
) -> DataFrame:
    """Six raw metrics per asset with enough crisis returns.

    The outperform rate counts all rows that meet a benchmark row, the others only rows with a return.
    The candidate's correlation is the mean of its rolling correlation if ``average_rolling``.
    """
    crisis = labelled.where(is_crisis())
    if not average_rolling:
        crisis = crisis.where(F.col(ret).isNotNull())
    joined = _with_benchmark(crisis, ret, profile)
    if assets is not None:
        joined = joined.where(F.col("asset").isin(assets) if assets else F.lit(False))
    r, b, paired = F.col(ret), F.col("_benchmark"), F.col("_paired")
    pairs = F.count(paired)
    pearson = F.when(pairs >= MIN_PAIRS, V.correlation(r, b))
    if average_rolling:
        own = F.avg(profile.score_corr)
        pearson = F.when(F.col("asset") == profile.candidate.asset, own).otherwise(pearson)
    return (
        joined.groupBy("asset")
        .agg(
            F.avg(r).alias("mean_crisis_return"),
            F.coalesce(V.ratio(F.count_if(paired & (r > b)), pairs), F.lit(0.0)).alias(
                f"outperform_{profile.benchmark.label}_rate"
            ),
            F.min(fall).alias("max_drawdown_crisis"),
            F.stddev_samp(r).alias("crisis_volatility"),
            F.coalesce(pearson, F.lit(0.0)).alias(f"corr_with_{profile.benchmark.label}"),
            V.share(r > 0).alias("hit_rate"),
            F.count(r).alias("crisis_days"),
        )
        .where(F.col("crisis_days") >= MIN_RETURNS)
    )


def with_zscores(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Cross-sectional z-scores; a dimension without spread scores 0."""
    moments = df.agg(
        *[F.avg(c).alias(f"{n}_mean") for n, c in dimensions.items()],
        *[F.stddev_samp(c).alias(f"{n}_std") for n, c in dimensions.items()],
    )
    stats = moments.select(F.struct(*moments.columns)).scalar()
    scores = {}
    for name, value in dimensions.items():
        spread = stats.getField(f"{name}_std")
        flat = spread.isNull() | (spread == 0)
        scores[name] = F.when(flat, 0.0).otherwise(
            V.ratio(value - stats.getField(f"{name}_mean"), spread)
        )
    return df.withColumns(scores)


def composite_score(metrics: DataFrame, profile: Profile) -> DataFrame:
    """z-scores, their weighted sum and the rank by it."""
    w = profile.weights
    dimensions = {
        "z_return": F.col("mean_crisis_return"),
        "z_outperform": F.col(f"outperform_{profile.benchmark.label}_rate"),
        "z_drawdown": -F.abs("max_drawdown_crisis"),
        "z_vol": -F.col("crisis_volatility"),
        "z_corr": -F.col(f"corr_with_{profile.benchmark.label}"),
        "z_hit": F.col("hit_rate"),
    }
    weights = (w.mean_return, w.outperform, w.drawdown, w.volatility, w.correlation, w.hit_rate)
    weighted = [weight * F.col(name) for weight, name in zip(weights, dimensions)]
    total = weighted[0]
    for term in weighted[1:]:
        total = total + term
    scored = with_zscores(staged(metrics, "metrics"), dimensions)
    return rerank(scored.withColumn("safe_haven_score", total))


def rerank(scored: DataFrame) -> DataFrame:
    return with_position(scored.drop("rank"), best_first("safe_haven_score"))


def safe_haven_score(labelled: DataFrame, profile: Profile) -> DataFrame:
    return composite_score(defensive_metrics(labelled, profile), profile)


def period_ranking(period: DataFrame, profile: Profile, assets: list[str]) -> DataFrame:
    """Score on a period panel; the benchmark is compared with even if it is not among the assets."""
    metrics = defensive_metrics(
        period, profile, "period_return", "period_drawdown", average_rolling=False, assets=assets
    )
    return composite_score(metrics, profile)
