"""Regime flags, the combined label and the success target, on the date spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions.staging import broadcast_days

LABEL = "final_crisis_label"


def is_crisis() -> Column:
    return F.col(LABEL) == 1


def regime() -> Column:
    """``crisis`` where the label is 1, else ``normal`` (also without a label)."""
    return F.when(is_crisis(), "crisis").otherwise("normal")


def with_labels(dates: DataFrame, profile: Profile) -> DataFrame:
    """Flags per date.

    The drawdown flag is null on dates without a benchmark row and counts as 0 there; the macro flags
    are never null. The target is null outside a crisis and where either return is missing.
    """
    stress = F.col(profile.stress_variable) >= profile.stress_threshold
    recession = F.col(profile.recession_variable) >= profile.recession_threshold
    fall = F.col(profile.benchmark_drawdown) <= profile.drawdown_threshold
    flags = {
        profile.stress_flag: F.when(stress, 1).otherwise(0),
        "crisis_by_recession": F.when(recession, 1).otherwise(0),
        profile.drawdown_flag: F.when(
            F.col("benchmark_present"), F.when(fall, 1).otherwise(0)
        ),
    }
    any_flag = F.greatest(*[F.coalesce(F.col(name), F.lit(0)) for name in flags])
    mine = F.col(f"{profile.candidate.label}_return")
    theirs = F.col(f"{profile.benchmark.label}_return")
    protected = (mine > theirs) | ((mine >= 0) & (theirs < 0))
    target = F.when(
        is_crisis() & mine.isNotNull() & theirs.isNotNull(), F.when(protected, 1.0).otherwise(0.0)
    )
    return dates.withColumns(flags).withColumn(LABEL, any_flag).withColumn(profile.success, target)


def label_columns(profile: Profile) -> list[str]:
    return [
        profile.stress_flag, "crisis_by_recession", profile.drawdown_flag,
        LABEL, profile.success, profile.benchmark_drawdown,
    ]


def onto_panel(features: DataFrame, dates: DataFrame, columns: list[str]) -> DataFrame:
    """Date-level columns joined back to every panel row."""
    return features.join(broadcast_days(dates.select("date", *columns)), "date", "left")


def label_summary(dates: DataFrame, profile: Profile) -> DataFrame:
    """Metric/value rows: crisis, normal, success and failure days."""
    target = F.col(profile.success)
    name = f"{profile.candidate.label}_safe_haven"
    counts = dates.agg(
        F.count_if(is_crisis()).alias("crisis_days"),
        F.count_if(F.col(LABEL) == 0).alias("normal_days"),
        F.count_if(is_crisis() & (target == 1)).alias(f"{name}_success_days"),
        F.count_if(is_crisis() & (target == 0)).alias(f"{name}_fail_days"),
    )
    return counts.unpivot([], counts.columns, "metric", "value")


def crisis_daily(dates: DataFrame, profile: Profile) -> DataFrame:
    return dates.select("date", LABEL, profile.success, profile.stress_variable)


def failure_cases(labelled: DataFrame, profile: Profile) -> DataFrame:
    """Crisis days on which the candidate did not protect."""
    return labelled.where(
        (F.col("asset") == profile.candidate.asset) & is_crisis() & (F.col(profile.success) == 0)
    ).select("date", profile.success, "daily_return", profile.stress_variable)
