"""Statistics inside named date intervals, and the verdict texts built on them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.config import Event, Profile
from stormglass.functions import rolling as R
from stormglass.functions import values as V
from stormglass.functions.staging import broadcast_list
from stormglass.operators.labels import is_crisis
from stormglass.sources.dimensions import event_table


def in_events(
    panel: DataFrame, events: Iterable[Event], before: int = 0, after: int = 0
) -> DataFrame:
    """Panel rows once per event whose closed interval, widened by days, holds their date.

    The intervals are laid out as days, so the interval join is an equality join on the date; events
    may overlap.
    """
    events = tuple(events)
    days = event_table(panel.sparkSession, events).select(
        F.col("name").alias("crisis_name"),
        "start_date",
        "end_date",
        F.explode(
            F.sequence(F.date_sub("start_date", before), F.date_add("end_date", after))
        ).alias("date"),
    )
    if not events:
        return panel.join(days, "date")
    first = min(e.start_date for e in events) - timedelta(days=before)
    last = max(e.end_date for e in events) + timedelta(days=after)
    length = sum((e.end_date - e.start_date).days + 1 + before + after for e in events)
    inside = panel.where(F.col("date").between(F.lit(first), F.lit(last)))
    return inside.join(broadcast_list(days, length), "date")


def event_summary(labelled: DataFrame, events: Iterable[Event]) -> DataFrame:
    """Per (event, asset): rows, days with a return and their statistics.

    The total return uses the adjusted close alone.
    """
    ret, price = F.col("daily_return"), F.col("adj_close")
    priced_day = F.when(price.isNotNull(), F.col("date"))
    total = V.ratio(F.max_by(price, priced_day), F.min_by(price, priced_day)) - 1
    return (
        in_events(labelled, events)
        .groupBy("crisis_name", "start_date", "end_date", "asset")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(ret).alias("trading_days"),
            F.avg(ret).alias("mean_daily_return"),
            F.when(F.count(price) >= 2, total).alias("total_return"),
            F.stddev_samp(ret).alias("std_return"),
            F.min("drawdown").alias("max_drawdown"),
            V.share(ret > 0).alias("hit_rate"),
        )
    )


def with_returns(summary: DataFrame) -> DataFrame:
    """The rows of ``event_summary`` that have a return."""
    return summary.where(F.col("trading_days") > 0).drop("rows")


def stats_per_event(labelled: DataFrame, events: Iterable[Event]) -> DataFrame:
    """Per (event, asset) with at least one return."""
    return with_returns(event_summary(labelled, events))


def rebased_prices(panel: DataFrame, events: Iterable[Event], before: int = 30, after: int = 10):
    """Adjusted close as percent of the first row of each widened event window, even if that is empty."""
    w = Window.partitionBy("crisis_name", "asset").orderBy("date")
    first = F.first("adj_close").over(R.whole(w))
    return in_events(panel, events, before, after).select(
        "crisis_name", "asset", "date", (100 * V.ratio(F.col("adj_close"), first)).alias("rebased")
    )


def event_performance(panel: DataFrame, events: Iterable[Event], profile: Profile) -> DataFrame:
    """Percent change and lowest point against the first row, assets with two rows or more."""
    price = F.col("adj_close")
    start, end = F.min_by(price, F.col("date")), F.max_by(price, F.col("date"))
    moves = (
        in_events(panel, events)
        .groupBy("crisis_name", "asset")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            (V.ratio(end, start) - 1).alias("_change"),
            (V.ratio(F.min(price), start) - 1).alias("_low"),
        )
        .where("_rows >= 2")
    )
    return moves.select(
        "crisis_name",
        "asset",
        V.class_of(F.col("asset"), profile.classes, profile.default_class).alias("class"),
        (F.col("_change") * 100).alias("return_pct"),
        (F.col("_low") * 100).alias("max_drawdown_pct"),
        V.percent_text(F.col("_change"), 2, signed=True).alias("return_text"),
        V.percent_text(F.col("_low"), 2).alias("max_drawdown_text"),
        F.coalesce(F.col("_change") >= 0, F.lit(False)).alias("survived"),
    )


def _protection(mine: Column, theirs: Column) -> Column:
    return (
        F.when((mine > 0) & (theirs < 0), "safe_haven")
        .when(mine > theirs, "partial")
        .otherwise("failed")
    )


def event_comparison(performance: DataFrame, profile: Profile) -> DataFrame:
    """Candidate against benchmark per event, on returns as shown (two decimals)."""
    shown = F.bround("return_pct", 2)
    pair = (
        performance.where(F.col("asset").isin(profile.candidate.asset, profile.benchmark.asset))
        .groupBy("crisis_name")
        .agg(
            F.max(F.when(F.col("asset") == profile.candidate.asset, shown)).alias("candidate_pct"),
            F.max(F.when(F.col("asset") == profile.benchmark.asset, shown)).alias("benchmark_pct"),
        )
        .dropna()
    )
    return pair.withColumn("verdict", _protection(F.col("candidate_pct"), F.col("benchmark_pct")))


def pair_of(profile: Profile, rows: Column, mean: Column) -> list[Column]:
    """Aggregates over one row per asset: candidate rows and mean, benchmark mean (0 without its rows)."""
    mine, theirs = F.col("asset") == profile.candidate.asset, F.col("asset") == profile.benchmark.asset
    found = F.coalesce(F.max(F.when(theirs, rows)), F.lit(0)) > 0
    return [
        F.coalesce(F.max(F.when(mine, rows)), F.lit(0)).alias("_candidate_rows"),
        F.max(F.when(mine, mean)).alias("candidate_mean"),
        F.when(found, F.max(F.when(theirs, mean))).otherwise(0.0).alias("benchmark_mean"),
    ]


def _means(rows: DataFrame, profile: Profile, *keys: str) -> DataFrame:
    """Rows and mean return of candidate and benchmark."""
    pair = rows.where(F.col("asset").isin(profile.candidate.asset, profile.benchmark.asset))
    return pair.groupBy(*keys, "asset").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("daily_return").alias("mean_daily_return")
    )


def overall_text(means: DataFrame, profile: Profile) -> DataFrame:
    """Verdict from one row of ``pair_of``; none without candidate rows."""
    c, b = F.col("candidate_mean"), F.col("benchmark_mean")
    status = F.when((c > 0) & (c > b), "good").when(c > b, "medium").otherwise("failed")
    body = F.concat(
        F.lit("Mean daily return = "), V.percent_text(c, 4),
        F.lit(f" ({profile.benchmark.label} = "), V.percent_text(b, 4), F.lit("), status "), status,
    )
    return means.where("_candidate_rows > 0").select(
        F.lit("overall").alias("category"),
        F.lit("Candidate in all crises").alias("title"),
        body.alias("body"),
        status.alias("status"),
    )


def overall_verdict(labelled: DataFrame, profile: Profile) -> DataFrame:
    """Mean crisis returns of candidate and benchmark with a verdict; no row without the candidate."""
    means = _means(labelled.where(is_crisis()), profile)
    return overall_text(means.agg(*pair_of(profile, F.col("rows"), F.col("mean_daily_return"))), profile)


def event_texts(summary: DataFrame, profile: Profile) -> DataFrame:
    """Verdict per event from ``event_summary``; none without candidate rows."""
    pair = pair_of(profile, F.col("rows"), F.col("mean_daily_return"))
    means = summary.groupBy("crisis_name").agg(*pair).where("_candidate_rows > 0")
    c, b = F.col("candidate_mean"), F.col("benchmark_mean")
    status = _protection(c, b)
    body = F.concat(
        F.lit("Candidate "), V.percent_text(c, 4, signed=True),
        F.lit(f", {profile.benchmark.label} "), V.percent_text(b, 4, signed=True),
        F.lit(" per day: "), status,
    )
    return means.select(
        F.lit("crisis_event").alias("category"),
        F.col("crisis_name").alias("title"),
        body.alias("body"),
        status.alias("status"),
    )


def event_verdicts(labelled: DataFrame, events: Iterable[Event], profile: Profile) -> DataFrame:
    """Verdict per event in which the candidate has rows; without benchmark rows its mean counts as 0."""
    pair = labelled.where(F.col("asset").isin(profile.candidate.asset, profile.benchmark.asset))
    return event_texts(_means(in_events(pair, events), profile, "crisis_name"), profile)


def rank_insight(ranking: DataFrame, profile: Profile) -> DataFrame:
    """Position of the candidate in the score ranking; good up to rank 5."""
    places = ranking.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("asset") == profile.candidate.asset, F.col("rank"))).alias("place"),
        F.max(F.when(F.col("asset") == profile.candidate.asset, F.col("safe_haven_score"))).alias("score"),
    ).where("place IS NOT NULL")
    return places.select(
        F.lit("safe_haven_rank").alias("category"),
        F.lit("Composite score of six dimensions").alias("title"),
        F.format_string(
            "Candidate ranks #%d of %d assets (score = %.3f)", "place", "n", F.bround("score", 3)
        ).alias("body"),
        F.when(F.col("place") <= 5, "good").otherwise("medium").alias("status"),
    )


def insights(labelled: DataFrame, ranking: DataFrame, profile: Profile) -> DataFrame:
    """All insight rows and the closing conclusion."""
    events = event_verdicts(labelled, profile.events, profile)
    return all_insights(overall_verdict(labelled, profile), events, ranking, profile)


def all_insights(overall: DataFrame, events: DataFrame, ranking: DataFrame, profile: Profile) -> DataFrame:
    """Given verdicts, the candidate's rank and the closing conclusion."""
    conclusion = ranking.sparkSession.createDataFrame(
        [
            (
                "conclusion",
                "A conditional safe haven",
                "Protection holds in some crises and fails in others",
                "conditional",
            )
        ],
        "category string, title string, body string, status string",
    )
    return overall.unionByName(events).unionByName(rank_insight(ranking, profile)).unionByName(conclusion)
