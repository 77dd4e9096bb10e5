"""Statistics recomputed for a chosen date range, rolling window and asset list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import rolling as R
from stormglass.functions import values as V
from stormglass.functions.medians import medians
from stormglass.functions.sliding import Frame, with_frames
from stormglass.functions.staging import staged
from stormglass.operators.stats import asset_regime_mean, return_ranking


def filter_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Closed date range."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_assets(df: DataFrame, assets: list[str]) -> DataFrame:
    """Listed assets; an empty list gives no rows."""
    return df.where(F.col("asset").isin(assets) if assets else F.lit(False))


def data_bounds(df: DataFrame, years: int = 5) -> DataFrame:
    """First and last date; without dates the last ``years`` years up to today."""
    today = F.current_date()
    return df.agg(
        F.coalesce(F.min("date"), F.add_months(today, -12 * years)).alias("first_date"),
        F.coalesce(F.max("date"), today).alias("last_date"),
    )


def asset_list(df: DataFrame, profile: Profile) -> DataFrame:
    """Sorted assets, marked where they belong to the default choice."""
    default = F.col("asset").isin(list(profile.default_assets))
    return (
        df.select("asset").where(F.col("asset").isNotNull()).distinct()
        .withColumn("is_default", default)
        .orderBy("asset")
    )


def period_panel(panel: DataFrame, start: str, end: str, window: int) -> DataFrame:
    """Return, cumulative return, drawdown and volatility as if the range were all there is.

    The range is cut first, so the first row has no return and the peak starts anew. The price is the
    adjusted close alone; the base is the first price present, and a base of 0 gives null.
    """
    w = R.by_asset()
    price = F.col("price")
    cut = filter_dates(panel, start, end).withColumn("price", V.number(F.col("adj_close")))
    carried = cut.withColumn("_filled", R.forward_fill(price, w))
    base = F.first(price, ignorenulls=True).over(R.whole(w))
    measured = carried.withColumns(
        {
            "period_return": R.change(F.col("_filled"), w),
            "period_cum": V.ratio(price, base) - 1,
            "period_drawdown": R.drawdown(price, w),
        }
    )
    volatility = Frame("deviation", window, "period_return", at_least=max(5, window // 3))
    return with_frames(measured.drop("_filled"), ["asset"], {"period_volatility": volatility})


def rebased(period: DataFrame) -> DataFrame:
    """Price as percent of the first price present in the range."""
    return period.select("asset", "date", ((F.col("period_cum") + 1) * 100).alias("rebased"))


def period_regime_means(period: DataFrame) -> DataFrame:
    return asset_regime_mean(period.where(F.col("period_return").isNotNull()), "period_return")


def period_return_ranking(period: DataFrame) -> DataFrame:
    return return_ranking(period.where(F.col("period_return").isNotNull()), "period_return")


def period_risk(period: DataFrame) -> DataFrame:
    return (
        period.where(F.col("period_return").isNotNull())
        .groupBy("asset")
        .agg(
            F.avg("period_volatility").alias("rolling_volatility"),
            F.avg("period_drawdown").alias("drawdown"),
            F.min("period_drawdown").alias("max_drawdown"),
            F.avg("period_return").alias("mean_return"),
        )
    )


def quadrants(risk: DataFrame, profile: Profile) -> DataFrame:
    """Assets against the medians of volatility and drawdown."""
    percent = staged(
        risk.select(
            "asset",
            V.class_of(F.col("asset"), profile.classes, profile.default_class).alias("class"),
            (F.col("rolling_volatility") * 100).alias("vol_pct"),
            (F.col("drawdown") * 100).alias("dd_pct"),
        ),
        "risk",
    )
    middle = medians(percent, [], ["vol_pct", "dd_pct"])
    placed = percent.withColumns(
        {
            "vol_median": middle.select("vol_pct").scalar(),
            "dd_median": middle.select("dd_pct").scalar(),
        }
    )
    return placed.withColumns(
        {
            "marker_size": F.greatest(F.abs("vol_pct"), F.lit(0.05)) * 20,
            "quadrant": _quadrant(),
        }
    )


def _quadrant() -> Column:
    calm = F.col("vol_pct") <= F.col("vol_median")
    shallow = F.col("dd_pct") >= F.col("dd_median")
    return (
        F.when(calm & shallow, "calm_shallow")
        .when(calm, "calm_deep")
        .when(shallow, "volatile_shallow")
        .otherwise("volatile_deep")
    )


def overview(period: DataFrame, ranking: DataFrame, profile: Profile) -> DataFrame:
    """Assets, rows, months covered and the candidate's place in the ranking."""
    place = ranking.agg(
        F.max(F.when(F.col("asset") == profile.candidate.asset, F.col("rank"))).alias("place"),
        F.count(F.lit(1)).alias("n"),
    )
    found = place.select(F.struct("place", "n")).scalar()
    return period.agg(
        F.count_distinct("asset").alias("assets"),
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min("date"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("date"), "yyyy-MM").alias("last_month"),
    ).withColumns({"candidate_rank": found.getField("place"), "ranked_assets": found.getField("n")})


def insight_facts(
    ranking: DataFrame, regime_means: DataFrame, risk: DataFrame, profile: Profile
) -> DataFrame:
    """The numbers behind the insight cards, one row per fact."""
    asset = F.col("asset")

    def of(series, column):
        return F.max(F.when(asset == series.asset, F.col(column)))

    ranked = ranking.agg(
        of(profile.candidate, "mean_crisis_return").alias("candidate_mean_return"),
        of(profile.candidate, "rank").cast("double").alias("candidate_rank"),
        F.count(F.lit(1)).cast("double").alias("ranked_assets"),
        F.count_if(F.col("mean_crisis_return") > 0).cast("double").alias("positive_assets"),
    )
    crisis = regime_means.where("regime = 'crisis'").agg(
        of(profile.candidate, "mean_return").alias("candidate_crisis_mean"),
        of(profile.benchmark, "mean_return").alias("benchmark_crisis_mean"),
    )
    volatility = risk.agg(
        of(profile.candidate, "rolling_volatility").alias("candidate_volatility"),
        of(profile.benchmark, "rolling_volatility").alias("benchmark_volatility"),
        of(profile.peers[-1], "rolling_volatility").alias("last_peer_volatility"),
    )
    facts = [f.unpivot([], f.columns, "fact", "value") for f in (ranked, crisis, volatility)]
    return facts[0].unionByName(facts[1]).unionByName(facts[2])


def shown(df: DataFrame, profile: Profile) -> DataFrame:
    """Assets under their display names."""
    return df.withColumn("asset", V.renamed(F.col("asset"), profile.display_names))


def classified(df: DataFrame, profile: Profile) -> DataFrame:
    return df.withColumn(
        "class", V.class_of(F.col("asset"), profile.classes, profile.default_class)
    )
