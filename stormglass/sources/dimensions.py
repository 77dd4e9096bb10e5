"""Small dimensions built from the profile."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass import schemas as S
from stormglass.config import Event, Profile
from stormglass.functions.staging import broadcast_list


def asset_groups(spark: SparkSession, profile: Profile) -> DataFrame:
    """asset -> group; the first group that lists an asset wins."""
    rows = [
        (asset, group, i * 1000 + j, asset in profile.optional_assets)
        for i, (group, assets) in enumerate(profile.groups)
        for j, asset in enumerate(assets)
    ]
    listed = spark.createDataFrame(rows, "asset string, group string, position int, optional boolean")
    first = Window.partitionBy("asset").orderBy("position")
    unique = listed.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return broadcast_list(unique.select("asset", "group", "position", "optional"), len(rows))


def tag_rows(df: DataFrame, profile: Profile, source: str) -> DataFrame:
    """Add group and source to rows of known assets; others get a null group."""
    groups = asset_groups(df.sparkSession, profile).select("asset", "group")
    return df.drop("group", "source").join(groups, "asset", "left").withColumn("source", F.lit(source))


def event_table(spark: SparkSession, events: Iterable[Event]) -> DataFrame:
    rows = [(e.name, e.start_date, e.end_date, e.description) for e in events]
    return spark.createDataFrame(rows, S.EVENTS)
