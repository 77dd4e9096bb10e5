"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.config import Profile


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("group", "asset", "year")) -> None:
    """Directory per partition value, one file each.

    Rows of one partition value meet in one task; with ``year`` among the columns that is at most the
    days of a year per asset.
    """
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Table bucketed by asset and sorted by date, for readers that window per asset again and again.

    They find each asset in one bucket and need no shuffle. Choose as many buckets as make each fit a
    task comfortably; one asset's series is bounded by the calendar, so no bucket can be dominated.
    """
    (
        df.write.mode("overwrite")
        .bucketBy(buckets, "asset")
        .sortBy("asset", "date")
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def analysis_columns(profile: Profile) -> list[str]:
    """Columns of the analysis panel, in order; those a table lacks are left out of the projection."""
    # Names and order of the inventory's panel, with the profile's labels.
    return [
        "date",
        "asset",
        "group",
        "open",
        "high",
        "low",
        "close",
        "adj_close",
        "volume",
        "daily_return",
        "log_return",
        "cumulative_return",
        "drawdown",
        profile.short_volatility,
        profile.medium_volatility,
        *profile.rolling_corr_columns,
        profile.stress_variable,
        profile.recession_variable,
        *profile.panel_aliases,
        "inflation_yoy",
        profile.stress_flag,
        "crisis_by_recession",
        profile.drawdown_flag,
        "final_crisis_label",
        profile.success,
        profile.benchmark_drawdown,
    ]


def analysis_panel(labelled: DataFrame, profile: Profile) -> DataFrame:
    present = set(labelled.columns)
    return labelled.select(*[F.col(f"`{c}`") for c in analysis_columns(profile) if c in present])


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def empty_file(spark: SparkSession, path: str) -> None:
    target, system = _target(spark, path)
    system.create(target).close()


def rename_files(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Another ending for the files of one folder."""
    target, system = _target(spark, folder)
    for status in system.listStatus(target):
        name = status.getPath().toString()
        if name.endswith(old):
            system.rename(status.getPath(), _target(spark, name[: -len(old)] + new)[0])
