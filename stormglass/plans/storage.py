"""Storage comparison of one table written as CSV and as Parquet."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.staging import fresh_path
from stormglass.sources.sinks import write_csv, write_parquet, write_partitioned


def folder_mb(spark: SparkSession, path: str) -> float:
    """Size from the file system's own listing, without reading the files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength() / (1024 * 1024)


def _timed(action) -> float:
    begin = time.perf_counter()
    action()
    return round(time.perf_counter() - begin, 4)


def storage_profile(df: DataFrame, partitioned: str, parquet: str | None = None) -> DataFrame:
    """Metric/value rows: read seconds, sizes, partitioned write seconds, status.

    Writes the table to ``partitioned`` by group, asset and year. ``parquet`` names files it already
    has. Reads go through all columns with the no-op sink, so neither format can skip any.
    """
    spark = df.sparkSession
    csv = fresh_path(spark, "profile-csv")
    write_csv(df, csv)
    if parquet is None:
        parquet = fresh_path(spark, "profile-parquet")
        write_parquet(df, parquet)

    def drain(scan: DataFrame):
        scan.write.format("noop").mode("overwrite").save()

    csv_seconds = _timed(lambda: drain(spark.read.schema(df.schema).option("header", True).csv(csv)))
    stored = spark.read.schema(df.schema).parquet(parquet)
    parquet_seconds = _timed(lambda: drain(stored))
    dated = stored.withColumn("year", F.year("date"))
    write_seconds = _timed(lambda: write_partitioned(dated, partitioned))
    csv_mb, parquet_mb = folder_mb(spark, csv), folder_mb(spark, parquet)
    rows = [
        ("read_csv_sec", f"{csv_seconds:.4f}"),
        ("read_parquet_sec", f"{parquet_seconds:.4f}"),
        ("master_csv_size_mb", f"{csv_mb:.4f}"),
        ("master_parquet_size_mb", f"{parquet_mb:.4f}"),
        ("compression_ratio", f"{csv_mb / parquet_mb:.2f}" if parquet_mb else "0"),
        ("spark_status", "OK"),
        ("spark_partition_write_sec", f"{write_seconds:.4f}"),
    ]
    return spark.createDataFrame(rows, "metric string, value string")
