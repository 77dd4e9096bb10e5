"""Scans of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass.functions import values as V


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_table(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """``base``.parquet if it is there, else ``base``.csv; dates are parsed, bad ones become null."""
    if path_exists(spark, f"{base}.parquet"):
        df = spark.read.schema(schema).parquet(f"{base}.parquet")
        return df.withColumn("date", V.day(F.col("date")))
    if not path_exists(spark, f"{base}.csv"):
        raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv exists")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.read.schema(text).option("header", True).csv(f"{base}.csv")
    return df.select(
        *[
            V.day(F.col(f"`{f.name}`")).alias(f.name)
            if f.name == "date"
            else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def scan_panel(spark: SparkSession, path: str) -> DataFrame:
    """Panel with its date column named ``date`` and with year and month."""
    return with_calendar(spark.read.parquet(path))


def with_calendar(df: DataFrame) -> DataFrame:
    if "Date" in df.columns and "date" not in df.columns:
        df = df.withColumnRenamed("Date", "date")
    df = df.withColumn("date", V.day(F.col("date")))
    return df.withColumns({"year": F.year("date"), "month": F.month("date")})
