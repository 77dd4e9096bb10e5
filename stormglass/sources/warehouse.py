"""Daily panels and macro series derived from the order warehouse tables.

Every price is a fraction of exact integer sums, so results do not depend on the order of summation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.config import Event, Profile, Series
from stormglass.functions import values as V

WAREHOUSE = Profile(
    candidate=Series("ECONOMY", "econ"),
    benchmark=Series("STANDARD", "std"),
    peers=(Series("MEDIUM", "medium"), Series("SMALL", "small"), Series("PROMO", "promo")),
    macro_variables=("STRESS", "YIELD", "RECESSION", "PRICE_INDEX"),
    macro_aliases=(
        ("STRESS", "stress_level"),
        ("RECESSION", "recession_flag"),
        ("PRICE_INDEX", "cpi_level"),
        ("YIELD", "real_yield"),
    ),
    stress_variable="STRESS",
    stress_label="stress",
    stress_threshold=48.0,
    recession_variable="RECESSION",
    recession_threshold=1.0,
    price_index="PRICE_INDEX",
    drawdown_threshold=-0.30,
    events=(
        Event("ev1", date(1995, 3, 1), date(1995, 6, 30), "four months"),
        Event("ev2", date(1996, 1, 15), date(1997, 1, 14), "one year"),
        Event("ev3", date(1996, 12, 1), date(1997, 3, 31), "overlaps ev2"),
        Event("ev4", date(1999, 5, 1), date(1999, 5, 20), "short"),
        Event("ev5", date(2000, 2, 1), date(2001, 2, 1), "one year"),
        Event("ev6", date(2010, 1, 1), date(2010, 2, 1), "no data"),
    ),
    groups=(
        ("value", ("ECONOMY", "SMALL")),
        ("core", ("STANDARD", "MEDIUM")),
        ("growth", ("LARGE", "PROMO")),
    ),
    display_names=(("ECONOMY", "Economy line"), ("STANDARD", "Standard line")),
    classes=(
        ("candidate", ("ECONOMY", "Economy line")),
        ("bulk", ("MEDIUM", "LARGE")),
    ),
    default_class="other",
    default_assets=("ECONOMY", "STANDARD", "MEDIUM", "SMALL", "PROMO"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(lines: DataFrame, asset: F.Column, group: F.Column) -> DataFrame:
    quantity = F.col("l_quantity")
    bars = (
        lines.select(asset.alias("asset"), V.day(F.col("l_shipdate")).alias("date"), "l_quantity")
        .where(F.col("date").isNotNull())
        .groupBy("asset", "date")
        .agg(
            (50 + F.min(quantity)).alias("low"),
            (50 + F.max(quantity)).alias("high"),
            (50 + (F.min(quantity) + F.max(quantity)) / 2).alias("open"),
            (50 + F.sum(quantity) / F.count(F.lit(1))).alias("close"),
            F.sum(quantity).alias("volume"),
        )
    )
    adjusted = F.when(F.dayofmonth("date") % 7 != 0, F.col("close"))
    return bars.select(
        "date", "open", "high", "low", "close", adjusted.alias("adj_close"), "volume",
        "asset", group.alias("group"),
    )


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six assets, one per part type; the adjusted close is missing every seventh day of a month."""
    group = F.lit(None).cast("string")
    for name, members in WAREHOUSE.groups:
        group = F.when(F.col("asset").isin(list(members)), name).otherwise(group)
    return _daily(price_lines(spark, sf_dir), F.col("p_type"), group)


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per brand, five groups."""
    digits = F.regexp_extract("asset", "([0-9]+)$", 1).cast("int")
    group = F.concat(F.lit("g"), (digits % 5).cast("string"))
    return _daily(price_lines(spark, sf_dir), F.col("p_brand"), group)


def with_gaps(bars: DataFrame) -> DataFrame:
    """Both prices missing on the 13th of each month."""
    missing = F.dayofmonth("date") == 13
    return bars.withColumns(
        {c: F.when(~missing, F.col(c)) for c in ("close", "adj_close")}
    )


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily series with gaps and two at month starts: (date, variable, value).

    One scan: orders are reduced to days, and days to series, month starts being one more of them.
    """
    orders = table(spark, sf_dir, "orders").select(
        V.day(F.col("o_orderdate")).alias("date"), "o_totalprice", "o_orderpriority"
    )

    def top(priority):
        return F.max(F.when(F.col("o_orderpriority") == priority, F.col("o_totalprice")))

    per_day = (
        orders.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            (top("1-URGENT") / 10000).alias("stress"),
            (top("5-LOW") / 100000).alias("low_yield"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    series = per_day.select(
        F.inline(
            F.array(
                _point(F.col("date"), "STRESS", F.col("stress")),
                _point(F.col("date"), "YIELD", F.col("low_yield")),
                _point(F.trunc("date", "month"), "ORDERS", F.col("orders").cast("double")),
            )
        )
    )
    # Daily series have one value per day, so the sum only adds up the orders of a month.
    points = series.groupBy("date", "variable").agg(F.sum("value").alias("value"))
    date, value = F.col("date"), F.col("value")
    monthly = F.array(
        _point(date, "RECESSION", F.when(F.month("date") % 4 == 1, 1.0).otherwise(0.0)),
        _point(date, "PRICE_INDEX", 100 + value / 10.0),
    )
    kept = F.array(F.struct("date", "variable", "value"))
    return (
        points.where(value.isNotNull())
        .select(F.inline(F.when(F.col("variable") == "ORDERS", monthly).otherwise(kept)))
    )


def _point(date, variable, value):
    return F.struct(date.alias("date"), F.lit(variable).alias("variable"), value.alias("value"))
