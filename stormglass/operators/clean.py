"""Landed rows to clean long tables with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions import rolling as R
from stormglass.functions import values as V
from stormglass.schemas import PRICE_VALUES
from stormglass.sources.landing import last_copy

PRICE_NAMES = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}
MACRO_NAMES = {"Date": "date", "Value": "value"}


def clean_prices(raw: DataFrame, sequence: list[Column] | None = None) -> DataFrame:
    """One row per (asset, date): last copy kept, prices filled forward, missing volume 0."""
    order = sequence or [F.col("_seq")]
    named = raw.withColumnsRenamed(PRICE_NAMES).withColumn("date", V.day(F.col("date")))
    keyed = last_copy(named.dropna(subset=["date", "asset"]), ["asset", "date"], order)
    numbers = keyed.withColumns({c: V.number(F.col(c)) for c in (*PRICE_VALUES, "volume")})
    w = R.by_asset()
    return numbers.select(
        "date",
        *[R.forward_fill(F.col(c), w).alias(c) for c in PRICE_VALUES],
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        "asset",
        *[c for c in ("group", "source") if c in numbers.columns],
    )


def clean_macro(raw: DataFrame, sequence: list[Column] | None = None) -> DataFrame:
    """One row per (variable, date): last copy kept, values filled forward."""
    order = sequence or [F.col("_seq")]
    named = raw.withColumnsRenamed(MACRO_NAMES).withColumn("date", V.day(F.col("date")))
    keyed = last_copy(named.dropna(subset=["date", "variable"]), ["variable", "date"], order)
    number = V.number(F.nullif(F.trim(F.col("value").cast("string")), F.lit(".")))
    numbers = keyed.withColumn("value", number)
    w = Window.partitionBy("variable").orderBy("date")
    return numbers.select("date", "variable", R.forward_fill(F.col("value"), w).alias("value"))


def macro_wide(macro: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """One row per date, one column per variable; dates without any value are left out."""
    wide = macro.groupBy("date").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )
    return wide.dropna(how="all", subset=list(variables))
