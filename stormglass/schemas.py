"""Explicit schemas of the landed and cleaned tables."""

from pyspark.sql import types as T

PRICE_VALUES = ("open", "high", "low", "close", "adj_close")

# Header of a landed price file, all text: bad cells become null in the clean step, not scan errors.
RAW_PRICE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "Date", "Open", "High", "Low", "Close", "Adj Close", "Volume", "asset", "group", "source",
        )
    ]
)
RAW_PRICE_REQUIRED = ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")

RAW_MACRO = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("Date", "Value", "variable", "source")]
)
RAW_MACRO_REQUIRED = ("Date", "Value", "variable", "source")

PRICES = T.StructType(
    [
        T.StructField("date", T.DateType()),
        *[T.StructField(name, T.DoubleType()) for name in PRICE_VALUES],
        T.StructField("volume", T.DoubleType()),
        T.StructField("asset", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

MACRO = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("start_date", T.DateType(), False),
        T.StructField("end_date", T.DateType(), False),
        T.StructField("description", T.StringType()),
    ]
)
