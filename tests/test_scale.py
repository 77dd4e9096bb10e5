"""Skewed inputs, and work that must not depend on where rows lie."""

from collections import defaultdict
from datetime import date, timedelta

from pyspark.sql import functions as F

from stormglass.functions.ranking import with_position
from stormglass.operators import clean as CL
from stormglass.operators import quality as Q
from stormglass.sources.landing import last_copy


def skewed(spark, n=30000):
    """A third of all rows are copies of one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(n).select(
        F.concat(F.lit("A"), (key % 20).cast("string")).alias("asset"),
        F.date_add(F.lit(date(2020, 1, 1)), (key / 20).cast("int")).alias("date"),
        F.col("id").alias("seq"),
        (F.col("id") % 97).cast("double").alias("close"),
    ).repartition(12)


def test_hot_key_keeps_its_last_copy(spark):
    rows = skewed(spark)
    got = {(r["asset"], r["date"]): r["seq"] for r in last_copy(rows, ["asset", "date"], [F.col("seq")]).collect()}
    want = defaultdict(int)
    for r in rows.collect():
        want[r["asset"], r["date"]] = max(want[r["asset"], r["date"]], r["seq"])
    assert got == want


def test_cleaning_a_hot_asset(spark):
    rows = skewed(spark).select(
        "asset", "date", "seq", "close",
        *[F.col("close").alias(c) for c in ("open", "high", "low", "adj_close", "volume")],
    )
    clean = CL.clean_prices(rows, [F.col("seq")])
    assert clean.count() == rows.select("asset", "date").distinct().count()


def test_ranks_when_a_third_of_the_values_tie(spark):
    df = spark.range(9000).select(
        F.format_string("a%05d", "id").alias("asset"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("v"),
    ).repartition(10)
    ranked = with_position(df, [F.col("v").desc_nulls_last(), F.col("asset").asc()])
    spread = ranked.groupBy().agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(spread) == (1, 9000, 9000)
    tied = ranked.where("v = 1.0").orderBy("rank").collect()
    assert [r["asset"] for r in tied] == sorted(r["asset"] for r in tied)
    assert tied[-1]["rank"] - tied[0]["rank"] == len(tied) - 1


def test_one_large_file_among_small_ones(spark, tmp_path):
    header = "Date,Open,High,Low,Close,Adj Close,Volume"
    day = date(2000, 1, 1)
    big = [f"{day + timedelta(days=i % 4000)},1,1,1,1,,1" for i in range(20000)]
    (tmp_path / "big.csv").write_text("\n".join([header, *big]) + "\n")
    for i in range(5):
        (tmp_path / f"s{i}.csv").write_text(f"{header}\n2000-01-01,1,1,1,1,1,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        report = Q.price_file_report(spark, str(tmp_path), F.regexp_extract("file", "([a-z0-9]+).csv$", 1))
        rows = {r["file"]: (r["rows"], r["duplicate_rows"], r["na_cell_count"]) for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {"big": (20000, 16000, 20000), **{f"s{i}": (1, 0, 0) for i in range(5)}}
