"""Medians of groups: against the plain definition, and one group far larger than the memory given."""

import math
import os
import random
import statistics
import subprocess
import sys

import pytest

from stormglass.functions.medians import medians

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("numbers, median", [([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 3.0], 2.5), ([], None)])
def test_whole_table(spark, numbers, median):
    df = spark.createDataFrame([(v,) for v in [*numbers, None]], "v double")
    assert [r["v"] for r in medians(df, [], ["v"]).collect()] == [median]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert [tuple(r) for r in medians(df, [], ["v"]).collect()] == [(None,)]
    assert medians(df, ["k"], ["v"]).collect() == []


def plain(rows, key, column):
    got = [r[column] for r in rows if r[0] == key and r[column] is not None]
    return statistics.median(got) if got else None


@pytest.mark.parametrize("held", [1, 40, 100_000])
def test_groups_against_the_plain_median(spark, held):
    """Hot key with a third of all rows, null key, ties around the middle, a key without values, NaN aside."""
    rng = random.Random(held)
    kinds = {
        "hot": lambda: rng.gauss(0, 1),
        None: lambda: rng.choice([1.0, 2.0]),
        "tied": lambda: rng.choice([0.0, 0.0, 0.0, rng.random(), -rng.random()]),
        "null": lambda: None,
        "steps": lambda: float(rng.randrange(60)) ** 3,
    }
    rows = [
        (key, make(), rng.choice([None, 5.0, rng.random()]))
        for key, make in kinds.items()
        for _ in range(1500 if key == "hot" else rng.randrange(300, 500))
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(7)
    got = {r["k"]: (r["a"], r["b"]) for r in medians(df, ["k"], ["a", "b"], held=held).collect()}
    assert got == {key: (plain(rows, key, 1), plain(rows, key, 2)) for key in kinds}


def test_even_groups_split_between_two_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + [3] * 50], "v double")
    assert medians(df, [], ["v"], held=2).first()["v"] == 2.0


def test_nan_is_greater_than_any_number(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, float("nan"), 2.0] * 30 + [float("nan")] * 60], "v double")
    assert math.isnan(medians(df, [], ["v"], held=5).first()["v"])
    low = spark.createDataFrame([(v,) for v in [1.0, 2.0, float("nan")] * 30], "v double")
    assert medians(low, [], ["v"], held=5).first()["v"] == 2.0


LARGE = """
from pyspark.sql import SparkSession, functions as F
from stormglass.functions.medians import medians
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.warehouse.dir", __import__("sys").argv[1]).config("spark.log.level", "FATAL").getOrCreate())
n = 10_000_001
rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
print("median", medians(rows, [], ["v"]).first()["v"])
"""


def test_one_group_of_ten_million_values_in_a_gigabyte(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", LARGE, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=300,
        env={**os.environ, "PYTHONPATH": ROOT},
    )
    assert "median 5000000.0" in done.stdout, done.stderr[-2000:]
