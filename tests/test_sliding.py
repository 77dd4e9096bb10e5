"""Frames merged from block summaries: as Spark's sliding frames give them, at a cost that does not grow."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stormglass.functions.sliding import Frame, direct, with_frames

KINDS = ("mean", "deviation", "highest", "correlation")


def frames(n):
    out = {f"{kind}_{n}": Frame(kind, n, "x", "y") for kind in KINDS}
    return {**out, f"loose_{n}": Frame("deviation", n, "x", at_least=min(2, n))}


def series(spark):
    """Gaps, a constant stretch, large values with small moves, one row, no value at all."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        rows.append(("gaps", i, rng.choice([None, rng.random()]) if i % 9 == 0 else rng.gauss(0, 1), rng.gauss(0, 1)))
        rows.append(("flat", i, 0.1 if 40 < i < 260 else rng.random(), rng.random()))
        rows.append(("high", i, 1e6 + rng.random(), None if i == 200 else 1e6 + rng.random()))
        rows.append((None, i, None, 1.0))
    rows.append(("one", 7, 2.0, 3.0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, date int, x double, y double").repartition(5)


@pytest.mark.parametrize("lengths", [(1, 2, 3), (21, 63), (399, 400, 401)])
def test_equal_to_the_sliding_frame(spark, lengths):
    df = series(spark)
    wanted = {name: f for n in lengths for name, f in frames(n).items()}
    w = Window.partitionBy("k").orderBy("date")
    slow = df.withColumns({name: direct(f, w) for name, f in wanted.items()})
    order = lambda r: (str(r["k"]), r["date"])
    left = sorted(with_frames(df, ["k"], wanted, direct_up_to=0).collect(), key=order)
    right = sorted(slow.collect(), key=order)
    assert len(left) == len(right) == 1601
    for a, b in zip(left, right):
        for name in wanted:
            if b[name] is None:
                assert a[name] is None, (name, a, b)
            else:
                assert a[name] == pytest.approx(b[name], rel=1e-8, abs=1e-8), (name, a["k"], a["date"])


def test_flat_frames_have_no_spread(spark):
    flat = series(spark).where("k = 'flat'")
    got = with_frames(flat, ["k"], frames(100), direct_up_to=0).where("date between 140 and 259").collect()
    assert {r["deviation_100"] for r in got} == {0.0} and {r["correlation_100"] for r in got} == {None}


def test_empty_table(spark):
    assert with_frames(series(spark).limit(0), ["k"], frames(200)).collect() == []


def test_cost_does_not_grow_with_the_frame(spark):
    df = spark.range(200_000).select((F.col("id") % 4).alias("k"), F.col("id").alias("date"), F.rand(1).alias("x"), F.rand(2).alias("y"))

    def seconds(n):
        started = time.monotonic()
        with_frames(df, ["k"], frames(n), direct_up_to=0).write.format("noop").mode("overwrite").save()
        return time.monotonic() - started

    seconds(21)
    short = min(seconds(21), seconds(21))
    assert seconds(2000) < 2 * short + 1


def test_one_shuffle_serves_all_lengths(spark):
    plan = with_frames(series(spark), ["k"], {**frames(200), **frames(300)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k") == 1
