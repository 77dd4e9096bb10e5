"""Interval join on instants against the plain definition."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sqlcheck import SQL
from stormglass.operators import intervals as I
from stormglass.operators.intervals import interval_join, interval_totals, pieces
from stormglass.plans.catalog import QUERIES
from tests.check_sql import compare

MAKE = {
    "bigint": lambda n: n - 5000,
    "int": lambda n: n,
    "date": lambda n: date(1960, 1, 1) + timedelta(days=n),
    "timestamp_ntz": lambda n: datetime(1999, 3, 28) + timedelta(microseconds=n * 12_345_679),
}


def rows_of(kind, seed=5):
    """Hot instants, repeated rows, nulls, open ends, empty and backward intervals, ends far outside."""
    rng, make = random.Random(seed), MAKE[kind]
    points = [(i, rng.choice("ab"), make(777 if i % 3 == 0 else rng.randrange(10_000))) for i in range(400)]
    points += [(400, "a", None), points[0]]
    intervals = []
    for i in range(150):
        a, length = rng.randrange(12_000), int(2 ** rng.uniform(0, 13)) - 1
        ends = [make(max(a - 1000, 0)), make(max(a - 1000, 0) + length)]
        if i % 10 == 0:
            ends[rng.randrange(2)] = None
        if i % 17 == 0 and None not in ends:
            ends.reverse()
        intervals.append((i, rng.choice("ab"), *ends))
    intervals += [(150, "b", None, None), (151, "a", make(777), make(777)), intervals[3]]
    return points, intervals


def frames(spark, kind, points, intervals):
    return (
        spark.createDataFrame(points, f"p int, k string, at {kind}").repartition(5),
        spark.createDataFrame(intervals, f"i int, k string, a {kind}, b {kind}"),
    )


def plain(points, intervals, keyed):
    return sorted(
        (p, i)
        for p, pk, at in points
        for i, ik, a, b in intervals
        if at is not None and (not keyed or pk == ik) and (a is None or a <= at) and (b is None or at <= b)
    )


@pytest.mark.parametrize("kind", sorted(MAKE))
def test_against_all_pairs(spark, kind):
    points, intervals = rows_of(kind)
    left, right = frames(spark, kind, points, intervals)
    keyed = interval_join(left, right, "at", "a", "b", on=["k"])
    assert keyed.columns == ["p", "k", "at", "i", "a", "b"]
    assert sorted((r["p"], r["i"]) for r in keyed.collect()) == plain(points, intervals, True)
    free = interval_join(left, right.drop("k"), "at", "a", "b")
    assert sorted((r["p"], r["i"]) for r in free.collect()) == plain(points, intervals, False)


def test_pieces_are_few_and_apart(spark):
    _, intervals = rows_of("bigint")
    right = spark.createDataFrame([(r[0], r[2], r[3]) for r in intervals[:150]], "i int, a bigint, b bigint")
    per = {}
    for r in pieces(right, "a", "b", 0, 2**60).collect():
        size = 2 ** r["_level"]
        per.setdefault(r["i"], []).append((r["_cell"] * size, (r["_cell"] + 1) * size))
    assert max(map(len, per.values())) <= 14
    for spans in per.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_sides_and_wrong_types(spark):
    points, intervals = rows_of("bigint")
    left, right = frames(spark, "bigint", points, intervals)
    right = right.drop("k")
    assert interval_join(left.limit(0), right, "at", "a", "b").collect() == []
    assert interval_join(left, right.limit(0), "at", "a", "b").collect() == []
    with pytest.raises(TypeError):
        interval_join(left, right.withColumn("b", F.col("b").cast("double")), "at", "a", "b")
    with pytest.raises(TypeError):
        interval_join(left.withColumn("at", F.col("at").cast("string")), right, "at", "a", "b")
    with pytest.raises(ValueError):
        interval_join(left, right.withColumnRenamed("i", "p"), "at", "a", "b")


def test_no_nested_loop(spark):
    points, intervals = rows_of("date")
    left, right = frames(spark, "date", points, intervals)
    text = interval_join(left, right.drop("k"), "at", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def totals(left, right):
    sums, maxima = {"n": F.lit(1), "weight": F.col("p")}, {"most": F.col("p")}
    return interval_totals(left, right, "at", "a", "b", sums, maxima)


def plain_totals(points, intervals):
    out = []
    for i, _, a, b in intervals:
        inside = [p for p, _, at in points if at is not None and (a is None or a <= at) and (b is None or at <= b)]
        if inside:
            out.append((i, len(inside), sum(inside), max(inside)))
    return sorted(out)


@pytest.mark.parametrize("kind", sorted(MAKE))
@pytest.mark.parametrize("low", [2, 8])
def test_totals_against_all_pairs(spark, kind, low, monkeypatch):
    monkeypatch.setattr(I, "LOW", low)
    points, intervals = rows_of(kind)
    left, right = frames(spark, kind, points, intervals)
    got = totals(left, right)
    assert got.columns == ["i", "k", "a", "b", "n", "weight", "most"]
    assert sorted((r.i, r.n, r.weight, r.most) for r in got.collect()) == plain_totals(points, intervals)


def test_totals_of_few_rows_and_wrong_types(spark):
    points, intervals = rows_of("bigint")
    left, right = frames(spark, "bigint", points, intervals)
    assert totals(left.limit(0), right).collect() == []
    assert totals(left, right.limit(0)).collect() == []
    for n in (1, 2, 3):
        few, _ = frames(spark, "bigint", points[:n], intervals)
        assert sorted((r.i, r.n, r.weight, r.most) for r in totals(few, right).collect()) == plain_totals(points[:n], intervals)
    with pytest.raises(TypeError):
        totals(left, right.withColumn("b", F.col("b").cast("double")))


def events(spark, folder, rows):
    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    rows.toDF(*[k.split()[0] for k in kinds.split(", ")]).select(
        *[F.col(k.split()[0]).cast(k.split()[1]) for k in kinds.split(", ")]
    ).write.parquet(f"{folder}/parts")
    spark.read.parquet(f"{folder}/parts").coalesce(1).write.parquet(f"{folder}/tables/events.parquet")
    return f"{folder}/tables"


def test_query_on_missing_cells(spark, tmp_path):
    rng, rows = random.Random(8), []
    for i in range(300):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(20_000))
        user, value = rng.choice([None, 1, 2, 3]), rng.choice([None, -3.0, 0.5, 20.25, 90.0])
        rows.append((i, None if i % 20 == 0 else ts, user, rng.choice(["error", "view"]), value))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    folder = events(spark, tmp_path, spark.createDataFrame(rows, schema))
    duck = connect_folder(folder)
    assert compare(QUERIES["instants_in_intervals"](spark, folder), duck, SQL["instants_in_intervals"]) == ""


def connect_folder(folder):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return duck


def test_query_lays_out_no_pairs(spark, tmp_path):
    """Every user's only error stays open: some 8 * 10 ** 10 pairs."""
    n = 400_000
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(n).select(
        "id", start + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)")), "id", F.lit("error"), F.lit(1.0)
    )
    folder = events(spark, tmp_path, rows)
    got = QUERIES["instants_in_intervals"](spark, folder)
    row = got.agg(F.count("*"), F.sum("events"), F.sum("value"), F.min("last_event_id")).first()
    assert tuple(row) == (n, n * (n + 1) // 2, n * (n + 1) / 2, n - 1)
