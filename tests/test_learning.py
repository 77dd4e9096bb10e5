import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stormglass.operators import boosting as BO
from stormglass.operators import learning as M
from tests.helpers import days


def table(spark, n, gaps=True):
    rng = random.Random(3)
    rows = []
    for i, d in enumerate(days(n, date(2000, 1, 1))):
        a = rng.gauss(0, 1)
        rows.append((d, int(a + rng.gauss(0, 1) > 0), None if gaps and i % 7 == 0 else a, None, 2.0))
    return spark.createDataFrame(
        rows, "date date, label int, a_lag1 double, b_lag1 double, c_lag1 double"
    )


def test_published_fold_sizes(spark):
    sizes = M.fold_sizes(M.time_folds(table(spark, 2669))).orderBy("fold").collect()
    assert [r["test_size"] for r in sizes] == [444] * 5
    assert [r["train_size"] for r in sizes] == [449, 893, 1337, 1781, 2225]


def test_folds_never_look_ahead(spark):
    folds = M.time_folds(table(spark, 100))
    spans = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("t"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("s"),
    )
    rows = spans.collect()
    assert len(rows) == 3 and all(r["t"] < r["s"] for r in rows)


def test_imputation_and_scaling(spark):
    blocks = M.time_blocks(table(spark, 120))
    filled = M.imputed(blocks)
    assert filled.where("a_lag1 IS NULL OR b_lag1 IS NULL").count() == 0
    assert filled.agg(F.max(F.abs("b_lag1"))).first()[0] == 0.0
    train = M.standardized(blocks).where("role = 'train'").groupBy("fold")
    for r in train.agg(F.avg("a_lag1").alias("m"), F.stddev_pop("a_lag1").alias("s"),
                       F.max(F.abs("c_lag1")).alias("c")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1) and r["c"] == 0.0


def _plain_folds(rows):
    """(fold, role, rows) by slicing the sorted list."""
    n = len(rows)
    k = min(5, max(2, n // 30))
    size = n // (k + 1)
    for fold in range(1, k + 1):
        start = n - (k - fold + 1) * size
        yield fold, rows[:start], rows[start : start + size]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 61, 120, 200])
def test_parameters_from_blocks_equal_those_of_plain_folds(spark, n):
    rng = random.Random(n)
    late = (n * 2) // 3  # "late" has no value in the first folds, "tied" has few values, "flat" one that is not binary
    rows = [
        (d, i % 2, rng.gauss(1e6, 1e-3) if i % 5 else None, rng.choice([-1.0, 0.0, 0.5, None]), 0.1 if i % 3 else None,
         rng.random() if i >= late else None)
        for i, d in enumerate(days(n, date(2000, 1, 1)))
    ]
    data = spark.createDataFrame(
        rows, "date date, label int, wide_lag1 double, tied_lag1 double, flat_lag1 double, late_lag1 double"
    )
    blocks = M.time_blocks(data)
    names = M.feature_names(data)
    got = {(r["fold"], r["role"], r["date"]): [r[c] for c in names] for r in M.imputed(blocks).collect()}
    scaled = {(r["fold"], r["role"], r["date"]): [r[c] for c in names] for r in M.standardized(blocks).collect()}
    want, want_scaled = {}, {}
    for fold, train, test in _plain_folds(rows):
        for j in range(len(names)):
            known = [r[2 + j] for r in train if r[2 + j] is not None]
            fill = float(np.median(known)) if known else 0.0
            cells = [fill if r[2 + j] is None else r[2 + j] for r in train]
            flat = len(set(cells)) < 2
            mean, spread = (cells[0], 1.0) if flat and cells else (np.mean(cells or [0.0]), np.std(cells or [0.0]) or 1.0)
            for role, part in (("train", train), ("test", test)):
                for r in part:
                    cell = fill if r[2 + j] is None else r[2 + j]
                    want.setdefault((fold, role, r[0]), []).append(cell)
                    want_scaled.setdefault((fold, role, r[0]), []).append((cell - mean) / spread)
    assert got.keys() == want.keys() == scaled.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-15), key
        assert scaled[key] == pytest.approx(want_scaled[key], rel=1e-5, abs=1e-6), key
        assert n < 61 or scaled[key][2] == 0.0  # shorter tables begin with a fold without a known value


def test_fold_statistics_do_not_repeat_rows(spark):
    data = table(spark, 120)
    plan = M.standardized(M.time_blocks(data))._jdf.queryExecution().optimizedPlan().toString()
    grown = [line for line in plan.splitlines() if "Generate" in line]
    assert grown and all("sequence(1," in line or "inline" in line for line in grown)
    assert not any("a_lag1" in line and "explode" in line for line in grown)
    assert M.fold_parameters(M.time_blocks(data)).count() == 4 * 3  # 120 rows make four folds of three features


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, fold int, label int, prediction int, score double")


def test_metrics(spark):
    rows = [("m", 1, 1, 0, 0.2), ("m", 1, 1, 0, 0.4), ("m", 2, 1, 1, 0.9), ("m", 2, 0, 1, 0.9),
            ("m", 2, 0, 0, 0.1), ("m", 2, 1, 0, 0.4)]
    sizes = spark.createDataFrame([(1, 9, 2), (2, 11, 4)], "fold int, train_size long, test_size long")
    got = {r["fold"]: r for r in M.fold_metrics(predictions(spark, rows), sizes).collect()}
    assert (got[1]["precision"], got[1]["f1"], got[1]["roc_auc"]) == (0.0, 0.0, None)
    assert (got[2]["accuracy"], got[2]["precision"], got[2]["recall"]) == (0.5, 0.5, 0.5)
    assert got[2]["roc_auc"] == 0.625  # wins 1 + 0.5 + 1 + 0 of 4 pairs
    board = M.leaderboard(M.fold_metrics(predictions(spark, rows), sizes)).first()
    assert board["f1"] == 0.25 and board["f1_std"] == 0.25 and board["roc_auc"] == 0.625
    matrix = {r["truth"]: (r["pred_0"], r["pred_1"]) for r in M.confusion(predictions(spark, rows)).collect()}
    assert matrix == {"true_0": (1, 1), "true_1": (1, 1)}
    assert M.confusion_accuracy(M.confusion(predictions(spark, rows))).first()["accuracy"] == 0.5


def test_best_model_takes_the_first_of_equals(spark):
    board = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 0.7)], "model string, f1 double")
    assert M.best_model(board, ["z", "y", "x"]).first()["model"] == "z"
    assert M.best_model(board, ["x", "y", "z"]).first()["model"] == "y"


def test_gate(spark):
    assert M.enough_rows(table(spark, 49)).isEmpty()
    assert M.enough_rows(table(spark, 50)).count() == 50


def test_logistic_end_to_end(spark):
    data = table(spark, 240)
    folds = M.prepared_folds(data)
    found = M.cross_validated(folds, ["LogisticRegression"])
    assert found.count() == 5 * 40
    metrics = M.fold_metrics(found, M.fold_sizes(folds))
    assert all(r["accuracy"] > 0.5 for r in metrics.collect())
    weights = M.feature_importance(M.whole_sample(data), M.feature_names(data), "LogisticRegression")
    rows = {r["feature"]: r["importance"] for r in weights.collect()}
    assert rows["a_lag1"] > 0.1 and rows["c_lag1"] == 0.0 and not math.isnan(rows["b_lag1"])


@pytest.mark.parametrize("only", [0, 1])
def test_folds_of_one_class(spark, only):
    """A fold that has seen one class scores with it alone, whatever the model."""
    rows = [("train", i, only, float(i % 7)) for i in range(40)] + [("test", 40 + i, i % 2, float(i)) for i in range(6)]
    folds = spark.createDataFrame(rows, "role string, n int, label int, x_lag1 double")
    folds = folds.select(F.lit(1).alias("fold"), "role", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")).alias("date"), "label", "x_lag1")
    ready = VectorAssembler(inputCols=["x_lag1"], outputCol="features").transform(folds)
    for name in M.MODELS:
        got = M.cross_validated(ready, [name]).collect()
        assert len(got) == 6 and {r["prediction"] for r in got} == {only}, name
        assert all(0.0 <= r["score"] <= 1.0 and (r["score"] > 0.5) == bool(only) for r in got), name


def plain_boosting(x, label, cuts, settings, columns, rows):
    """Trees grown row by row: margins after every tree. ``columns`` and ``rows`` give what a tree may use."""
    margin = np.zeros(len(label))
    for turn in range(settings.trees):
        chance = 1 / (1 + np.exp(-margin))
        g, h = chance - label, chance * (1 - chance)
        taken = rows(turn)

        def leaf(at):
            return -settings.rate * g[at & taken].sum() / (h[at & taken].sum() + settings.l2)

        def grow(at, depth):
            best, inside = None, at & taken
            worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.l2)
            for f in columns(turn) if depth else ():
                for cut in cuts[f]:
                    left, right = inside & (x[:, f] < cut), inside & (x[:, f] >= cut)
                    if min(h[left].sum(), h[right].sum()) >= settings.least_weight:
                        gain = worth(left) + worth(right) - worth(inside)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, cut)
            if best is None:
                return np.where(at, leaf(at), 0.0)
            _, f, cut = best
            return grow(at & (x[:, f] < cut), depth - 1) + grow(at & (x[:, f] >= cut), depth - 1)

        margin = margin + grow(np.ones(len(label), bool), settings.depth)
    return margin


def test_boosting_against_plain_trees(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(160, 4)), 2)
    x[:, 3] = 1.0
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=160) * 0.4 > 0).astype(int)
    dates = days(160, date(2000, 1, 1))
    data = [(k, d, int(y), *map(float, v)) for k in (1, 3) for d, y, v in zip(dates, label, x)]
    df = spark.createDataFrame(data, "fold int, date date, label int, a double, b double, c double, d double").repartition(3)
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).select("fold", "date", "label", "features")
    settings = BO.Settings(trees=13, depth=3, rate=0.3, bins=32)
    model = BO.fit(df, settings)
    number = {r.date: r.n for r in df.select("date", F.xxhash64("date").alias("n")).collect()}
    numbers = np.array([number[d] for d in dates])
    cuts = [sorted({np.sort(x[:, f])[j * 160 // 32] for j in range(1, 32)}) for f in range(4)]
    want = plain_boosting(
        x, label, cuts, settings,
        lambda t: sorted(np.argsort(BO._mixed(np.arange(4), settings.seed + 7919 * (t + 1)))[:3]),
        lambda t: BO._mixed(numbers, settings.seed + 1 + t) < settings.share,
    )
    got = {(r.fold, r.date): r.score for r in BO.scores(df, model).collect()}
    for fold in (1, 3):
        assert np.allclose([got[fold, d] for d in dates], 1 / (1 + np.exp(-want)), atol=1e-6)
    share = model.importance(4)
    assert share[:, 3].tolist() == [0.0, 0.0] and np.allclose(share.sum(axis=1), 1)


def test_boosting_of_one_class_and_no_rows(spark):
    rows = [(1, d, 1, float(i)) for i, d in enumerate(days(40, date(2000, 1, 1)))]
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame(rows, "fold int, date date, label int, a double")
    )
    model = BO.fit(df, BO.Settings(trees=20, depth=2))
    assert min(r.score for r in BO.scores(df, model).collect()) > 0.6
    none = BO.fit(df.limit(0))
    assert none.trees == [] and BO.scores(df, none).count() == 0
