"""Leakage-safe classification of the success target with Spark ML.

The training table holds one series' days, at most ``CALENDAR_DAYS`` rows, so windows over the whole
table are fine here. Imputation and scaling are fitted per training fold from one summary per time block, so no
statistic reads a row once per fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions import values as V
from stormglass.functions.staging import broadcast_days, broadcast_list, staged
from stormglass.operators import boosting
from stormglass.operators.calendar import with_macro_aliases

MIN_ROWS = 50
MAX_FOLDS = 5
MAX_ROLES = MAX_FOLDS * (MAX_FOLDS + 3) // 2
SEED = 42  # fixed value
MAX_DEPTH = 30  # the most levels that Spark's trees can have; the inventory's trees have no limit
MAX_BINS = 256  # split candidates per feature; the inventory's trees try every value


def raw_features(profile: Profile, present: Sequence[str]) -> list[str]:
    """Feature columns before the lag, those that the panel has."""
    # The names and order of the inventory's features.
    wanted = [
        "daily_return",
        f"{profile.benchmark.label}_daily_return",
        profile.short_volatility,
        profile.medium_volatility,
        "drawdown",
        profile.score_corr,
        dict(profile.macro_aliases)[profile.stress_variable],
        "recession_flag",
        "inflation_yoy",
        "fed_rate",
        "treasury_10y",
        "real_yield",
        "breakeven_inflation",
        "dollar_index",
    ]
    known = {*present, f"{profile.benchmark.label}_daily_return"}
    return [c for c in wanted if c in known]


def training_table(labelled: DataFrame, profile: Profile) -> DataFrame:
    """Candidate days with a target and the features of the candidate's day before.

    The lag runs over all candidate days before days without a target are dropped.
    """
    labelled = with_macro_aliases(
        labelled, tuple(pair for pair in profile.macro_aliases if pair[1] not in labelled.columns)
    )
    benchmark = f"{profile.benchmark.label}_daily_return"
    other = (
        labelled.where(F.col("asset") == profile.benchmark.asset)
        .groupBy("date")
        .agg(F.max("daily_return").alias(benchmark))
    )
    mine = labelled.where(F.col("asset") == profile.candidate.asset).join(
        broadcast_days(other), "date", "left"
    )
    names = raw_features(profile, labelled.columns)
    before = Window.orderBy("date")
    lagged = mine.select(
        "date",
        F.col(profile.success).cast("int").alias("label"),
        *[V.finite(F.lag(F.col(c).cast("double"), 1).over(before)).alias(f"{c}_lag1") for c in names],
    )
    return lagged.where(F.col("label").isNotNull())


def feature_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.endswith("_lag1")]


def enough_rows(table: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    """The table itself, or no rows if it is too short to learn from."""
    return table.where(table.agg(F.count(F.lit(1))).scalar() >= minimum)


def missing_report(table: DataFrame) -> DataFrame:
    """Empty values per feature before imputation."""
    names = feature_names(table)
    n = F.count(F.lit(1))
    row = table.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count_if(F.col(c).isNull()).alias("missing_count"),
                    V.ratio(F.count_if(F.col(c).isNull()), n).alias("missing_rate"),
                )
                for c in names
            ]
        ).alias("report")
    )
    return row.select(F.inline("report"))


def time_blocks(table: DataFrame) -> DataFrame:
    """Every row once with its time ``block`` and the number of ``folds``.

    Fold f trains on the blocks up to f and is tested on block f + 1. The blocks have equal length but for
    the first, which takes what division leaves; a table too short for that is one block.
    """
    order = Window.orderBy("date")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, k, size = F.col("_n"), F.col("folds"), F.col("_size")
    numbered = table.withColumns(
        {"_row": F.row_number().over(order), "_n": F.count(F.lit(1)).over(everything)}
    )
    folds = F.least(F.lit(MAX_FOLDS), F.greatest(F.lit(2), F.floor(n / 30))).cast("int")
    sized = numbered.withColumn("folds", folds).withColumn("_size", F.floor(n / (k + 1)).cast("int"))
    later = F.ceil(V.ratio(F.col("_row") - (n - k * size), size))
    block = F.coalesce(F.greatest(F.lit(0), later), F.lit(0)) + 1
    return sized.withColumn("block", block.cast("int")).drop("_row", "_n", "_size")


def fold_roles(blocks: DataFrame) -> DataFrame:
    """(fold, block, role) of every fold, at most ``MAX_ROLES`` rows."""
    fold = blocks.agg(F.max("folds").alias("k")).select(F.explode(F.sequence(F.lit(1), "k")).alias("fold"))
    pairs = fold.select("fold", F.explode(F.sequence(F.lit(1), F.col("fold") + 1)).alias("block"))
    return pairs.withColumn("role", F.when(F.col("block") <= F.col("fold"), "train").otherwise("test"))


def time_folds(table: DataFrame) -> DataFrame:
    """Rows once per fold they belong to, with their role: expanding train, then the next test block."""
    blocks = time_blocks(table)
    return blocks.join(broadcast_list(fold_roles(blocks), MAX_ROLES), "block").drop("block", "folds")


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_size"),
        F.count_if(F.col("role") == "test").alias("test_size"),
    )


def fold_medians(blocks: DataFrame) -> DataFrame:
    """(fold, feature, median) over the known values of each fold's training blocks; null without any.

    Every value is counted once per block it stands in; the counts of a fold are those of its blocks, and
    running counts in the order of the values find the middle of all folds in one sort per feature.
    """
    names, folds = feature_names(blocks), range(1, MAX_FOLDS + 1)
    counts = (
        blocks.unpivot(["block"], names, "feature", "value")
        .groupBy("feature", "value")
        .agg(*[F.count_if(F.col("value").isNotNull() & (F.col("block") <= f)).alias(f"n{f}") for f in folds])
    )
    order = Window.partitionBy("feature").orderBy("value")
    whole = Window.partitionBy("feature")
    running = counts.select(
        "feature",
        "value",
        *[F.sum(f"n{f}").over(order).alias(f"upto{f}") for f in folds],
        *[F.sum(f"n{f}").over(whole).alias(f"all{f}") for f in folds],
    )

    def at(f: int, rank: Column) -> Column:
        return F.min(F.when((F.col(f"all{f}") > 0) & (F.col(f"upto{f}") >= rank), F.col("value")))

    middles = running.groupBy("feature").agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("fold"),
                    (at(f, F.floor((F.col(f"all{f}") + 1) / 2)) / 2 + at(f, F.floor((F.col(f"all{f}") + 2) / 2)) / 2).alias("median"),
                )
                for f in folds
            ]
        ).alias("middles")
    )
    return middles.select("feature", F.inline("middles"))


def block_summaries(blocks: DataFrame) -> DataFrame:
    """(feature, parts): per block rows, known values, their mean, squares about it, least and greatest."""
    names = feature_names(blocks)
    row = blocks.groupBy("block").agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count(F.lit(1)).alias("rows"),
                    F.count(c).alias("n"),
                    F.avg(c).alias("mean"),
                    (F.var_pop(c) * F.count(c)).alias("squares"),
                    F.min(c).alias("least"),
                    F.max(c).alias("greatest"),
                )
                for c in names
            ]
        ).alias("features")
    )
    long = row.select("block", F.inline("features"))
    part = F.struct("block", "rows", "n", "mean", "squares", "least", "greatest")
    return long.groupBy("feature").agg(F.collect_list(part).alias("parts"))


def fold_parameters(blocks: DataFrame) -> DataFrame:
    """(fold, feature, fill, mean, spread): the training median and the moments of the imputed training values.

    The moments are merged from the summaries of the training blocks and of the filled cells, which all hold
    the median, so no training row is read again. A feature without any value is filled with 0; the spread
    of a constant feature is exactly 0.
    """
    joined = fold_medians(blocks).join(broadcast_list(block_summaries(blocks), len(feature_names(blocks))), "feature")
    mine = F.filter("parts", lambda p: p["block"] <= F.col("fold"))
    total = lambda array, value: F.aggregate(array, F.lit(0.0), lambda acc, p: acc + value(p))
    filled = joined.select("feature", "fold", F.coalesce("median", F.lit(0.0)).alias("fill"), mine.alias("parts"))
    empty = total("parts", lambda p: p["rows"] - p["n"])
    # A block without known values has no mean; it counts only among the filled cells.
    seen = F.filter("parts", lambda p: p["n"] > 0)
    rows = total("parts", lambda p: p["rows"])
    level = V.ratio(total(seen, lambda p: p["n"] * p["mean"]) + empty * F.col("fill"), rows)
    sized = filled.select("*", empty.alias("empty"), seen.alias("seen"), rows.alias("rows"), level.alias("level"))
    apart = lambda value: (value - F.col("level")) * (value - F.col("level"))
    squares = total("seen", lambda p: p["squares"] + p["n"] * apart(p["mean"])) + F.col("empty") * apart(F.col("fill"))
    flat = F.coalesce(
        F.array_min(F.transform("seen", lambda p: p["least"])) == F.array_max(F.transform("seen", lambda p: p["greatest"])),
        F.lit(True),
    )
    last = blocks.agg(F.max("folds")).scalar()
    return sized.where((F.col("rows") > 0) & (F.col("fold") <= last)).select(
        "fold",
        "feature",
        "fill",
        F.when(flat, F.col("fill")).otherwise(F.col("level")).alias("mean"),
        F.when(flat, 0.0).otherwise(F.sqrt(V.ratio(squares, F.col("rows")))).alias("spread"),
    )


def _laid_out(blocks: DataFrame, value: Callable[[str], Column]) -> DataFrame:
    """Rows once per fold; ``value`` gives a feature's cell from the fold's parameters."""
    names = feature_names(blocks)
    of = lambda c: F.max(F.when(F.col("feature") == c, F.struct("fill", "mean", "spread")))
    wide = fold_parameters(blocks).groupBy("fold").agg(*[of(c).alias(f"_{c}") for c in names])
    roles = broadcast_list(fold_roles(blocks).join(wide, "fold"), MAX_ROLES)
    laid = blocks.join(roles, "block").withColumns({c: value(c) for c in names})
    return laid.drop("block", "folds", *[f"_{c}" for c in names])


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.col(f"_{c}")["fill"])


def _scaled(c: str) -> Column:
    spread = F.col(f"_{c}")["spread"]
    return (_filled(c) - F.col(f"_{c}")["mean"]) / F.when(spread > 0, spread).otherwise(1.0)


def imputed(blocks: DataFrame) -> DataFrame:
    """Missing values become the training fold's median; a feature without any value becomes 0."""
    return _laid_out(blocks, _filled)


def standardized(blocks: DataFrame) -> DataFrame:
    """Imputed, then training fold mean 0 and population deviation 1; a constant feature is only centred."""
    return _laid_out(blocks, _scaled)


def prepared_folds(table: DataFrame) -> DataFrame:
    """Folded, imputed and scaled rows with a feature vector, written once."""
    ready = standardized(staged(time_blocks(table), "blocks"))
    vector = VectorAssembler(inputCols=feature_names(table), outputCol="features")
    return staged(vector.transform(ready).select("fold", "role", "date", "label", "features"), "folds")


def whole_sample(table: DataFrame) -> DataFrame:
    """All rows as one training fold, imputed, scaled and assembled."""
    ready = standardized(table.withColumns({"block": F.lit(1), "folds": F.lit(1)}))
    vector = VectorAssembler(inputCols=feature_names(table), outputCol="features")
    return staged(vector.transform(ready).select("date", "label", "features"), "sample")


def logistic(rows: int) -> LogisticRegression:
    """Penalty 1/n equals an inverse regularisation of 1 on summed loss."""
    return LogisticRegression(
        maxIter=3000, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False, tol=1e-12
    )


def forest(rows: int, depth: int = MAX_DEPTH, bins: int = MAX_BINS) -> RandomForestClassifier:
    """Trees as deep as Spark allows; split points are taken from ``bins`` quantiles per feature."""
    return RandomForestClassifier(
        numTrees=200, maxDepth=depth, maxBins=bins, featureSubsetStrategy="sqrt", seed=SEED
    )


BOOSTED = "GradientBoosting"  # fitted by ``boosting``, all folds at once
MODELS: dict[str, Callable | None] = {
    "LogisticRegression": logistic,
    "RandomForest": forest,
    BOOSTED: None,
}


def cross_validated(folds: DataFrame, models: Sequence[str], parallel: int = 4) -> DataFrame:
    """Test predictions of every model in every fold: (model, fold, date, label, prediction, score).

    Fits run side by side as separate Spark jobs; folds are few by construction.
    """
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]

    def one(job):
        name, fold = job
        mine = folds.where(F.col("fold") == fold)
        train = mine.where("role = 'train'").select("label", "features").persist()
        fitted = MODELS[name](train.count()).fit(train)
        train.unpersist()
        return fitted.transform(mine.where("role = 'test'")).select(
            F.lit(name).alias("model"),
            "fold",
            "date",
            "label",
            F.col("prediction").cast("int").alias("prediction"),
            F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias("score"),
        )

    def boosted() -> DataFrame:
        model = boosting.fit(folds.where("role = 'train'"))
        found = boosting.scores(folds.where("role = 'test'"), model)
        predicted = (F.col("score") > 0.5).cast("int").alias("prediction")
        return found.select(F.lit(BOOSTED).alias("model"), "fold", "date", "label", predicted, "score")

    jobs = [(name, fold) for name in models if name != BOOSTED for fold in numbers]
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, jobs))
    if BOOSTED in models:
        parts.append(boosted())
    return reduce(DataFrame.unionByName, parts)


def logistic_gradient(folds: DataFrame, names: Sequence[str]) -> DataFrame:
    """(fold, feature, gradient) of the summed penalised loss at each fold's fit; ``constant`` has no penalty."""
    parts = []
    for fold in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        train = folds.where((F.col("fold") == fold) & (F.col("role") == "train")).select("label", "features")
        fitted = logistic(train.count()).fit(train)
        x = vector_to_array("features")
        error = vector_to_array("probability")[1] - F.col("label")
        slopes = [
            (F.sum(error * x[i]) + F.lit(float(w))).alias(name)
            for i, (name, w) in enumerate(zip(names, fitted.coefficients))
        ]
        slopes.append(F.sum(error).alias("constant"))
        row = fitted.transform(train).agg(*slopes)
        parts.append(row.unpivot([], row.columns, "feature", "gradient").select(F.lit(fold).alias("fold"), "feature", "gradient"))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per (model, fold): accuracy, precision, recall, F1, ROC AUC and the sizes.

    AUC is the rank sum of the positives with mean ranks over ties; null if one class is absent.
    """
    by_score = Window.partitionBy("model", "fold").orderBy("score")
    ties = Window.partitionBy("model", "fold", "score")
    ranked = predictions.withColumn(
        "_rank", F.rank().over(by_score) + (F.count(F.lit(1)).over(ties) - 1) / 2
    )
    positive, predicted = F.col("label") == 1, F.col("prediction") == 1
    counts = ranked.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == F.col("prediction")).alias("right"),
        F.count_if(positive).alias("p"),
        F.count_if(predicted).alias("pp"),
        F.count_if(positive & predicted).alias("tp"),
        F.sum(F.when(positive, F.col("_rank"))).alias("ranks"),
    )
    n, p, tp = F.col("n"), F.col("p"), F.col("tp")
    zero = F.lit(0.0)
    metrics = counts.select(
        "model",
        "fold",
        V.ratio(F.col("right"), n).alias("accuracy"),
        F.coalesce(V.ratio(tp, F.col("pp")), zero).alias("precision"),
        F.coalesce(V.ratio(tp, p), zero).alias("recall"),
        F.coalesce(V.ratio(2 * tp, p + F.col("pp")), zero).alias("f1"),
        V.ratio(F.col("ranks") - p * (p + 1) / 2, p * (n - p)).alias("roc_auc"),
    )
    return metrics.join(broadcast_list(sizes, MAX_FOLDS), "fold")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Means over folds, best F1 first."""
    return (
        metrics.groupBy("model")
        .agg(
            *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
            F.stddev_pop("accuracy").alias("accuracy_std"),
            F.stddev_pop("f1").alias("f1_std"),
        )
        .orderBy(F.col("f1").desc_nulls_last(), "model")
    )


def best_model(board: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row of the highest F1; on equal F1 the model listed first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    key = F.struct("f1", (-place).alias("place"))
    return board.agg(F.max_by(F.struct(*board.columns), key).alias("best")).select("best.*")


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per true and predicted class in the last fold, missing cells 0."""
    last = predictions.agg(F.max("fold")).scalar()
    label, prediction = F.col("label"), F.col("prediction")
    cells = predictions.where(F.col("fold") == last).groupBy("model").agg(
        *[
            F.count_if((label == t) & (prediction == p)).alias(f"true_{t}_pred_{p}")
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    rows = [
        F.struct(
            F.lit(f"true_{t}").alias("truth"),
            F.col(f"true_{t}_pred_0").alias("pred_0"),
            F.col(f"true_{t}_pred_1").alias("pred_1"),
        )
        for t in (0, 1)
    ]
    return cells.select("model", F.inline(F.array(*rows)))


def confusion_accuracy(matrix: DataFrame) -> DataFrame:
    """Share of right predictions from the confusion matrix."""
    right = F.when(F.col("truth") == "true_0", F.col("pred_0")).otherwise(F.col("pred_1"))
    total = F.sum(F.col("pred_0") + F.col("pred_1"))
    return matrix.groupBy("model").agg(
        F.sum(right).alias("correct"),
        total.alias("total"),
        V.ratio(F.sum(right), total).alias("accuracy"),
    )


def scores_long(board: DataFrame) -> DataFrame:
    """(model, metric, score) for comparison."""
    return board.unpivot(
        ["model"], ["accuracy", "f1", "roc_auc", "precision", "recall"], "metric", "score"
    )


def feature_importance(sample: DataFrame, names: Sequence[str], model: str) -> DataFrame:
    """Importance per feature from a fit on all rows: tree gain, or size of the coefficient."""
    if model == BOOSTED:
        weights = boosting.fit(sample.withColumn("fold", F.lit(1))).importance(len(names))[0]
    else:
        train = sample.select("label", "features").persist()
        fitted = MODELS[model](train.count()).fit(train)
        train.unpersist()
        if hasattr(fitted, "featureImportances"):
            weights = fitted.featureImportances.toArray()
        else:
            weights = abs(fitted.coefficients.toArray())
    rows = [(model, name, float(w)) for name, w in zip(names, weights)]
    frame = sample.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature")
