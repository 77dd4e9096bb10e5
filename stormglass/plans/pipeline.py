"""The batch pipeline: landed files to written panel, features, labels, statistics and model reports.

One Spark application. Only the clean panel, the features, the date table and the labelled panel are
written in between; every later step reads the columns it needs from them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.config import MARKET, Profile
from stormglass.functions.staging import release, staged, written_paths
from stormglass.operators import calendar as C
from stormglass.operators import clean as CL
from stormglass.operators import events as E
from stormglass.operators import labels as L
from stormglass.operators import learning as M
from stormglass.operators import quality as Q
from stormglass.operators import score as SC
from stormglass.operators import summary as SU
from stormglass.operators.features import asset_features
from stormglass.plans.storage import storage_profile
from stormglass.plans.workspace import Workspace, date_table
from stormglass.sources import landing as LD
from stormglass.sources import sinks as K
from stormglass.sources.dimensions import event_table


def integrate(
    spark: SparkSession, prices: str, macro: str, out: str, profile: Profile, by_name: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Clean both sources and write the master panel and the wide macro table; returns them as written."""
    clean = staged(CL.clean_prices(LD.scan_prices(spark, prices, by_name)), "prices")
    values = CL.clean_macro(LD.scan_macro(spark, macro, by_name))
    K.write_parquet(CL.macro_wide(values, profile.macro_variables), f"{out}/macro_wide.parquet")
    wide = spark.read.parquet(f"{out}/macro_wide.parquet")
    master = C.macro_onto_panel(clean, wide, profile.macro_variables)
    K.write_parquet(master, f"{out}/master_asset_panel.parquet")
    return spark.read.parquet(f"{out}/master_asset_panel.parquet"), wide


def label(
    spark: SparkSession, master: DataFrame, wide: DataFrame, out: str, profile: Profile
) -> tuple[DataFrame, DataFrame]:
    """Write features, the date table and the labelled panel; returns the latter two as written."""
    bars = master.drop(*profile.macro_variables)
    K.write_parquet(asset_features(bars, profile), f"{out}/feature_dataset.parquet")
    features = spark.read.parquet(f"{out}/feature_dataset.parquet")
    K.write_parquet(date_table(features, wide, profile), f"{out}/date_table.parquet")
    dates = spark.read.parquet(f"{out}/date_table.parquet")
    labelled = Workspace(profile, features, dates).labelled
    K.write_parquet(labelled, f"{out}/labeled_dataset.parquet")
    return spark.read.parquet(f"{out}/labeled_dataset.parquet"), dates


def reports(labelled: DataFrame, dates: DataFrame, profile: Profile) -> dict[str, Callable[[], DataFrame]]:
    """Every result table of the statistics step by name.

    The panel is read once for the moments of all assets, once for those of all events and once for the
    score; the statistics are cut from these. Two more tables are a projection and a filter of the panel.
    """
    with ThreadPoolExecutor(3) as pool:  # three independent passes, submitted together
        passes = [
            pool.submit(lambda: staged(SC.safe_haven_score(labelled, profile), "score")),
            pool.submit(lambda: staged(SU.asset_summary(labelled, profile), "asset-summary")),
            pool.submit(lambda: staged(E.event_summary(labelled, profile.events), "event-summary")),
        ]
        ranking, assets, events = [task.result() for task in passes]
    shown = [c for c in profile.rolling_corr_columns]
    return {
        "stats_per_asset": lambda: SU.stats_per_asset(assets, profile),
        "stats_per_crisis": lambda: E.with_returns(events),
        "stats_crisis_vs_normal": lambda: SU.regime_stats(assets, profile),
        "return_ranking": lambda: SU.return_ranking(assets),
        "safe_haven_score": lambda: ranking,
        "safe_haven_ranking": lambda: SC.rerank(ranking),
        "market_breadth": lambda: SU.market_breadth(assets, profile),
        "market_breadth_by_group": lambda: SU.breadth_by_group(assets),
        "rolling_corr_multi": lambda: C.multi_window_correlations(dates, profile),
        "risk_detail": lambda: SU.risk_detail(assets, profile),
        "bottom_line": lambda: E.all_insights(
            SU.overall_verdict(assets, profile), E.event_texts(events, profile), ranking, profile
        ),
        "crisis_events": lambda: event_table(labelled.sparkSession, profile.events),
        "asset_summary": lambda: SU.asset_regime_mean(assets),
        "crisis_label_summary": lambda: L.label_summary(dates, profile),
        "crisis_summary": lambda: L.crisis_daily(dates, profile),
        "failure_cases": lambda: L.failure_cases(labelled, profile),
        "cumulative_returns": lambda: labelled.select(
            "date", "asset", F.col("cumulative_return").alias("cum")
        ),
        "rolling_correlation": lambda: dates.select("date", *shown),
        "risk_summary": lambda: SU.risk_summary(assets, profile),
    }


def learn(labelled: DataFrame, profile: Profile, models=tuple(M.MODELS)) -> dict[str, DataFrame]:
    """Model reports; empty if there are too few rows to learn from."""
    table = staged(M.training_table(labelled, profile), "training")
    if M.enough_rows(table).isEmpty():
        return {}
    folds = M.prepared_folds(table)
    predictions = staged(M.cross_validated(folds, models), "predictions")
    detail = staged(M.fold_metrics(predictions, M.fold_sizes(folds)), "fold-metrics")
    board = M.leaderboard(detail)
    best = M.best_model(board, models).select(F.col("model").alias("best")).scalar()
    matrix = staged(M.confusion(predictions), "confusion")
    sample, names = M.whole_sample(table), M.feature_names(table)
    result = {
        "ml_preprocessing_report": M.missing_report(table),
        "ml_fold_detail": detail,
        "ml_leaderboard": board,
        "confusion_by_model": matrix,
        "confusion_matrix": matrix.where(F.col("model") == best).drop("model"),
    }
    for name in models:
        result[f"feature_importance_{name}"] = M.feature_importance(sample, names, name)
    return result


def run(
    spark: SparkSession,
    prices: str,
    macro: str,
    out: str,
    profile: Profile = MARKET,
    models=tuple(M.MODELS),
    by_name: bool = True,
    side_by_side: int = 4,
) -> dict[str, str]:
    """Run every step and write all tables under ``out``; returns name -> path of the CSV reports.

    Reports do not depend on each other, so up to ``side_by_side`` of them are submitted together.
    """
    written: dict[str, str] = {}
    before = set(written_paths(spark))

    def save(name: str, df: DataFrame) -> None:
        written[name] = f"{out}/reports/{name}.csv"
        K.write_csv(df, written[name])

    quality = staged(
        Q.price_file_report(spark, prices).unionByName(Q.macro_file_report(spark, macro)), "quality"
    )
    save("data_quality_summary", quality)
    save("data_quality_totals", Q.quality_totals(quality))
    master, wide = integrate(spark, prices, macro, out, profile, by_name)
    master_path = f"{out}/master_asset_panel.parquet"
    storage = staged(storage_profile(master, f"{out}/asset_prices", master_path), "storage")
    save("storage_benchmark", storage)
    labelled, dates = label(spark, master, wide, out, profile)
    K.write_parquet(K.analysis_panel(labelled, profile), f"{out}/analysis_panel.parquet")
    makers = reports(labelled, dates, profile)
    with ThreadPoolExecutor(side_by_side) as pool:
        list(pool.map(lambda name: save(name, makers[name]()), makers))
    kinds = {r["type"]: r["count"] for r in quality.groupBy("type").count().collect()}
    files = {f"{kind}_raw_files": kinds.get(kind, 0) for kind in ("price", "macro")}
    facts = Q.panel_metadata(labelled, dates)
    save("transformation_meta", Q.pipeline_metadata(facts, storage, files, len(written)))
    if models:
        for name, df in learn(labelled, profile, models).items():
            save(name, df)
    release(spark, [path for path in written_paths(spark) if path not in before])
    return written
