"""The physical plans keep their shape."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stormglass.functions.staging import written_paths
from stormglass.operators import calendar as C
from stormglass.operators import score as SC
from stormglass.operators.features import asset_features
from stormglass.plans import catalog
from stormglass.sources import warehouse as WH
from stormglass.sources.warehouse import WAREHOUSE as W

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_share_one_shuffle_and_sort(spark):
    bars = catalog.staged(WH.panel(spark, SMALL), "panel")
    text = plan(asset_features(bars, replace(W, moving_averages=(20, 50))))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_a_long_frame_adds_sorts_but_no_shuffle(spark):
    bars = catalog.staged(WH.panel(spark, SMALL), "panel")
    text = plan(asset_features(bars, replace(W, moving_averages=(20, 50, 200))))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", text)) <= 4


def test_unused_features_are_pruned(spark):
    bars = catalog.staged(WH.panel(spark, SMALL), "panel")
    text = plan(asset_features(bars, W).select("asset", "date", "daily_return"))
    assert "stddev_samp" not in text and "product" not in text
    assert "ReadSchema: struct<date:date,close:double,adj_close:double,asset:string>" in text


def test_dedup_is_limited_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["clean_dedup_keep_last"](spark, SMALL))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "row_number(), 1, Partial" in below


def test_spine_is_one_partial_aggregate(spark):
    bars = catalog.staged(WH.panel(spark, SMALL), "panel")
    features = catalog.staged(asset_features(bars, W), "features")
    text = plan(C.spine(features, W))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_period_filter_reaches_the_scan(spark):
    from stormglass.operators import period as P

    bars = catalog.staged(WH.panel(spark, SMALL), "panel")
    text = plan(P.period_panel(bars, "1996-01-01", "1996-12-31", 30))
    assert "GreaterThanOrEqual(date,1996-01-01)" in text and "LessThanOrEqual(date,1996-12-31)" in text


def test_bucketed_panel_needs_no_shuffle(spark, tmp_path):
    from stormglass.operators import period as P
    from stormglass.sources.sinks import write_bucketed

    bars = write_bucketed(WH.panel(spark, SMALL), "bucketed_bars", str(tmp_path / "b"), 4)
    try:
        # Spark may otherwise prefer plain splits when few buckets would be read.
        text = plan(P.period_panel(bars, "1996-01-01", "1996-12-31", 30))
        assert "Exchange" not in text and "Bucketed: true" in text
        assert bars.count() == 4922
    finally:
        spark.sql("DROP TABLE bucketed_bars")


@pytest.mark.parametrize("name", ["safe_haven_score", "market_breadth", "stats_per_event", "quadrants"])
def test_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_metrics_use_hash_aggregates(spark):
    rows = catalog.labelled(spark, SMALL, correlations=True, reused=True)
    assert "SortAggregate" not in plan(SC.defensive_metrics(rows, W))


def test_top_n_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["top_assets"](spark, SMALL))


def test_every_query_has_sql_or_a_reason():
    from sqlcheck import SQL

    without = set(catalog.QUERIES) - set(SQL)
    assert without == {
        "storage_profile_panel", "ml_logistic", "ml_forest", "ml_boosting", "feature_importance", "top_features",
    }
    assert not set(SQL) - set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() == 12 and rows.where(F.col("regime") == "crisis").count() == 6


@pytest.mark.parametrize("name", ["stats_per_asset", "stats_per_event", "event_verdicts"])
def test_statistics_without_labels_write_nothing(spark, name):
    before = written_paths(spark)
    catalog.QUERIES[name](spark, SMALL).collect()
    assert written_paths(spark) == before
