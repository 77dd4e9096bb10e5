from stormglass.plans import catalog, pipeline
from stormglass.sources.warehouse import WAREHOUSE

SMALL = "/root/testdata/sf0.001"


def test_pipeline_writes_every_report(spark, tmp_path):
    prices, macro = catalog.landed_prices(spark, SMALL), catalog.landed_macro(spark, SMALL)
    written = pipeline.run(
        spark, prices, macro, str(tmp_path / "out"), WAREHOUSE, models=("LogisticRegression",)
    )
    counts = {
        name: spark.read.option("header", True).csv(path).count() for name, path in written.items()
    }
    assert counts["stats_crisis_vs_normal"] == 12 and counts["crisis_label_summary"] == 4
    assert counts["safe_haven_ranking"] == 6 and counts["crisis_events"] == 6
    assert all(counts.values()), counts
    meta = dict(spark.read.option("header", True).csv(written["transformation_meta"]).collect())
    labels = dict(spark.read.option("header", True).csv(written["crisis_label_summary"]).collect())
    assert meta["crisis_days"] == labels["crisis_days"] and meta["labeled_dataset_rows"] == "4922"
    assert spark.read.parquet(str(tmp_path / "out/asset_prices")).count() == 4922
    panel = spark.read.parquet(str(tmp_path / "out/analysis_panel.parquet"))
    assert "final_crisis_label" in panel.columns and panel.count() == 4922


def test_period_report(spark):
    from stormglass.plans.period_report import period_report

    rows = catalog.labelled(spark, SMALL, ["adj_close", "group"])
    tables = period_report(
        rows, "1996-01-01", "2000-12-31", 30, ["ECONOMY", "LARGE"], WAREHOUSE, {"ECONOMY": 1, "STANDARD": 1}
    )
    assert {n: df.count() for n, df in tables.items() if n in ("safe_haven_ranking", "risk", "portfolio_stats")} == {
        "safe_haven_ranking": 2, "risk": 2, "portfolio_stats": 2,
    }
    assert tables["overview"].first()["assets"] == 2
    assert tables["market_breadth"].first()["pct_outperform_std"] == 0.0
    empty = period_report(rows, "1996-01-01", "2000-12-31", 30, [], WAREHOUSE)
    assert empty["return_ranking"].count() == 0 and empty["overview"].first()["rows"] == 0
