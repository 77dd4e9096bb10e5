"""Reports cut from one pass hold the rows of the reports that read the panel themselves."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stormglass.config import Event
from stormglass.operators import breadth as B
from stormglass.operators import events as E
from stormglass.operators import stats as ST
from stormglass.operators import summary as SU
from stormglass.plans import catalog, pipeline
from stormglass.sources.warehouse import WAREHOUSE as W
from tests.helpers import days, labelled

DAYS = days(40)
EVENTS = (Event("first", DAYS[3], DAYS[20]), Event("second", DAYS[15], DAYS[30]), Event("none", date(1990, 1, 1), date(1990, 2, 1)))


def panel(spark, empty=False):
    """Two roles and odd assets: without returns, only normal days, no label, groups that begin late or change."""
    rows = []
    for i, d in enumerate(DAYS):
        wave = 0.01 * ((i * 7) % 5 - 2)
        crisis = 1 if i % 3 == 0 else 0
        rows += [(W.benchmark.asset, d, wave, -0.1 * i, crisis), (W.candidate.asset, d, -wave if i % 4 else None, -0.2, crisis)]
        rows += [("SILENT", d, None, None, crisis), ("FLAT", d, 0.0, 0.0, crisis, None if i < 9 else f"g{i % 2}")]
        rows += [("CALM", d, wave, -0.3, 0), ("UNKNOWN", d, wave, -0.3, None), (None, d, 0.5, -0.1, crisis, "h")]
    rows.append(("ONCE", DAYS[0], 0.1, -0.1, 1, None))
    table = labelled(spark, [] if empty else rows)
    return table.withColumns(
        {
            W.short_volatility: F.abs("daily_return"),
            W.medium_volatility: F.abs("drawdown"),
            "adj_close": 1 + F.coalesce("daily_return", F.lit(0.0)) + F.day("date"),
        }
    )


def rows_of(df):
    shown = df.select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return df.schema.simpleString(), sorted(map(str, shown.collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_cut_reports_equal_direct_ones(spark, empty):
    table = panel(spark, empty)
    summary, events = SU.asset_summary(table, W), E.event_summary(table, EVENTS)
    pairs = [
        (SU.stats_per_asset(summary, W), ST.stats_per_asset(table, W)),
        (SU.regime_stats(summary, W), ST.regime_stats(table, W)),
        (SU.return_ranking(summary), ST.return_ranking(table)),
        (SU.risk_detail(summary, W), ST.risk_detail(table, W)),
        (SU.risk_summary(summary, W), ST.risk_summary(table, W)),
        (SU.asset_regime_mean(summary), ST.asset_regime_mean(table)),
        (SU.market_breadth(summary, W), B.market_breadth(table, W)),
        (SU.breadth_by_group(summary), B.breadth_by_group(table)),
        (SU.overall_verdict(summary, W), E.overall_verdict(table, W)),
        (E.event_texts(events, W), E.event_verdicts(table, EVENTS, W)),
        (E.with_returns(events), E.stats_per_event(table, EVENTS)),
    ]
    for i, (cut, direct) in enumerate(pairs):
        assert rows_of(cut) == rows_of(direct), i


def test_reports_scan_the_panel_five_times(spark, tmp_path):
    folder = str(tmp_path / "labelled")
    columns = ["group", "adj_close", "cumulative_return", W.short_volatility, W.medium_volatility]
    space = catalog.workspace(spark, "/root/testdata/sf0.001", columns, correlations=True, reused=True)
    space.labelled.write.parquet(folder)
    table = spark.read.parquet(folder)
    made = pipeline.reports(table, space.dates, W)
    scans = [name for name, make in made.items() if any(folder in f for f in make().inputFiles())]
    assert sorted(scans) == ["cumulative_returns", "failure_cases"]  # next to the three passes
