import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stormglass.config import Event
from stormglass.functions.ranking import with_position
from stormglass.operators import breadth as B
from stormglass.operators import events as E
from stormglass.operators import portfolio as PF
from stormglass.operators import score as SC
from stormglass.operators import stats as ST
from stormglass.sources.warehouse import WAREHOUSE as W
from tests.helpers import days, labelled, panel, values


def test_positions_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(f"a{i}", rng.choice([None, 1.0, 1.0, 1.0, rng.random()])) for i in range(5000)]
    df = spark.createDataFrame(rows, "asset string, v double").repartition(16)
    got = with_position(df, [F.col("v").desc_nulls_last(), F.col("asset").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["asset"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


def crisis(asset, returns, group="g", dates=None):
    return [(asset, d, r, -0.1, 1, group) for d, r in zip(dates or days(len(returns)), returns)]


def wiggle(n, scale):
    return [scale * ((i * 7) % 5 - 2) for i in range(n)]


def test_score_edges(spark):
    bench = wiggle(12, 0.01)
    rows = (
        crisis("STANDARD", bench)
        + crisis("FEW", [0.1] * 4)
        + crisis("NINE", bench[:9])
        + crisis("FLAT", [0.01] * 12)
        + crisis("ECONOMY", wiggle(12, 0.02))
    )
    out = SC.defensive_metrics(labelled(spark, rows), W)
    corr = values(out, "asset", "corr_with_std")
    assert set(corr) == {"STANDARD", "NINE", "FLAT", "ECONOMY"}
    assert corr["STANDARD"] == pytest.approx(1.0)
    assert corr["NINE"] == 0.0 and corr["FLAT"] == 0.0
    assert corr["ECONOMY"] == pytest.approx(0.1)  # mean of its rolling correlation
    assert values(out, "asset", "outperform_std_rate")["STANDARD"] == 0.0


def test_outperform_counts_rows_without_return(spark):
    bench = [0.0] * 10
    rows = crisis("STANDARD", bench) + crisis("X", [0.01] * 5 + [None] * 5)
    out = SC.defensive_metrics(labelled(spark, rows), W)
    assert values(out, "asset", "outperform_std_rate")["X"] == 0.5
    assert values(out, "asset", "hit_rate")["X"] == 1.0
    plain = labelled(spark, rows).withColumnsRenamed(
        {"daily_return": "period_return", "drawdown": "period_drawdown"}
    )
    ranked = SC.period_ranking(plain, W, ["X"])
    assert values(ranked, "asset", "outperform_std_rate") == {"X": 1.0}


def test_equal_assets_score_zero(spark):
    rows = [r for a in ("A", "B", "STANDARD") for r in crisis(a, wiggle(12, 0.01))]
    out = SC.safe_haven_score(labelled(spark, rows), W).collect()
    assert [r["safe_haven_score"] for r in out] == [0.0] * 3
    assert {r["asset"]: r["rank"] for r in out} == {"A": 1, "B": 2, "STANDARD": 3}


def test_zscores_have_mean_zero(spark):
    rows = [r for i in range(5) for r in crisis(f"A{i}", wiggle(12, 0.01 * (i + 1)))]
    rows += crisis("STANDARD", wiggle(12, -0.01))
    out = SC.safe_haven_score(labelled(spark, rows), W)
    assert out.agg(F.avg("z_vol")).first()[0] == pytest.approx(0.0, abs=1e-12)


def test_breadth_rounds_half_to_even(spark):
    rows = crisis("A0", [0.1, 0.1]) + [r for i in range(1, 16) for r in crisis(f"A{i}", [-0.1, -0.1])]
    row = B.market_breadth(labelled(spark, rows), W).first()
    assert (row["total_assets"], row["advance_count"], row["decline_count"]) == (16, 1, 15)
    assert row["pct_positive_crisis"] == 6.2
    assert row["pct_outperform_std"] == 0.0 and row["std_mean_crisis_return"] is None


def test_breadth_decline_differs_by_operator(spark):
    rows = crisis("UP", [0.1]) + crisis("DOWN", [-0.1]) + crisis("NONE", [None])
    table = labelled(spark, rows)
    assert B.market_breadth(table, W).first()["decline_count"] == 2
    assert B.breadth_by_group(table).first()["decline"] == 1
    quiet = table.where("final_crisis_label = 0")
    assert B.market_breadth(quiet, W).count() == 0


def test_regimes_split_all_rows(spark):
    d = days(4)
    rows = [("X", d[0], 0.1, 0.0, 1), ("X", d[1], None, 0.0, 0), ("X", d[2], 0.2, 0.0, None), ("X", d[3], -0.1, 0.0, 1)]
    table = labelled(spark, rows).withColumn("rolling_volatility_21d", F.lit(0.1))
    counts = values(ST.regime_stats(table, W), "regime", "count")
    assert counts == {"crisis": 2, "normal": 2}
    ranking = ST.return_ranking(table).first()
    assert (ranking["mean"], ranking["count"], ranking["rank"]) == (0.0, 2, 1)


EVENTS = (
    Event("one", date(2020, 1, 6), date(2020, 1, 9)),
    Event("two", date(2020, 1, 8), date(2020, 1, 12)),
    Event("none", date(2030, 1, 1), date(2030, 1, 2)),
)


def test_overlapping_events(spark):
    prices = [10.0, 11.0, None, 12.0, 6.0, 9.0, 9.0]
    table = panel(spark, [(d, "ECONOMY", p) for d, p in zip(days(7), prices)])
    counts = values(E.in_events(table, EVENTS).groupBy("crisis_name").count(), "crisis_name", "count")
    assert counts == {"one": 4, "two": 5}
    moves = {r["crisis_name"]: r for r in E.event_performance(table, EVENTS, W).collect()}
    assert moves["one"]["return_pct"] == pytest.approx(20.0) and moves["one"]["survived"]
    assert moves["one"]["return_text"] == "+20.00%"
    assert moves["two"]["return_pct"] is None and not moves["two"]["survived"]
    assert moves["two"]["return_text"] == "nan%"
    base = E.rebased_prices(table, EVENTS, 0, 0).where("crisis_name = 'two'")
    assert base.where("rebased IS NOT NULL").count() == 0
    widened = E.rebased_prices(table, EVENTS).where("crisis_name = 'two'")
    assert widened.count() == 7 and widened.agg(F.max("rebased")).first()[0] == 120.0
    assert E.in_events(table, ()).count() == 0


def test_verdicts(spark):
    d = days(7)
    rows = [("ECONOMY", x, 0.01, 0.0, 1) for x in d] + [("STANDARD", x, -0.01, 0.0, 1) for x in d[:3]]
    table = labelled(spark, rows)
    status = values(E.event_verdicts(table, EVENTS, W), "title", "status")
    assert status == {"one": "safe_haven", "two": "safe_haven"}
    later = (Event("late", d[4], d[6]),)
    assert values(E.event_verdicts(table, later, W), "title", "status") == {"late": "partial"}
    assert E.overall_verdict(table, W).first()["status"] == "good"
    assert E.overall_verdict(table.where("asset = 'STANDARD'"), W).count() == 0


def portfolio_panel(spark):
    d = days(4)
    rows = [(x, "ECONOMY", p) for x, p in zip(d, [10.0, 11.0, 11.0, 22.0])]
    rows += [(x, "STANDARD", p) for x, p in zip(d, [10.0, 9.0, None, 4.5])]
    rows += [(x, "MEDIUM", p) for x, p in zip(d[1:], [5.0, 5.0, 5.0])]
    return panel(spark, rows)


def test_portfolio(spark):
    table = portfolio_panel(spark)
    daily = PF.portfolio_daily(table, {"ECONOMY": 3, "STANDARD": 1}, W)
    assert [round(r["portfolio"], 10) for r in daily.orderBy("date").collect()] == [0.05, 0.0, 0.625]
    assert PF.portfolio_daily(table, {"ECONOMY": 1, "MEDIUM": 1}, W).count() == 2
    assert PF.portfolio_daily(table, {"ECONOMY": 0, "STANDARD": 0}, W).count() == 0
    stats = {r["strategy"]: r for r in PF.strategy_stats(daily, W).collect()}
    assert stats["benchmark"]["total_return"] == pytest.approx(-0.55)
    assert stats["benchmark"]["max_drawdown"] == pytest.approx(-0.5)  # day 1 is not part of it
    better = PF.drawdown_comparison(daily).first()
    assert better["improved"] and better["portfolio_max_drawdown"] == 0.0
    alone = PF.portfolio_daily(table, {"ECONOMY": 1, "MEDIUM": 1}, W)
    assert PF.drawdown_comparison(alone).count() == 0
    weights = PF.normalized_weights(spark, {"A": 2, "B": 6}).agg(F.sum("weight")).first()[0]
    assert weights == 1.0
