import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stormglass.operators import calendar as C
from stormglass.operators import labels as L
from stormglass.operators import period as P
from stormglass.operators.features import asset_features
from stormglass.sources.warehouse import WAREHOUSE as W
from tests.helpers import days, panel


def by_date(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def test_gaps_and_zero_prices(spark):
    prices = [None, 10.0, None, 11.0, 0.0, 5.0]
    rows = [(d, "X", p) for d, p in zip(days(6), prices)]
    out = asset_features(panel(spark, rows), W)
    assert by_date(out, "daily_return") == [None, None, 0.0, pytest.approx(0.1), -1.0, None]
    assert by_date(out, "log_return")[3] == pytest.approx(math.log(1.1))
    assert by_date(out, "log_return")[4] is None
    assert by_date(out, "drawdown") == [None, 0.0, None, 0.0, -1.0, pytest.approx(5 / 11 - 1)]
    assert by_date(out, "cumulative_return") == [0.0, 0.0, 0.0, pytest.approx(0.1), -1.0, -1.0]
    assert set(by_date(out, "max_drawdown")) == {-1.0}


def test_rolling_needs_a_full_window(spark):
    rows = [(d, "X", float(i + 1)) for i, d in enumerate(days(30))]
    out = asset_features(panel(spark, rows), W)
    averages = by_date(out, "ma_20")
    assert averages[:19] == [None] * 19 and averages[19] == pytest.approx(10.5)
    volatility = by_date(out, "rolling_volatility_21d")
    assert volatility[:21] == [None] * 21 and volatility[21] is not None
    assert by_date(out, "return_5d")[5] == pytest.approx(5.0)


def spine(spark, series):
    rows = [(d, a, p) for a, points in series.items() for d, p in points]
    return C.spine(asset_features(panel(spark, rows), W), W)


def walk(dates, step):
    return [(d, 100.0 + (i * step) % 7) for i, d in enumerate(dates)]


def test_union_calendar_empties_windows(spark):
    weekdays, daily = days(80, weekdays=True), days(110)
    dates = spine(
        spark, {"ECONOMY": walk(weekdays, 3), "STANDARD": walk(weekdays, 5), "PROMO": walk(daily, 2)}
    )
    union = C.with_rolling_correlations(dates, W, "union")
    pair = C.with_rolling_correlations(dates, W, "pair")
    name = "rolling_corr_econ_std_30d"
    assert union.where(F.col(name).isNotNull()).count() == 0
    assert pair.where(F.col(name).isNotNull()).count() == 79 - 29
    with pytest.raises(ValueError):
        C.with_rolling_correlations(dates, W, "other")


def test_constant_series_has_no_correlation(spark):
    dates = spine(
        spark, {"ECONOMY": walk(days(60), 3), "STANDARD": [(d, 100.0) for d in days(60)]}
    )
    out = C.with_rolling_correlations(dates, W)
    assert out.where(F.col("rolling_corr_econ_std_30d").isNotNull()).count() == 0


def test_correlation_equals_pandas(spark):
    import pandas as pd

    dates = spine(spark, {"ECONOMY": walk(days(60), 3), "STANDARD": walk(days(60), 5)})
    out = C.with_rolling_correlations(dates, W).orderBy("date").toPandas()
    expected = out["econ_return"].rolling(30).corr(out["std_return"])
    mine = out["rolling_corr_econ_std_30d"].astype(float)
    pd.testing.assert_series_equal(mine, expected, check_names=False)


def test_month_start_on_a_missing_date(spark):
    dates = spark.createDataFrame([(date(2020, 1, d),) for d in (1, 2, 6)], "date date")
    wide = spark.createDataFrame(
        [(date(2020, 1, 1), 1.0), (date(2020, 1, 4), 2.0)], "date date, V double"
    )
    read = lambda mode: by_date(C.macro_on_dates(dates, wide, ("V",), mode), "V")
    assert read("panel") == [1.0, 1.0, 1.0]
    assert read("asof") == [1.0, 1.0, 2.0]


def test_target_truth_table(spark):
    cases = [  # stress, own, benchmark return -> target
        (50.0, 0.02, 0.01, 1.0), (50.0, 0.0, -0.01, 1.0), (50.0, -0.02, -0.01, 0.0),
        (50.0, 0.01, 0.01, 0.0), (50.0, None, 0.01, None), (50.0, 0.01, None, None),
        (10.0, 0.02, 0.01, None), (None, 0.02, 0.01, None),
    ]
    rows = [(d, s, None, c, b, None, True) for d, (s, c, b, _) in zip(days(len(cases)), cases)]
    dates = spark.createDataFrame(
        rows,
        "date date, STRESS double, RECESSION double, econ_return double, std_return double, "
        "std_drawdown double, benchmark_present boolean",
    )
    out = L.with_labels(dates, W)
    assert by_date(out, "econ_safe_haven_success") == [c[3] for c in cases]
    assert by_date(out, "final_crisis_label") == [1] * 6 + [0, 0]


def test_drawdown_flag_needs_a_benchmark_row(spark):
    d = days(4)
    dates = spark.createDataFrame(
        [(d[0], -0.5, True), (d[1], -0.1, True), (d[2], None, True), (d[3], None, False)],
        "date date, std_drawdown double, benchmark_present boolean",
    ).withColumns(
        {c: F.lit(None).cast("double") for c in ("STRESS", "RECESSION", "econ_return", "std_return")}
    )
    out = L.with_labels(dates, W)
    assert by_date(out, "crisis_by_std_drawdown") == [1, 0, 0, None]
    assert by_date(out, "final_crisis_label") == [1, 0, 0, 0]


def test_period_panel(spark):
    d = days(12)
    prices = [50.0, None, 10.0, 12.0, 9.0, None, 18.0, 18.0, 9.0, 9.0, 9.0, 9.0]
    rows = [(x, "X", p) for x, p in zip(d, prices)] + [(x, "Z", 0.0) for x in d]
    out = P.period_panel(panel(spark, rows), str(d[1]), str(d[11]), 30)
    x = out.where("asset = 'X'")
    assert by_date(x, "period_return")[:4] == [None, None, pytest.approx(0.2), -0.25]
    assert by_date(x, "period_cum")[:6] == [None, 0.0, pytest.approx(0.2), pytest.approx(-0.1), None, pytest.approx(0.8)]
    assert by_date(x, "period_drawdown")[3] == -0.25
    volatility = by_date(x, "period_volatility")
    assert [v is not None for v in volatility] == [False] * 11  # at least 10 returns are needed
    assert P.period_panel(panel(spark, rows), str(d[1]), str(d[11]), 6).where(
        "asset = 'X' AND period_volatility IS NOT NULL"
    ).count() == 5
    assert set(by_date(out.where("asset = 'Z'"), "period_cum")) == {None}


def test_bounds_without_rows(spark):
    row = P.data_bounds(panel(spark, [(days(1)[0], "X", 1.0)]).where("false")).first()
    assert row["last_date"] - row["first_date"] >= timedelta(days=5 * 365)
