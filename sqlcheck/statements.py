"""One SQL statement per query; column names equal the query's."""

from __future__ import annotations

from sqlcheck.parts import (
    BENCHMARK,
    CANDIDATE,
    CLASS,
    CORR_COLUMNS,
    HIT,
    LAGS,
    MACRO,
    METRIC_COLUMNS,
    REGIME,
    SCORE_COLUMNS,
    cols,
    corr,
    filled,
    metrics,
    rnd,
    score,
    sql,
)

SQL: dict[str, str] = {}

IN_EVENT = "JOIN events_ e ON p.date BETWEEN e.start_date AND e.end_date"
CHOSEN = "('ECONOMY','MEDIUM','SMALL','LARGE','PROMO')"
LANDED = "SELECT *, unnest(range(1, CASE WHEN day(date) = 1 THEN 3 ELSE 2 END)) AS copy FROM gaps"
LANDED_MACRO = (
    "SELECT * REPLACE (CASE WHEN variable = 'YIELD' AND value < 4 THEN NULL ELSE value END AS value) "
    "FROM macro_long"
)

# Sources, cleaning, sinks

_clean = ", ".join(f"{rnd(filled(c))} AS {c}" for c in ("open", "high", "low", "close", "adj_close"))
SQL["price_scan"] = sql(
    "gaps",
    f"SELECT date, {_clean}, {rnd('volume')} AS volume, asset, \"group\", 'warehouse' AS source FROM gaps",
)
SQL["price_scan_by_name"] = SQL["price_scan"]
SQL["macro_scan"] = sql(
    "macro_long",
    f"SELECT date, variable, {rnd(filled('value', 'PARTITION BY variable ORDER BY date'))} AS value "
    "FROM landed",
    landed=LANDED_MACRO,
)
SQL["macro_normalize"] = sql(
    "macro_long",
    'SELECT date AS "Date", ' + rnd("value") + ' AS "Value", variable, \'warehouse\' AS source '
    "FROM landed WHERE variable = 'YIELD' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    landed=LANDED_MACRO,
)
SQL["tagged_panel"] = sql(
    "panel",
    "SELECT \"group\", 'warehouse' AS source, count(*) AS rows, count(DISTINCT asset) AS assets "
    'FROM panel GROUP BY "group"',
)
_status = """
  CASE WHEN fresh > 0 THEN 'SUCCESS' WHEN kept > 0 THEN 'USING_CACHED: no rows landed'
       WHEN optional THEN 'OPTIONAL_FAILED: no rows landed' ELSE 'FAILED: no rows landed' END AS status,
  CASE WHEN fresh > 0 THEN fresh ELSE kept END AS rows"""
SQL["ingest_log"] = sql(
    "panel",
    f"""SELECT asset, "group", status, rows,
               CASE WHEN rows > 0 THEN 'landed/' || asset || '.csv' ELSE '' END AS path
        FROM (SELECT asset, "group", {_status}
              FROM (SELECT k.asset, k."group", k.optional,
                      (SELECT count(*) FROM panel p WHERE p.asset = k.asset AND year(date) >= 2000
                         AND asset <> 'SMALL') AS fresh,
                      (SELECT count(*) FROM panel p WHERE p.asset = k.asset AND year(date) < 2000) AS kept
                    FROM known k))""",
    known="""SELECT * FROM (VALUES ('ECONOMY','value',false),('SMALL','value',false),
      ('STANDARD','core',false),('MEDIUM','core',false),('LARGE','growth',false),('PROMO','growth',false),
      ('GHOST','value',false),('SPOT','core',true)) AS t(asset, "group", optional)""",
)
SQL["macro_ingest_log"] = sql(
    "macro_long",
    f"""SELECT variable, status, rows,
               CASE WHEN rows > 0 THEN 'landed/' || variable || '.csv' ELSE '' END AS path
        FROM (SELECT variable, {_status}
              FROM (SELECT k.variable, false AS optional,
                      (SELECT count(*) FROM macro_long p WHERE p.variable = k.variable
                         AND year(date) >= 2000 AND variable <> 'YIELD') AS fresh,
                      (SELECT count(*) FROM macro_long p WHERE p.variable = k.variable
                         AND year(date) < 2000) AS kept
                    FROM known k))""",
    known="SELECT unnest(['STRESS','YIELD','RECESSION','PRICE_INDEX','ABSENT']) AS variable",
)
SQL["panel_scan"] = sql(
    "panel",
    "SELECT asset, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
    "count(*) AS rows, min(date) AS first_date FROM panel GROUP BY ALL",
)
SQL["clean_dedup_keep_last"] = """
SELECT asset, date, 50 + l_quantity AS close, l_orderkey
FROM (SELECT p_type AS asset, CAST(l_shipdate AS DATE) AS date, l_quantity, l_orderkey,
             row_number() OVER (PARTITION BY p_type, CAST(l_shipdate AS DATE)
               ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                        l_quantity DESC) AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n = 1"""
SQL["ffill_by_asset"] = sql(
    "gaps",
    f"""SELECT date, {_clean}, asset, "group",
               coalesce(CASE WHEN day(date) <> 13 THEN volume END, 0.0) AS volume FROM gaps""",
)
SQL["macro_wide"] = sql("macro_wide", "SELECT date, " + cols(*[f"~{v}" for v in MACRO]) + " FROM macro_wide")
for _name, _source in (("macro_panel_join", "on_dates"), ("macro_asof", "latest")):
    SQL[_name] = sql(
        _source,
        "SELECT date, asset, " + cols("~close", *[f"~{v}" for v in MACRO])
        + f" FROM panel LEFT JOIN {_source} USING (date)",
    )
SQL["partition_roundtrip"] = sql(
    "panel",
    'SELECT "group", asset, CAST(year(date) AS INTEGER) AS year, count(*) AS rows, '
    + rnd("max(close)") + " AS max_close FROM panel GROUP BY ALL",
)

# Features

_bar = ("date", "~open", "~high", "~low", "~close", "~adj_close", "~volume", "asset")
_feature = (
    "~daily_return", "~rolling_mean_21d", "~drawdown", "~rolling_high", "~ma_20", "~ma_50", "~ma_200",
    "~return_5d", "~return_21d", "~return_63d", "~log_return", "~daily_change", "~cumulative_return",
    "~rolling_volatility_21d", "~rolling_volatility_63d", "~max_drawdown",
)
for _name, _source in (("asset_features_gaps", "gap_features"), ("asset_features_brand", "brand_features")):
    SQL[_name] = sql(_source, f'SELECT {cols(*_bar, *_feature)}, "group" FROM {_source}')
SQL["cumulative_returns"] = sql(
    "features", f"SELECT {cols('date', 'asset', '~cum = cumulative_return')} FROM features"
)
SQL["rolling_corr"] = sql(
    "spine",
    "SELECT date, " + cols(*[f"~{c} = {corr(o, n)}" for c, (o, n) in CORR_COLUMNS.items()]) + " FROM spine",
)
SQL["rolling_corr_pair"] = sql(
    "spine",
    "SELECT date, "
    + cols(*[f"~{c} = {corr(o, n, 'pair')}" for c, (o, n) in CORR_COLUMNS.items()])
    + " FROM spine",
)
_multi = [
    f"~corr_econ_{o}_{n}d = {corr(o, n)}"
    for n in (30, 90, 180)
    for o in ("std", "medium", "small", "promo")
]
SQL["rolling_corr_multi"] = sql(
    "spine", f"SELECT * FROM (SELECT date, counted, {cols(*_multi)} FROM spine) WHERE counted"
).replace("SELECT * FROM (SELECT date, counted", "SELECT * EXCLUDE (counted) FROM (SELECT date, counted")
SQL["rolling_corr_view"] = sql(
    "spine",
    "\nUNION ALL\n".join(
        f"SELECT date, 'corr_econ_{o}_30d' AS pair, correlation FROM "
        f"(SELECT date, {rnd(corr(o, 30))} AS correlation FROM spine) WHERE correlation IS NOT NULL "
        "AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
        for o in ("std", "medium", "small")
    ),
)
SQL["rolling_corr_onto_panel"] = sql(
    "labelled", f"SELECT {cols('date', 'asset', *['~' + c for c in CORR_COLUMNS])} FROM labelled"
)
SQL["inflation_yoy"] = sql(
    "on_dates",
    "SELECT date, "
    + cols(
        "~stress_level = STRESS", "~recession_flag = RECESSION", "~cpi_level = PRICE_INDEX",
        "~real_yield = YIELD",
        "~inflation_yoy = PRICE_INDEX / nullif(lag(PRICE_INDEX, 252) OVER (ORDER BY date), 0) - 1",
    )
    + " FROM on_dates",
)

# Labels

_labels = (
    "crisis_by_stress", "crisis_by_recession", "crisis_by_std_drawdown", "final_crisis_label",
    "~econ_safe_haven_success", "~std_drawdown",
)
SQL["date_labels"] = sql("dates", f"SELECT {cols('date', *_labels)} FROM dates")
SQL["labelled_panel"] = sql(
    "labelled", f"SELECT {cols('date', 'asset', '~daily_return', *_labels)} FROM labelled"
)
_days = (
    ("crisis_days", "final_crisis_label = 1"),
    ("normal_days", "final_crisis_label = 0"),
    ("econ_safe_haven_success_days", "final_crisis_label = 1 AND econ_safe_haven_success = 1"),
    ("econ_safe_haven_fail_days", "final_crisis_label = 1 AND econ_safe_haven_success = 0"),
)
SQL["label_summary"] = sql(
    "dates",
    "\nUNION ALL\n".join(f"SELECT '{n}' AS metric, count(*) AS value FROM dates WHERE {c}" for n, c in _days),
)
SQL["crisis_daily"] = sql(
    "dates",
    f"SELECT {cols('date', 'final_crisis_label', '~econ_safe_haven_success', '~STRESS')} FROM dates",
)
SQL["failure_cases"] = sql(
    "crisis",
    f"SELECT {cols('date', '~econ_safe_haven_success', '~daily_return', '~STRESS')} FROM crisis "
    f"WHERE asset = '{CANDIDATE}' AND econ_safe_haven_success = 0",
)
SQL["analysis_panel"] = sql(
    "labelled",
    "SELECT "
    + cols(
        *_bar, "~daily_return", "~log_return", "~cumulative_return", "~drawdown",
        "~rolling_volatility_21d", "~rolling_volatility_63d", *["~" + c for c in CORR_COLUMNS],
        "~STRESS", "~RECESSION", "~stress_level = STRESS", "~recession_flag = RECESSION",
        "~real_yield = YIELD", "~inflation_yoy", *_labels,
    )
    + ', "group" FROM labelled',
)

# Statistics


def _asset_stats(source: str) -> str:
    return (
        "SELECT asset, count(*) AS count, "
        + cols(
            "~mean_return = avg(daily_return)", "~median_return = median(daily_return)",
            "~std_return = stddev_samp(daily_return)", "~min_return = min(daily_return)",
            "~max_return = max(daily_return)", "~mean_drawdown = avg(drawdown)",
            "~max_drawdown = min(drawdown)", "~mean_volatility_21d = avg(rolling_volatility_21d)",
        )
        + f", {rnd(HIT.format('daily_return'))} AS hit_rate FROM {source} GROUP BY asset"
    )


SQL["stats_per_asset"] = sql("features", _asset_stats("features"))
SQL["stats_per_brand"] = sql("brand_features", _asset_stats("brand_features"))
SQL["top_assets"] = sql(
    "brand_features",
    f"SELECT asset, {rnd('avg(daily_return)')} AS mean_return FROM brand_features GROUP BY asset "
    "ORDER BY avg(daily_return) DESC NULLS LAST, asset LIMIT 12",
)
SQL["stats_per_event"] = sql(
    "labelled events_",
    "SELECT crisis_name, start_date, end_date, asset, count(daily_return) AS trading_days, "
    + cols(
        "~mean_daily_return = avg(daily_return)",
        "~total_return = CASE WHEN count(adj_close) >= 2 THEN arg_max(adj_close, date) "
        "/ nullif(arg_min(adj_close, date), 0) - 1 END",
        "~std_return = stddev_samp(daily_return)", "~max_drawdown = min(drawdown)",
    )
    + f", {rnd(HIT.format('daily_return'))} AS hit_rate FROM labelled p {IN_EVENT} "
    "GROUP BY ALL HAVING count(daily_return) > 0",
)
SQL["regime_stats"] = sql(
    "labelled",
    f"SELECT asset, {REGIME} AS regime, count(*) AS count, "
    + cols(
        "~mean_return = avg(daily_return)", "~std_return = stddev_samp(daily_return)",
        "~mean_volatility_21d = avg(rolling_volatility_21d)", "~max_drawdown = min(drawdown)",
    )
    + f", {rnd(HIT.format('daily_return'))} AS hit_rate FROM labelled GROUP BY ALL",
)
SQL["csv_roundtrip"] = SQL["regime_stats"]


def _ranking(source: str, ret: str) -> str:
    return (
        f"SELECT asset, {cols('~mean', '~std', 'count', 'rank')} FROM (SELECT *, row_number() OVER "
        "(ORDER BY mean DESC NULLS LAST, asset) AS rank FROM (SELECT asset, "
        f"avg({ret}) AS mean, stddev_samp({ret}) AS std, count({ret}) AS count "
        f"FROM {source} GROUP BY asset))"
    )


SQL["return_ranking"] = sql("crisis", _ranking("crisis", "daily_return"))
_brand_crisis = (
    "SELECT b.* FROM brand_features b JOIN dates d USING (date) WHERE d.final_crisis_label = 1"
)
SQL["brand_ranking"] = sql(
    "brand_features dates", _ranking("bc", "daily_return"), bc=_brand_crisis
)
SQL["risk_detail"] = sql(
    "labelled",
    f"SELECT asset, {REGIME} AS regime, "
    + cols(
        "~mean_volatility_21d = avg(rolling_volatility_21d)",
        "~mean_volatility_63d = avg(rolling_volatility_63d)", "~max_drawdown = min(drawdown)",
        "~mean_return = avg(daily_return)", "~annualized_vol = stddev_samp(daily_return) * sqrt(252.0)",
    )
    + " FROM labelled GROUP BY ALL",
)
SQL["risk_summary"] = sql(
    "features",
    "SELECT asset, "
    + cols("~rolling_volatility_21d = avg(rolling_volatility_21d)", "~drawdown = avg(features.drawdown)")
    + " FROM features GROUP BY asset",
)
SQL["asset_regime_mean"] = sql(
    "labelled",
    f"SELECT asset, {REGIME} AS regime, {rnd('avg(daily_return)')} AS mean_return "
    "FROM labelled GROUP BY ALL",
)

# Score and breadth

_metrics = metrics("crisis", "daily_return", "drawdown", rolling=True)
SQL["defensive_metrics"] = sql("crisis", f"SELECT {cols(*METRIC_COLUMNS)} FROM m", m=_metrics)
SQL["safe_haven_score"] = sql(
    "crisis", f"SELECT {cols(*SCORE_COLUMNS)} FROM s", m=_metrics, s=score("m")
)


def _breadth(source: str, ret: str, fall: str, strict: bool) -> dict[str, str]:
    decline = "count(*) FILTER (WHERE mean_return <= 0)" if strict else (
        "count(*) - count(*) FILTER (WHERE mean_return > 0)"
    )
    percent = "round_even(count(*) FILTER (WHERE {}) * 100.0::DOUBLE / count(*), 1)"
    return {
        "a": f'SELECT asset, avg({ret}) AS mean_return, min({fall}) AS max_drawdown, max("group") AS "group" '
        f"FROM {source} GROUP BY asset",
        "b": f"SELECT max(mean_return) AS mean, max(max_drawdown) AS fall FROM a WHERE asset = '{BENCHMARK}'",
        "counts": f"""SELECT count(*) AS total_assets,
            count(*) FILTER (WHERE mean_return > 0) AS advance_count, {decline} AS decline_count,
            {percent.format('mean_return > 0')} AS pct_positive_crisis,
            {percent.format('mean_return > mean')} AS pct_outperform_std,
            {percent.format('max_drawdown > fall')} AS pct_low_drawdown,
            {rnd('max(mean)')} AS std_mean_crisis_return, {rnd('max(fall)')} AS std_max_drawdown
          FROM a, b HAVING count(*) > 0""",
    }


_by_group = """SELECT "group", count(*) AS total, count(*) FILTER (WHERE mean_return > 0) AS advance,
  {decline} AS decline,
  round_even(count(*) FILTER (WHERE mean_return > 0) * 100.0::DOUBLE / count(*), 1) AS pct_positive
  FROM a WHERE "group" IS NOT NULL GROUP BY "group" """
_fallers = "count(*) FILTER (WHERE mean_return <= 0)"
_others = "count(*) - count(*) FILTER (WHERE mean_return > 0)"
_overall = _breadth("crisis", "daily_return", "drawdown", strict=False)
SQL["market_breadth"] = sql("crisis", "SELECT * FROM counts", **_overall)
SQL["breadth_by_group"] = sql("crisis", _by_group.format(decline=_fallers), a=_overall["a"])
SQL["brand_breadth_by_group"] = sql(
    "brand_features dates",
    _by_group.format(decline=_fallers),
    bc=_brand_crisis,
    a=_breadth("bc", "daily_return", "drawdown", False)["a"],
)

# Events and verdicts


def _pct(value: str, decimals: int = 4, sign: str = "") -> str:
    return f"coalesce(printf('%{sign}.{decimals}f%%', round_even({value} * 100, {decimals})), 'nan%')"


_overall_verdict = f"""
  SELECT 'overall' AS category, 'Candidate in all crises' AS title,
         'Mean daily return = ' || {_pct('c')} || ' (std = ' || {_pct('b')} || '), status ' || status AS body,
         status
  FROM (SELECT c, b, CASE WHEN c > 0 AND c > b THEN 'good' WHEN c > b THEN 'medium' ELSE 'failed' END AS status
        FROM (SELECT count(*) FILTER (WHERE asset = '{CANDIDATE}') AS n,
                     avg(daily_return) FILTER (WHERE asset = '{CANDIDATE}') AS c,
                     CASE WHEN count(*) FILTER (WHERE asset = '{BENCHMARK}') = 0 THEN 0.0
                          ELSE avg(daily_return) FILTER (WHERE asset = '{BENCHMARK}') END AS b
              FROM crisis) WHERE n > 0)"""
_protection = "CASE WHEN c > 0 AND b < 0 THEN 'safe_haven' WHEN c > b THEN 'partial' ELSE 'failed' END"
_event_verdicts = f"""
  SELECT 'crisis_event' AS category, crisis_name AS title,
         'Candidate ' || {_pct('c', 4, '+')} || ', std ' || {_pct('b', 4, '+')} || ' per day: ' || status AS body,
         status
  FROM (SELECT *, {_protection} AS status
        FROM (SELECT crisis_name, count(*) FILTER (WHERE asset = '{CANDIDATE}') AS n,
                     avg(daily_return) FILTER (WHERE asset = '{CANDIDATE}') AS c,
                     CASE WHEN count(*) FILTER (WHERE asset = '{BENCHMARK}') = 0 THEN 0.0
                          ELSE avg(daily_return) FILTER (WHERE asset = '{BENCHMARK}') END AS b
              FROM labelled p {IN_EVENT} GROUP BY crisis_name) WHERE n > 0)"""
SQL["overall_verdict"] = sql("crisis", _overall_verdict.strip())
SQL["event_verdicts"] = sql("labelled events_", _event_verdicts.strip())
SQL["insights"] = sql(
    "crisis events_",
    f"""{_overall_verdict}
  UNION ALL {_event_verdicts}
  UNION ALL
  SELECT 'safe_haven_rank', 'Composite score of six dimensions',
         printf('Candidate ranks #%d of %d assets (score = %.3f)', rank, n, round_even(safe_haven_score, 3)),
         CASE WHEN rank <= 5 THEN 'good' ELSE 'medium' END
  FROM (SELECT *, count(*) OVER () AS n FROM s) WHERE asset = '{CANDIDATE}'
  UNION ALL
  SELECT 'conclusion', 'A conditional safe haven',
         'Protection holds in some crises and fails in others', 'conditional'""",
    m=_metrics,
    s=score("m"),
)
_moves = f"""
  SELECT crisis_name, asset, last / nullif(first, 0) - 1 AS change, low / nullif(first, 0) - 1 AS low
  FROM (SELECT crisis_name, asset, count(*) AS n, arg_min_null(adj_close, date) AS first,
               arg_max_null(adj_close, date) AS last, min(adj_close) AS low
        FROM panel p {IN_EVENT} GROUP BY ALL) WHERE n >= 2"""
SQL["event_performance"] = sql(
    "panel events_",
    f"""SELECT crisis_name, asset, {CLASS} AS class,
               {cols('~return_pct = change * 100', '~max_drawdown_pct = low * 100')},
               {_pct('change', 2, '+')} AS return_text, {_pct('low', 2)} AS max_drawdown_text,
               coalesce(change >= 0, false) AS survived FROM moves""",
    moves=_moves,
)
SQL["event_comparison"] = sql(
    "panel events_",
    f"""SELECT crisis_name, {cols('~candidate_pct = c', '~benchmark_pct = b')}, {_protection} AS verdict
        FROM (SELECT crisis_name, max(round_even(change * 100, 2)) FILTER (WHERE asset = '{CANDIDATE}') AS c,
                     max(round_even(change * 100, 2)) FILTER (WHERE asset = '{BENCHMARK}') AS b
              FROM moves GROUP BY crisis_name) WHERE c IS NOT NULL AND b IS NOT NULL""",
    moves=_moves,
)
SQL["event_rebased"] = sql(
    "panel events_",
    "SELECT crisis_name, asset, date, "
    + rnd("100 * adj_close / nullif(first_value(adj_close) OVER (PARTITION BY crisis_name, asset ORDER BY date), 0)")
    + " AS rebased FROM panel p JOIN events_ e ON p.date BETWEEN e.start_date - 30 AND e.end_date + 10",
)
SQL["event_catalogue"] = sql(
    "panel events_",
    """SELECT e.crisis_name, e.start_date, e.end_date, e.description, c.rows, c.assets
       FROM events_ e LEFT JOIN (
         SELECT crisis_name, count(*) AS rows, count(DISTINCT asset) AS assets
         FROM panel p JOIN events_ e ON p.date BETWEEN e.start_date AND e.end_date GROUP BY 1) c
       USING (crisis_name)""",
)

# Period reports

SQL["period_panel"] = sql(
    "period",
    f"SELECT {cols('date', 'asset', '~period_return', '~period_cum', '~period_drawdown', '~period_volatility')}"
    " FROM period",
)
SQL["period_rebased"] = sql(
    "period", f"SELECT {cols('asset', 'date', '~rebased = (period_cum + 1) * 100')} FROM period"
)
_period_regime = (
    f"SELECT asset, {REGIME} AS regime, avg(period_return) AS mean_return FROM period "
    "WHERE period_return IS NOT NULL GROUP BY ALL"
)
SQL["period_regime"] = sql(
    "period", f"SELECT {cols('asset', 'regime', '~mean_return')} FROM r", r=_period_regime
)
SQL["period_return_ranking"] = sql(
    "period_crisis",
    _ranking("chosen", "period_return"),
    chosen=f"SELECT * FROM period_crisis WHERE asset IN {CHOSEN}",
)
_period_metrics = {
    "m_all": metrics("period_crisis", "period_return", "period_drawdown", rolling=False),
    "m": f"SELECT * FROM m_all WHERE asset IN {CHOSEN}",
    "s": score("m"),
}
SQL["period_ranking"] = sql("period_crisis", f"SELECT {cols(*SCORE_COLUMNS)} FROM s", **_period_metrics)
SQL["period_breadth"] = sql(
    "period_crisis",
    "SELECT * FROM counts",
    **_breadth("period_crisis", "period_return", "period_drawdown", strict=True),
)
SQL["period_breadth_without_benchmark"] = sql(
    "period_crisis",
    "SELECT * FROM counts",
    chosen=f"SELECT * FROM period_crisis WHERE asset IN {CHOSEN}",
    **_breadth("chosen", "period_return", "period_drawdown", strict=True),
)
SQL["period_breadth_by_group"] = sql(
    "period_crisis",
    _by_group.format(decline=_others),
    a=_breadth("period_crisis", "period_return", "period_drawdown", True)["a"],
)
_period_risk = (
    "SELECT asset, avg(period_volatility) AS rolling_volatility, avg(period_drawdown) AS drawdown, "
    "min(period_drawdown) AS max_drawdown, avg(period_return) AS mean_return FROM period "
    "WHERE period_return IS NOT NULL GROUP BY asset"
)
SQL["period_risk"] = sql(
    "period",
    f"SELECT {cols('asset', '~rolling_volatility', '~drawdown', '~max_drawdown', '~mean_return')} FROM r",
    r=_period_risk,
)
SQL["period_empty_selection"] = "SELECT count(*) AS rows FROM lineitem WHERE false"
SQL["regime_top_n"] = sql(
    "period",
    f"""SELECT asset, {CLASS} AS class, {cols('~crisis_pct = c.mean_return * 100', '~normal_pct = n.mean_return * 100')}
        FROM (SELECT * FROM r WHERE regime = 'crisis' ORDER BY abs(mean_return) DESC NULLS LAST, asset LIMIT 4) c
        LEFT JOIN (SELECT * FROM r WHERE regime = 'normal') n USING (asset)""",
    r=_period_regime,
)
SQL["quadrants"] = sql(
    "period",
    f"""SELECT asset, {CLASS} AS class, {cols('~vol_pct = v', '~dd_pct = d', '~vol_median = vm', '~dd_median = dm',
               '~marker_size = greatest(abs(v), 0.05) * 20')},
               CASE WHEN v <= vm AND d >= dm THEN 'calm_shallow' WHEN v <= vm THEN 'calm_deep'
                    WHEN d >= dm THEN 'volatile_shallow' ELSE 'volatile_deep' END AS quadrant
        FROM (SELECT asset, rolling_volatility * 100 AS v, drawdown * 100 AS d,
                     median(rolling_volatility * 100) OVER () AS vm, median(drawdown * 100) OVER () AS dm
              FROM r)""",
    r=_period_risk,
)
SQL["overview"] = sql(
    "period period_crisis",
    f"""SELECT count(DISTINCT asset) AS assets, count(*) AS rows, strftime(min(date), '%Y-%m') AS first_month,
               strftime(max(date), '%Y-%m') AS last_month,
               (SELECT rank FROM s WHERE asset = '{CANDIDATE}') AS candidate_rank,
               (SELECT count(*) FROM s) AS ranked_assets
        FROM period WHERE asset IN {CHOSEN}""",
    **_period_metrics,
)
_facts = {
    "candidate_mean_return": f"(SELECT mean_crisis_return FROM s WHERE asset = '{CANDIDATE}')",
    "candidate_rank": f"(SELECT rank FROM s WHERE asset = '{CANDIDATE}')",
    "ranked_assets": "(SELECT count(*) FROM s)",
    "positive_assets": "(SELECT count(*) FROM s WHERE mean_crisis_return > 0)",
    "candidate_crisis_mean": f"(SELECT mean_return FROM g WHERE regime = 'crisis' AND asset = '{CANDIDATE}')",
    "benchmark_crisis_mean": f"(SELECT mean_return FROM g WHERE regime = 'crisis' AND asset = '{BENCHMARK}')",
    "candidate_volatility": f"(SELECT rolling_volatility FROM r WHERE asset = '{CANDIDATE}')",
    "benchmark_volatility": f"(SELECT rolling_volatility FROM r WHERE asset = '{BENCHMARK}')",
    "last_peer_volatility": "(SELECT rolling_volatility FROM r WHERE asset = 'PROMO')",
}
SQL["insight_facts"] = sql(
    "period period_crisis",
    "\nUNION ALL\n".join(f"SELECT '{n}' AS fact, {rnd(v + '::DOUBLE')} AS value" for n, v in _facts.items()),
    **_period_metrics,
    g=_period_regime,
    r=_period_risk,
)
SQL["data_bounds"] = sql("panel", "SELECT min(date) AS first_date, max(date) AS last_date FROM panel")
SQL["asset_list"] = sql(
    "panel",
    "SELECT DISTINCT asset, asset IN ('ECONOMY','STANDARD','MEDIUM','SMALL','PROMO') AS is_default FROM panel",
)
SQL["display_names"] = sql(
    "panel",
    f"""SELECT asset, {CLASS} AS class, count(*) AS rows FROM (
          SELECT CASE asset WHEN 'ECONOMY' THEN 'Economy line' WHEN 'STANDARD' THEN 'Standard line'
                            ELSE asset END AS asset FROM panel) GROUP BY ALL""",
)

# Portfolio

def _digits(value: str) -> str:
    return (
        f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE round({value} / pow(10.0::DOUBLE, floor(log10(abs({value})))), 8) END"
    )


SQL["portfolio_daily"] = sql("daily", f"SELECT {cols('date', '~portfolio', '~benchmark')} FROM daily")
SQL["portfolio_cumulative"] = sql(
    "levels", f"SELECT date, strategy, {_digits('(level - 1)')} AS cumulative_return FROM levels"
)
SQL["portfolio_drawdown"] = sql(
    "falls", f"SELECT {cols('date', 'strategy', '~drawdown = drawdown * 100')} FROM falls"
)
SQL["portfolio_stats"] = sql(
    "falls",
    f"""SELECT strategy, {_digits('total_return')} AS total_return, {cols('~annual_return', '~annual_volatility',
               '~sharpe_ratio = CASE WHEN annual_volatility > 0 THEN annual_return / annual_volatility ELSE 0.0 END',
               '~max_drawdown')}
        FROM (SELECT *, pow(1 + total_return, 252.0::DOUBLE / n) - 1 AS annual_return
              FROM (SELECT strategy, arg_max(level, date) - 1 AS total_return, count(*) AS n,
                           stddev_samp(r) * sqrt(252.0) AS annual_volatility, min(drawdown) AS max_drawdown
                    FROM falls GROUP BY strategy))""",
)
SQL["portfolio_comparison"] = sql(
    "falls",
    f"""SELECT {cols('~portfolio_max_drawdown = p', '~benchmark_max_drawdown = b', '~difference = b - p')},
               p > b AS improved
        FROM (SELECT min(drawdown * 100) FILTER (WHERE strategy = 'portfolio') AS p,
                     min(drawdown * 100) FILTER (WHERE strategy = 'benchmark') AS b FROM falls)
        WHERE b IS NOT NULL""",
)

# Quality

_report = """
  SELECT {source} AS file, '{kind}' AS type, true AS ok, '' AS error, 0 AS unreadable_dates, count(*) AS rows, '' AS missing_required_cols,
         count(*) - count(DISTINCT date) AS duplicate_rows, CAST(sum({empty}) AS BIGINT) AS na_cell_count,
         strftime(min(date), '%Y-%m-%d 00:00:00') || ' -> ' || strftime(max(date), '%Y-%m-%d 00:00:00')
           AS date_range
  FROM {table} GROUP BY {source}"""
_prices = _report.format(
    source="asset", kind="price", table="landed",
    empty="CAST(close IS NULL AS INTEGER) + CAST(adj_close IS NULL AS INTEGER)",
)
_values = _report.format(source="variable", kind="macro", table="landed_macro", empty="0")
SQL["quality_report_prices"] = sql("gaps", _prices.strip(), landed=LANDED)
SQL["quality_report_macro"] = sql("macro_long", _values.strip(), landed_macro=LANDED_MACRO)
SQL["quality_totals"] = sql(
    "gaps macro_long",
    """SELECT count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows,
              CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows,
              CAST(sum(na_cell_count) AS BIGINT) AS na_cell_count,
              CAST(sum(unreadable_dates) AS BIGINT) AS unreadable_dates FROM reports""",
    landed=LANDED,
    landed_macro=LANDED_MACRO,
    reports=f"{_prices} UNION ALL {_values}",
)
_shapes = """
  SELECT asset AS file, 'price' AS type, count(*) AS n, count(*) FILTER (WHERE day(date) IN (13, 14)) AS gaps,
         strftime(min(date), '%Y-%m-%d 00:00:00') || ' -> ' || strftime(max(date), '%Y-%m-%d 00:00:00') AS span
  FROM panel GROUP BY asset UNION ALL SELECT 'VOID', 'price', 0, 0, ''"""
_mixed = """
  SELECT file, type, file NOT IN ('MEDIUM', 'STANDARD', 'VOID') AS ok,
         CASE file WHEN 'VOID' THEN 'empty file' WHEN 'STANDARD' THEN 'a row has 9 cells, the header 8' ELSE '' END AS error,
         CASE WHEN file = 'STANDARD' THEN 0 ELSE n END AS rows,
         CASE WHEN file = 'MEDIUM' THEN 'Volume' ELSE '' END AS missing_required_cols, 0 AS duplicate_rows,
         CASE WHEN file = 'PROMO' THEN gaps ELSE 0 END AS na_cell_count, 0 AS unreadable_dates,
         CASE WHEN file IN ('STANDARD', 'VOID') THEN '' ELSE span END AS date_range FROM shapes"""
SQL["quality_report_mixed"] = sql("panel", _mixed.strip(), shapes=_shapes)
SQL["quality_gate_mixed"] = sql(
    "panel",
    """SELECT * FROM (SELECT count(*) AS files, CAST(sum(rows) FILTER (WHERE ok) AS BIGINT) AS rows,
              CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows,
              CAST(sum(na_cell_count) FILTER (WHERE ok) AS BIGINT) AS na_cell_count,
              CAST(sum(unreadable_dates) AS BIGINT) AS unreadable_dates, true AS size_mb FROM mixed),
            (VALUES ('PASS', 0.0::DOUBLE), ('FAIL', 1e9::DOUBLE)) AS gates(gate, limit_mb)""",
    shapes=_shapes,
    mixed=_mixed,
)
SQL["price_scan_mixed"] = sql(
    "panel",
    """SELECT asset, count(*) AS rows,
              count(*) FILTER (WHERE NOT (asset = 'PROMO' AND day(date) IN (13, 14))) AS open, count(*) AS close,
              count(*) AS adj_close, count(*) FILTER (WHERE asset <> 'MEDIUM') AS volume
       FROM panel WHERE asset <> 'STANDARD' GROUP BY asset""",
)
_source = """CASE day(date) % 4 WHEN 1 THEN asset || chr(10) || 'said "' || strftime(date, '%d') || '", then' || chr(10) || chr(10) || 'done'
  WHEN 2 THEN '"quoted"' WHEN 3 THEN 'a,b' || chr(10) || '"' ELSE 'plain' END"""
SQL["price_scan_quoted"] = sql(
    "panel", f"SELECT date AS Date, asset, {_source} AS source, {rnd('close')} AS close FROM panel WHERE asset <> 'PROMO'"
)
SQL["quality_report_quoted"] = sql(
    "panel",
    """SELECT asset AS file, false AS ok, CASE asset WHEN 'PROMO' THEN 'a quote that is not closed' ELSE '' END AS error,
              CASE asset WHEN 'PROMO' THEN 0 ELSE count(*) END AS rows, 0 AS duplicate_rows,
              CASE asset WHEN 'PROMO' THEN '' ELSE strftime(min(date), '%Y-%m-%d 00:00:00') || ' -> ' || strftime(max(date), '%Y-%m-%d 00:00:00') END AS date_range
       FROM panel GROUP BY asset""",
)
_all = [c.lstrip("~") for c in (*_bar, *_feature)] + ["group"]
SQL["null_profile"] = sql(
    "gap_features",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls FROM gap_features"
        for c in _all
    ).replace("AS column", 'AS "column"'),
)
_meta = [
    "date", "asset", "daily_return", "drawdown", "adj_close", "std_drawdown", "STRESS", "YIELD", "RECESSION",
    "PRICE_INDEX", "inflation_yoy", "STRESS", "RECESSION", "PRICE_INDEX", "YIELD", *CORR_COLUMNS,
    "crisis_by_stress", "crisis_by_recession", "crisis_by_std_drawdown", "final_crisis_label",
    "econ_safe_haven_success",
]
_empty = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _meta)
SQL["panel_metadata"] = sql(
    "labelled",
    f"""SELECT 'total_assets_tracked' AS metric, CAST(count(DISTINCT asset) AS VARCHAR) AS value FROM labelled
        UNION ALL SELECT 'labeled_dataset_rows', CAST(count(*) AS VARCHAR) FROM labelled
        UNION ALL SELECT 'missing_cells_in_labeled', CAST({_empty} AS VARCHAR) FROM labelled
        UNION ALL SELECT 'crisis_days', CAST(count(*) AS VARCHAR) FROM dates WHERE final_crisis_label = 1
        UNION ALL SELECT 'normal_days', CAST(count(*) AS VARCHAR) FROM dates WHERE final_crisis_label = 0""",
)

_measured = ("read_csv_sec", "read_parquet_sec", "master_csv_size_mb", "master_parquet_size_mb", "compression_ratio")
_storage = (*_measured, "spark_status", "spark_partition_write_sec")
SQL["storage_facts"] = sql(
    "panel",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) > 0 AS sound FROM panel" for m in (*_storage, "partition_rows")),
)
SQL["one_partition"] = sql(
    "panel",
    f"SELECT date, asset, {rnd('close')} AS close, 1998 AS year FROM panel WHERE asset = 'SMALL' AND year(date) = 1998",
)
SQL["pipeline_metadata"] = sql(
    "labelled panel macro_long",
    f"""SELECT 'total_assets_tracked' AS metric, CAST(count(DISTINCT asset) AS VARCHAR) AS value FROM labelled
        UNION ALL SELECT 'labeled_dataset_rows', CAST(count(*) AS VARCHAR) FROM labelled
        UNION ALL SELECT 'missing_cells_in_labeled', CAST({_empty} AS VARCHAR) FROM labelled
        UNION ALL SELECT 'crisis_days', CAST(count(*) AS VARCHAR) FROM dates WHERE final_crisis_label = 1
        UNION ALL SELECT 'normal_days', CAST(count(*) AS VARCHAR) FROM dates WHERE final_crisis_label = 0
        UNION ALL SELECT 'price_raw_files', CAST(count(DISTINCT asset) AS VARCHAR) FROM panel
        UNION ALL SELECT 'macro_raw_files', CAST(count(DISTINCT variable) AS VARCHAR) FROM macro_long
        UNION ALL SELECT 'total_raw_files', CAST((SELECT count(DISTINCT asset) FROM panel)
                                                + (SELECT count(DISTINCT variable) FROM macro_long) AS VARCHAR)
        UNION ALL SELECT 'spark_output_files', '3' UNION ALL SELECT 'spark_status', 'OK' """
    + " ".join(f"UNION ALL SELECT '{m}', 'true'" for m in (*_measured, "spark_partition_write_sec")),
)

# Reports cut from one pass hold the rows of the reports that read the panel themselves.
for _name in ("stats_per_asset", "risk_detail", "return_ranking", "market_breadth"):
    SQL[f"one_pass_{_name}"] = SQL[_name]

# Learning

_lags = tuple(f"~{c}" for c in LAGS)
SQL["training_table"] = sql("training", f"SELECT {cols('date', 'label', *_lags)} FROM training")
SQL["training_gate"] = sql(
    "training",
    """SELECT 'default' AS gate, CASE WHEN count(*) >= 50 THEN count(*) ELSE 0 END AS rows FROM training
       UNION ALL SELECT 'unreachable', CASE WHEN count(*) >= 1000000000 THEN count(*) ELSE 0 END FROM training""",
)
SQL["ts_folds"] = sql(
    "folds",
    "SELECT fold, role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date "
    "FROM folds GROUP BY ALL",
)
SQL["missing_report"] = sql(
    "training",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"{rnd(f'count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / nullif(count(*), 0)')} AS missing_rate FROM training"
        for c in LAGS
    ),
)
for _name, _source in (("fold_imputed", "imputed"), ("fold_standardized", "standardized")):
    SQL[_name] = sql(_source, f"SELECT {cols('fold', 'role', 'date', 'label', *_lags)} FROM {_source}")
_scores = ("~accuracy", "~precision", "~recall", "~f1", "~roc_auc")
SQL["fold_metrics"] = sql(
    "fold_metrics", f"SELECT {cols('fold', 'model', *_scores, 'train_size', 'test_size')} FROM fold_metrics"
)
_board = cols("model", *_scores, "~accuracy_std", "~f1_std")
SQL["leaderboard"] = sql("board", f"SELECT {_board} FROM board")
SQL["best_model"] = sql(
    "board",
    f"""SELECT {_board} FROM board
        ORDER BY f1 DESC NULLS LAST, list_position(['momentum','reversal','hedge'], model) LIMIT 1""",
)
SQL["model_scores"] = sql(
    "board",
    "\nUNION ALL\n".join(
        f"SELECT model, '{c}' AS metric, {rnd(c)} AS score FROM board"
        for c in ("accuracy", "f1", "roc_auc", "precision", "recall")
    ),
)
_last = "FROM predictions WHERE fold = (SELECT max(fold) FROM predictions)"
SQL["confusion"] = sql(
    "predictions",
    "\nUNION ALL\n".join(
        f"SELECT model, 'true_{t}' AS truth, count(*) FILTER (WHERE label = {t} AND prediction = 0) AS pred_0, "
        f"count(*) FILTER (WHERE label = {t} AND prediction = 1) AS pred_1 {_last} GROUP BY model"
        for t in (0, 1)
    ),
)
SQL["confusion_accuracy"] = sql(
    "predictions",
    f"SELECT model, count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total, "
    f"{rnd('count(*) FILTER (WHERE label = prediction)::DOUBLE / count(*)')} AS accuracy {_last} GROUP BY model",
)
_models = "(VALUES ('LogisticRegression'), ('RandomForest'), ('GradientBoosting')) AS models(model)"
SQL["ml_fold_facts"] = sql(
    "folds",
    f"""SELECT model, fold, count(*) FILTER (WHERE role = 'train') AS train_size,
               count(*) FILTER (WHERE role = 'test') AS test_size,
               CAST(sum(label) FILTER (WHERE role = 'test') AS BIGINT) AS positives,
               true AS prediction_is_score, true AS in_range
        FROM folds, {_models} GROUP BY model, fold""",
)
_names = ", ".join(f"('{c}')" for c in LAGS)
SQL["ml_logistic_gradient"] = sql(
    "folds",
    f"""SELECT DISTINCT fold, feature, 0.0::DOUBLE AS gradient
        FROM folds, (VALUES {_names}, ('constant')) AS names(feature)""",
)
_long = f"SELECT * FROM (UNPIVOT (SELECT * FROM standardized WHERE role = 'train') ON {', '.join(LAGS)} INTO NAME feature VALUE x)"
_cuts = """SELECT fold, feature, list_sort(list_distinct(list_transform(range(1, 256), lambda j: sorted[(j * len(sorted)) // 256 + 1]))) AS cuts
  FROM (SELECT fold, feature, list_sort(list(x)) AS sorted FROM long GROUP BY fold, feature)"""
_tried = """SELECT fold, feature, cut, sum(0.5 - label) AS g, count(*) * 0.25 AS h,
    coalesce(sum(0.5 - label) FILTER (WHERE x < cut), 0) AS gl, count(*) FILTER (WHERE x < cut) * 0.25 AS hl
  FROM long JOIN (SELECT fold, feature, unnest(cuts) AS cut FROM cuts) USING (fold, feature) GROUP BY fold, feature, cut"""
_gained = """SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM tried WHERE hl >= 1 AND h - hl >= 1"""
_order = ", ".join(f"'{c}'" for c in LAGS)
SQL["boosting_first_split"] = sql(
    "standardized",
    f"""SELECT fold, feature, {rnd('cut')} AS threshold, {rnd('gain')} AS gain, {rnd('-0.05 * gl / (hl + 1)')} AS left_weight,
               {rnd('-0.05 * (g - gl) / (h - hl + 1)')} AS right_weight
        FROM gained QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, list_position([{_order}], feature), cut) = 1""",
    long=_long,
    cuts=_cuts,
    tried=_tried,
    gained=_gained,
)
SQL["boosting_histogram"] = sql(
    "standardized",
    """SELECT fold, feature, len(list_filter(cuts, lambda c: c <= x))::INTEGER AS bin, count(*) AS rows,
              CAST(sum(0.5 - label) AS DOUBLE) AS gradient, CAST(count(*) * 0.25 AS DOUBLE) AS curvature
       FROM long JOIN cuts USING (fold, feature) GROUP BY ALL""",
    long=_long,
    cuts=_cuts,
)
SQL["importance_facts"] = sql(
    "training",
    f"""SELECT model, feature, true AS not_negative, true AS whole
        FROM {_models}, (VALUES {_names}) AS names(feature) WHERE (SELECT count(*) FROM training) > 0""",
)
_medians = ", ".join(f"{rnd(f'median(CAST({c} AS DOUBLE))')} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
SQL["grouped_medians"] = f"SELECT l_returnflag, l_linestatus, {_medians} FROM lineitem GROUP BY l_returnflag, l_linestatus"
SQL["instants_in_intervals"] = f"""WITH errors AS (
    SELECT event_id AS error_id, ts AS opened, CASE WHEN ts < max(ts) OVER (PARTITION BY user_id)
      THEN ts + to_minutes(CAST(floor(value) AS INTEGER)) ELSE TIMESTAMP '9999-01-01' END AS closed
    FROM events WHERE event_type = 'error')
  SELECT error_id, count(*) AS events, {rnd('sum(value)')} AS value, max(event_id) AS last_event_id
  FROM errors JOIN events ON ts >= opened AND ts <= closed GROUP BY error_id"""
SQL["best_confusion"] = sql(
    "predictions board",
    " UNION ALL ".join(
        f"SELECT model, 'true_{t}' AS truth, count(*) FILTER (WHERE label = {t} AND prediction = 0) AS pred_0, "
        f"count(*) FILTER (WHERE label = {t} AND prediction = 1) AS pred_1 {_last} "
        f"AND model = (SELECT model FROM board ORDER BY f1 DESC NULLS LAST, "
        f"list_position(['momentum','reversal','hedge'], model) LIMIT 1) GROUP BY model"
        for t in (0, 1)
    ),
)
