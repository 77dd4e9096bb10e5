"""Common table expressions the statements are put together from."""

from __future__ import annotations

CANDIDATE, BENCHMARK = "ECONOMY", "STANDARD"
PEERS = {"medium": "MEDIUM", "small": "SMALL", "promo": "PROMO"}
ROLES = {"econ": CANDIDATE, "std": BENCHMARK, **PEERS}
MACRO = ("STRESS", "YIELD", "RECESSION", "PRICE_INDEX")
EVENTS = (
    ("ev1", "1995-03-01", "1995-06-30", "four months"),
    ("ev2", "1996-01-15", "1997-01-14", "one year"),
    ("ev3", "1996-12-01", "1997-03-31", "overlaps ev2"),
    ("ev4", "1999-05-01", "1999-05-20", "short"),
    ("ev5", "2000-02-01", "2001-02-01", "one year"),
    ("ev6", "2010-01-01", "2010-02-01", "no data"),
)


def rnd(value: str) -> str:
    return f"(round({value}, 8) + 0.0)"


def cols(*pairs: str) -> str:
    """``name`` or ``name = expression``; a leading ``~`` rounds."""
    out = []
    for pair in pairs:
        name, _, value = (p.strip() for p in pair.partition("="))
        value = value or name.lstrip("~")
        out.append(f"{rnd(value)} AS {name[1:]}" if name.startswith("~") else f"{value} AS {name}")
    return ", ".join(out)


def _bars(asset: str, group: str) -> str:
    return f"""
  SELECT date, low, high, open, close,
         CASE WHEN day(date) % 7 <> 0 THEN close END AS adj_close, volume, asset, {group} AS "group"
  FROM (SELECT {asset} AS asset, CAST(l_shipdate AS DATE) AS date,
               50 + min(l_quantity) AS low, 50 + max(l_quantity) AS high,
               50 + (min(l_quantity) + max(l_quantity)) / 2 AS open,
               50 + sum(l_quantity) / count(*) AS close, sum(l_quantity) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


PANEL = _bars(
    "p_type",
    "CASE WHEN asset IN ('ECONOMY','SMALL') THEN 'value' WHEN asset IN ('STANDARD','MEDIUM') THEN 'core' "
    "WHEN asset IN ('LARGE','PROMO') THEN 'growth' END",
)
BRAND = _bars(
    "p_brand", "'g' || CAST(CAST(regexp_extract(asset, '([0-9]+)$', 1) AS INTEGER) % 5 AS VARCHAR)"
)
GAPS = """
  SELECT * REPLACE (CASE WHEN day(date) <> 13 THEN close END AS close,
                    CASE WHEN day(date) <> 13 THEN adj_close END AS adj_close) FROM {source}"""

MACRO_LONG = """
  SELECT CAST(o_orderdate AS DATE) AS date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'STRESS' ELSE 'YIELD' END AS variable,
         max(o_totalprice) / CASE o_orderpriority WHEN '1-URGENT' THEN 10000 ELSE 100000 END AS value
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2, o_orderpriority
  UNION ALL
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE), 'RECESSION',
         CASE WHEN month(date_trunc('month', o_orderdate)) % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE
  FROM orders GROUP BY date_trunc('month', o_orderdate)
  UNION ALL
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE), 'PRICE_INDEX', 100 + count(*)::DOUBLE / 10
  FROM orders GROUP BY date_trunc('month', o_orderdate)"""

MACRO_WIDE = "SELECT date, " + ", ".join(
    f"max(value) FILTER (WHERE variable = '{v}') AS {v}" for v in MACRO
) + " FROM macro_long GROUP BY date"


def filled(value: str, order: str = "PARTITION BY asset ORDER BY date") -> str:
    return f"last_value({value} IGNORE NULLS) OVER ({order} ROWS UNBOUNDED PRECEDING)"


MACRO_FILLED = ", ".join(f"{filled(v, 'ORDER BY date')} AS {v}" for v in MACRO)


def on_dates(panel: str) -> str:
    """Macro values on panel dates, carried forward."""
    return f"""
  SELECT date, {MACRO_FILLED}
  FROM (SELECT DISTINCT date FROM {panel}) LEFT JOIN macro_wide USING (date)"""


ASOF = f"""
  SELECT * EXCLUDE (present) FROM (
    SELECT date, present, {MACRO_FILLED}
    FROM (SELECT DISTINCT date, true AS present FROM panel) FULL JOIN macro_wide USING (date))
  WHERE present"""


def _roll(aggregate: str, value: str, n: int) -> str:
    frame = f"(PARTITION BY asset ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN {aggregate}({value}) OVER {frame} END"


def features(source: str) -> str:
    """Per-asset features of a panel."""
    w = "(PARTITION BY asset ORDER BY date)"
    running = "(PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"
    changes = ", ".join(
        f"carried / nullif(lag(carried, {n}) OVER {w}, 0) - 1 AS return_{n}d" for n in (5, 21, 63)
    )
    averages = ", ".join(f"{_roll('avg', 'px', n)} AS ma_{n}" for n in (20, 50, 200))
    return f"""
  SELECT * EXCLUDE (px, carried),
         ln(1 + CASE WHEN daily_return > -1 THEN daily_return END) AS log_return,
         close - open AS daily_change,
         product(1 + coalesce(daily_return, 0)) OVER {running} - 1 AS cumulative_return,
         {_roll('stddev_samp', 'daily_return', 21)} AS rolling_volatility_21d,
         {_roll('stddev_samp', 'daily_return', 63)} AS rolling_volatility_63d,
         min(drawdown) OVER (PARTITION BY asset) AS max_drawdown
  FROM (SELECT *, carried / nullif(lag(carried) OVER {w}, 0) - 1 AS daily_return,
               {_roll('avg', 'px', 21)} AS rolling_mean_21d,
               px / nullif(max(px) OVER {running}, 0) - 1 AS drawdown,
               {_roll('max', 'px', 63)} AS rolling_high, {averages}, {changes}
        FROM (SELECT *, coalesce(adj_close, close) AS px,
                     {filled('coalesce(adj_close, close)')} AS carried FROM {source}))"""


SPINE = (
    "SELECT date, "
    + ", ".join(f"max(daily_return) FILTER (WHERE asset = '{a}') AS {n}" for n, a in ROLES.items())
    + f", max(drawdown) FILTER (WHERE asset = '{BENCHMARK}') AS std_drawdown"
    + f", bool_or(asset = '{BENCHMARK}') AS has_std, bool_or(daily_return IS NOT NULL) AS counted"
    + " FROM features GROUP BY date"
)


def corr(other: str, n: int, calendar: str = "union") -> str:
    """Rolling correlation with the candidate over rows of a calendar."""
    both = f"(econ IS NOT NULL AND {other} IS NOT NULL)"
    rows = "counted" if calendar == "union" else both
    over = f"OVER (PARTITION BY {rows} ORDER BY date ROWS {n - 1} PRECEDING)"
    x, y = f"CASE WHEN {both} THEN econ END", f"CASE WHEN {both} THEN {other} END"
    spread = f"(stddev_samp({x}) {over} * stddev_samp({y}) {over})"
    return (
        f"CASE WHEN count({x}) {over} = {n} "
        f"THEN covar_samp({x}, {y}) {over} / nullif({spread}, 0) END"
    )


CORR_COLUMNS = {
    "rolling_corr_econ_std_30d": ("std", 30),
    "rolling_corr_econ_std_90d": ("std", 90),
    "rolling_corr_econ_medium_90d": ("medium", 90),
    "rolling_corr_econ_small_90d": ("small", 90),
    "rolling_corr_econ_promo_90d": ("promo", 90),
}

DATES = f"""
  SELECT *, CASE WHEN final_crisis_label = 1 AND econ IS NOT NULL AND std IS NOT NULL
                 THEN CASE WHEN econ > std OR (econ >= 0 AND std < 0) THEN 1.0 ELSE 0.0 END
            END::DOUBLE AS econ_safe_haven_success
  FROM (SELECT *, CAST(coalesce(crisis_by_stress = 1, false) OR coalesce(crisis_by_recession = 1, false)
                       OR coalesce(crisis_by_std_drawdown = 1, false) AS INTEGER) AS final_crisis_label
        FROM (SELECT spine.*, m.* EXCLUDE (date),
                CASE WHEN STRESS >= 48 THEN 1 ELSE 0 END AS crisis_by_stress,
                CASE WHEN RECESSION >= 1 THEN 1 ELSE 0 END AS crisis_by_recession,
                CASE WHEN has_std THEN CASE WHEN std_drawdown <= -0.30 THEN 1 ELSE 0 END END
                  AS crisis_by_std_drawdown,
                PRICE_INDEX / nullif(lag(PRICE_INDEX, 252) OVER (ORDER BY spine.date), 0) - 1
                  AS inflation_yoy,
                {", ".join(f"{corr(o, n)} AS {c}" for c, (o, n) in CORR_COLUMNS.items())}
              FROM spine JOIN on_dates m USING (date)))"""

LABELLED = """
  SELECT f.*, d.* EXCLUDE (date, econ, std, medium, small, promo, has_std, counted)
  FROM features f LEFT JOIN dates d USING (date)"""

EVENT_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', DATE '{s}', DATE '{e}', '{d}')" for n, s, e, d in EVENTS
) + ") AS t(crisis_name, start_date, end_date, description)"

PERIOD = f"""
  SELECT date, asset, "group", adj_close, final_crisis_label, period_return,
         adj_close / nullif(first_value(adj_close IGNORE NULLS) OVER (
           PARTITION BY asset ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) - 1 AS period_cum,
         adj_close / nullif(max(adj_close) OVER (
           PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1 AS period_drawdown,
         CASE WHEN count(period_return) OVER w30 >= 10 THEN stddev_samp(period_return) OVER w30 END
           AS period_volatility
  FROM (SELECT *, carried / nullif(lag(carried) OVER (PARTITION BY asset ORDER BY date), 0) - 1
               AS period_return
        FROM (SELECT *, {filled('adj_close')} AS carried FROM labelled
              WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'))
  WINDOW w30 AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)"""

REGIME = "CASE WHEN final_crisis_label = 1 THEN 'crisis' ELSE 'normal' END"
CLASS = (
    "CASE WHEN asset IN ('ECONOMY', 'Economy line') THEN 'candidate' "
    "WHEN asset IN ('MEDIUM', 'LARGE') THEN 'bulk' ELSE 'other' END"
)
HIT = "avg(CASE WHEN {0} > 0 THEN 1.0 WHEN {0} IS NOT NULL THEN 0.0 END)"


def metrics(source: str, ret: str, fall: str, rolling: bool) -> str:
    """Raw score metrics of crisis rows."""
    pearson = f"""CASE WHEN count(b.date) >= 10 THEN covar_samp({ret}, b.bench) / nullif(
      stddev_samp(CASE WHEN b.bench IS NOT NULL THEN {ret} END)
      * stddev_samp(CASE WHEN {ret} IS NOT NULL THEN b.bench END), 0) END"""
    if rolling:
        pearson = (
            f"CASE WHEN asset = '{CANDIDATE}' THEN avg(rolling_corr_econ_std_90d) ELSE {pearson} END"
        )
    return f"""
  SELECT asset, avg({ret}) AS mean_crisis_return,
         coalesce(count(*) FILTER (WHERE {ret} > b.bench)::DOUBLE / nullif(count(b.date), 0), 0.0)
           AS outperform_std_rate,
         min({fall}) AS max_drawdown_crisis, stddev_samp({ret}) AS crisis_volatility,
         coalesce({pearson}, 0.0) AS corr_with_std,
         {HIT.format(ret)} AS hit_rate, count({ret}) AS crisis_days
  FROM {source} c
  LEFT JOIN (SELECT date, {ret} AS bench FROM {source} WHERE asset = '{BENCHMARK}') b USING (date)
  GROUP BY asset HAVING count({ret}) >= 5"""


def score(source: str) -> str:
    """z-scores, composite score and rank over a metrics table."""
    parts = {
        "z_return": "mean_crisis_return",
        "z_outperform": "outperform_std_rate",
        "z_drawdown": "-abs(max_drawdown_crisis)",
        "z_vol": "-crisis_volatility",
        "z_corr": "-corr_with_std",
        "z_hit": "hit_rate",
    }
    z = ", ".join(
        f"CASE WHEN coalesce(stddev_samp({v}) OVER (), 0) = 0 THEN 0.0 "
        f"ELSE ({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () END AS {n}"
        for n, v in parts.items()
    )
    return f"""
  SELECT *, row_number() OVER (ORDER BY safe_haven_score DESC NULLS LAST, asset) AS rank
  FROM (SELECT *, 0.25 * z_return + 0.20 * z_outperform + 0.15 * z_drawdown + 0.10 * z_vol
               + 0.15 * z_corr + 0.15 * z_hit AS safe_haven_score
        FROM (SELECT *, {z} FROM {source}))"""


SCORE_COLUMNS = (
    "asset", "~mean_crisis_return", "~outperform_std_rate", "~max_drawdown_crisis",
    "~crisis_volatility", "~corr_with_std", "~hit_rate", "crisis_days", "~z_return", "~z_outperform",
    "~z_drawdown", "~z_vol", "~z_corr", "~z_hit", "~safe_haven_score", "rank",
)
METRIC_COLUMNS = SCORE_COLUMNS[:8]

PORTFOLIO_DAILY = """
  SELECT date, sum(w * r) AS portfolio, max(r) FILTER (WHERE asset = 'STANDARD') AS benchmark
  FROM (SELECT * FROM (
          SELECT date, asset, carried / nullif(lag(carried) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS r
          FROM (SELECT date, asset, last_value(adj_close IGNORE NULLS) OVER (
                  PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS carried
                FROM panel WHERE asset IN ('ECONOMY', 'STANDARD', 'MEDIUM')))
        WHERE r IS NOT NULL)
  JOIN (VALUES ('ECONOMY', 50.0/120), ('STANDARD', 30.0/120), ('MEDIUM', 40.0/120)) AS v(asset, w)
    USING (asset)
  GROUP BY date HAVING count(*) = 3"""
LEVELS = """
  SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS level
  FROM (SELECT date, 'portfolio' AS strategy, portfolio AS r FROM daily
        UNION ALL SELECT date, 'benchmark', benchmark FROM daily WHERE benchmark IS NOT NULL)"""
FALLS = """
  SELECT *, level / max(level) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1
           AS drawdown FROM levels"""

FEATURE_LAGS = {
    "daily_return": "f.daily_return",
    "std_daily_return": "b.daily_return",
    "rolling_volatility_21d": "f.rolling_volatility_21d",
    "rolling_volatility_63d": "f.rolling_volatility_63d",
    "drawdown": "f.drawdown",
    "rolling_corr_econ_std_90d": "f.rolling_corr_econ_std_90d",
    "stress_level": "f.STRESS",
    "recession_flag": "f.RECESSION",
    "inflation_yoy": "f.inflation_yoy",
    "real_yield": "f.YIELD",
}
LAGS = tuple(f"{c}_lag1" for c in FEATURE_LAGS)
TRAINING = (
    "SELECT * FROM (SELECT f.date, CAST(f.econ_safe_haven_success AS INTEGER) AS label, "
    + ", ".join(f"lag({v}) OVER (ORDER BY f.date) AS {c}_lag1" for c, v in FEATURE_LAGS.items())
    + f" FROM (SELECT * FROM labelled WHERE asset = '{CANDIDATE}') f"
    + f" LEFT JOIN (SELECT date, daily_return FROM labelled WHERE asset = '{BENCHMARK}') b USING (date))"
    + " WHERE label IS NOT NULL"
)
FOLDS = """
  SELECT * EXCLUDE (i, n, k, t), CASE WHEN i <= n - (k - fold + 1) * t THEN 'train' ELSE 'test' END AS role
  FROM (SELECT *, CAST(unnest(range(1, k + 1)) AS INTEGER) AS fold
        FROM (SELECT *, n // (k + 1) AS t
              FROM (SELECT *, least(5, greatest(2, n // 30)) AS k
                    FROM (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
                          FROM training))))
  WHERE i <= n - (k - fold) * t"""
IMPUTED = (
    "SELECT fold, role, date, label, "
    + ", ".join(f"coalesce(f.{c}, m.{c}, 0.0) AS {c}" for c in LAGS)
    + " FROM folds f JOIN (SELECT fold, "
    + ", ".join(f"median({c}) AS {c}" for c in LAGS)
    + " FROM folds WHERE role = 'train' GROUP BY fold) m USING (fold)"
)
STANDARDIZED = (
    "SELECT fold, role, date, label, "
    + ", ".join(
        f"(f.{c} - m.m_{c}) / CASE WHEN m.s_{c} > 0 THEN m.s_{c} ELSE 1.0 END AS {c}" for c in LAGS
    )
    + " FROM imputed f JOIN (SELECT fold, "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LAGS)
    + " FROM imputed WHERE role = 'train' GROUP BY fold) m USING (fold)"
)
PREDICTIONS = """
  SELECT fold, date, label, model, round(score, 12) AS score, CASE WHEN round(score, 12) > 0 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT fold, date, label, 'momentum' AS model, coalesce(daily_return_lag1, 0.0) AS score FROM folds WHERE role = 'test'
        UNION ALL SELECT fold, date, label, 'reversal', -coalesce(daily_return_lag1, 0.0) FROM folds WHERE role = 'test'
        UNION ALL SELECT fold, date, label, 'hedge', -coalesce(std_daily_return_lag1, 0.0) FROM folds WHERE role = 'test')"""
FOLD_METRICS = """
  SELECT c.fold, model, right_::DOUBLE / n AS accuracy, coalesce(tp::DOUBLE / nullif(pp, 0), 0.0) AS precision,
         coalesce(tp::DOUBLE / nullif(p, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(p + pp, 0), 0.0) AS f1,
         (ranks - p * (p + 1) / 2.0) / nullif(p * (n - p), 0) AS roc_auc, train_size, test_size
  FROM (SELECT fold, model, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS right_,
               count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE prediction = 1) AS pp,
               count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
               sum(r) FILTER (WHERE label = 1) AS ranks
        FROM (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY score)
                       + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0 AS r FROM predictions)
        GROUP BY fold, model) c
  JOIN (SELECT fold, count(*) FILTER (WHERE role = 'train') AS train_size,
               count(*) FILTER (WHERE role = 'test') AS test_size FROM folds GROUP BY fold) s USING (fold)"""
BOARD = """
  SELECT model, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
         avg(roc_auc) AS roc_auc, stddev_pop(accuracy) AS accuracy_std, stddev_pop(f1) AS f1_std
  FROM fold_metrics GROUP BY model"""

TABLES = {
    "panel": PANEL,
    "gaps": GAPS.format(source="panel"),
    "macro_long": MACRO_LONG,
    "macro_wide": MACRO_WIDE,
    "on_dates": on_dates("panel"),
    "latest": ASOF,
    "features": features("panel"),
    "gap_features": features("gaps"),
    "brand": BRAND,
    "brand_features": features("brand"),
    "spine": SPINE,
    "dates": DATES,
    "labelled": LABELLED,
    "crisis": "SELECT * FROM labelled WHERE final_crisis_label = 1",
    "events_": EVENT_ROWS,
    "period": PERIOD,
    "period_crisis": "SELECT * FROM period WHERE final_crisis_label = 1 AND period_return IS NOT NULL",
    "daily": PORTFOLIO_DAILY,
    "levels": LEVELS,
    "falls": FALLS,
    "training": TRAINING,
    "folds": FOLDS,
    "imputed": IMPUTED,
    "standardized": STANDARDIZED,
    "predictions": PREDICTIONS,
    "fold_metrics": FOLD_METRICS,
    "board": BOARD,
}
NEEDS = {
    "gaps": ["panel"],
    "macro_wide": ["macro_long"],
    "on_dates": ["panel", "macro_wide"],
    "latest": ["panel", "macro_wide"],
    "features": ["panel"],
    "gap_features": ["gaps"],
    "brand_features": ["brand"],
    "spine": ["features"],
    "dates": ["spine", "on_dates"],
    "labelled": ["dates"],
    "crisis": ["labelled"],
    "period": ["labelled"],
    "period_crisis": ["period"],
    "daily": ["panel"],
    "levels": ["daily"],
    "falls": ["levels"],
    "training": ["labelled"],
    "folds": ["training"],
    "imputed": ["folds"],
    "standardized": ["imputed"],
    "predictions": ["folds"],
    "fold_metrics": ["predictions"],
    "board": ["fold_metrics"],
}


def sql(needs: str, select: str, **extra: str) -> str:
    """Statement with the named tables (and what they rest on) as CTEs, in order, then ``extra``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs.split():
        add(name)
    parts = [(n, TABLES[n]) for n in wanted] + list(extra.items())
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({body})" for n, body in parts)
    return f"WITH {ctes}\n{select}"
