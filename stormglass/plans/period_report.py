"""All statistics for a chosen date range, rolling window and asset list."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from stormglass.config import MARKET, Profile
from stormglass.functions.staging import staged
from stormglass.operators import breadth as B
from stormglass.operators import period as P
from stormglass.operators import portfolio as PF
from stormglass.operators import score as SC
from stormglass.operators import stats as ST
from stormglass.operators.labels import LABEL


def period_report(
    panel: DataFrame,
    start: str,
    end: str,
    window: int = 90,
    assets: list[str] | None = None,
    profile: Profile = MARKET,
    weights: Mapping[str, float] | None = None,
    top: int = 15,
) -> dict[str, DataFrame]:
    """Result tables by name over an analysis panel.

    The period panel is written once and shared. The ranking sees every asset of the range, so the
    benchmark is there even if it is not chosen; all other tables see the chosen assets only.
    """
    chosen = list(profile.default_assets) if assets is None else assets
    kept = panel.select("date", "asset", "group", "adj_close", LABEL)
    everything = staged(P.period_panel(kept, start, end, window), "period")
    rows = P.filter_assets(everything, chosen)
    ranking = SC.period_ranking(everything, profile, chosen)
    regimes, risk = P.period_regime_means(rows), P.period_risk(rows)
    tables = {
        "overview": P.overview(rows, ranking, profile),
        "rebased": P.rebased(rows),
        "market_breadth": B.period_breadth(rows, profile),
        "breadth_by_group": B.period_breadth_by_group(rows),
        "regime_means": regimes,
        "regime_comparison": ST.regime_comparison(regimes, profile, top),
        "return_ranking": P.period_return_ranking(rows),
        "safe_haven_ranking": ranking,
        "risk": risk,
        "quadrants": P.quadrants(risk, profile),
        "insight_facts": P.insight_facts(ranking, regimes, risk, profile),
    }
    if weights:
        cut = P.filter_dates(P.filter_assets(panel, list(weights)), start, end)
        daily = staged(PF.portfolio_daily(cut, weights, profile), "portfolio")
        tables["portfolio_cumulative"] = PF.cumulative_returns(daily)
        tables["portfolio_stats"] = PF.strategy_stats(daily, profile)
        tables["portfolio_drawdown"] = PF.strategy_drawdowns(daily)
        tables["portfolio_comparison"] = PF.drawdown_comparison(daily)
    return tables
