"""Labelled panels: the tables every statistic starts from.

Features are written once (only the columns asked for); the date table is one small aggregate over
them, written too where several readers join it. So a labelled panel costs one pass over the raw
tables, one over two or three written columns for the spine, and one for the statistic itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.config import Profile
from stormglass.functions.staging import staged
from stormglass.operators import calendar as C
from stormglass.operators import labels as L
from stormglass.operators.features import asset_features


@dataclass(frozen=True)
class Workspace:
    profile: Profile
    features: DataFrame
    dates: DataFrame

    @property
    def date_columns(self) -> list[str]:
        hidden = {"date", "benchmark_present", "any_return"}
        hidden.update(f"{s.label}_return" for s in self.profile.roles)
        return [c for c in self.dates.columns if c not in hidden]

    @property
    def labelled(self) -> DataFrame:
        """Every panel row with the date-level columns."""
        return L.onto_panel(self.features, self.dates, self.date_columns)


def date_table(
    features: DataFrame,
    wide: DataFrame,
    profile: Profile,
    mode: str = "panel",
    calendar: str = "union",
    correlations: bool = True,
) -> DataFrame:
    """Spine with macro values, aliases, inflation, rolling correlations and labels."""
    dates = C.spine(features, profile)
    if correlations:
        dates = C.with_rolling_correlations(staged(dates, "spine"), profile, calendar)
    dates = C.macro_on_dates(dates, wide, profile.macro_variables, mode)
    dates = C.with_yoy(dates, profile.price_index, profile.yoy_periods)
    dates = C.with_macro_aliases(dates, profile.macro_aliases)
    return L.with_labels(dates, profile)


def build(
    panel: DataFrame,
    wide: DataFrame,
    profile: Profile,
    columns: list[str] | None = None,
    mode: str = "panel",
    calendar: str = "union",
    correlations: bool = True,
    reused: bool = True,
) -> Workspace:
    """``columns``: the per-asset columns the caller needs besides key, return and drawdown.

    The date table is written if it is ``reused``, else it stays part of the one plan that joins it.
    """
    features = asset_features(panel, profile, columns)
    if columns is not None:
        needed = dict.fromkeys(["date", "asset", "daily_return", "drawdown", *columns])
        features = features.select(*[F.col(c) for c in needed])
    features = staged(features, "features")
    dates = date_table(features, wide, profile, mode, calendar, correlations)
    return Workspace(profile, features, staged(dates, "dates") if reused else dates)
