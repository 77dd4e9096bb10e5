"""Date-level tables: one row per panel date, derived in one pass over the panel.

Everything that depends on the date alone (macro values, correlations of named series, labels) is
computed on this spine, at most ``CALENDAR_DAYS`` rows, and joined back once by broadcast. Only here
are windows over the whole calendar allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.config import Profile, Series
from stormglass.functions import rolling as R
from stormglass.functions.sliding import Frame, with_frames
from stormglass.functions.staging import broadcast_days


def calendar_window():
    return Window.orderBy("date")


def spine(features: DataFrame, profile: Profile) -> DataFrame:
    """Per date: returns of the role assets, benchmark drawdown and presence, any return at all."""
    asset, ret = F.col("asset"), F.col("daily_return")
    benchmark = asset == profile.benchmark.asset
    returns = [
        F.max(F.when(asset == s.asset, ret)).alias(f"{s.label}_return") for s in profile.roles
    ]
    return features.groupBy("date").agg(
        *returns,
        F.max(F.when(benchmark, F.col("drawdown"))).alias(profile.benchmark_drawdown),
        F.max(benchmark).alias("benchmark_present"),
        F.max(ret.isNotNull()).alias("any_return"),
    )


def panel_dates(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def macro_on_dates(
    dates: DataFrame, wide: DataFrame, variables: tuple[str, ...], mode: str = "panel"
) -> DataFrame:
    """Macro values carried forward over a table with one row per panel date; its columns stay.

    ``panel``: an observation on a date that is no panel date is lost. ``asof``: the latest
    observation up to each date counts, whatever its date.
    """
    if mode == "panel":
        on_dates = dates.join(broadcast_days(wide), "date", "left")
    elif mode == "asof":
        on_dates = dates.withColumn("_panel", F.lit(True)).join(wide, "date", "full")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    w = calendar_window()
    filled = on_dates.withColumns({v: R.forward_fill(F.col(v), w) for v in variables})
    return filled if mode == "panel" else filled.where("_panel").drop("_panel")


def macro_onto_panel(
    panel: DataFrame, wide: DataFrame, variables: tuple[str, ...], mode: str = "panel"
) -> DataFrame:
    """Panel rows with the macro values of their date."""
    values = macro_on_dates(panel_dates(panel), wide, variables, mode)
    return panel.join(broadcast_days(values), "date", "left")


def with_macro_aliases(df: DataFrame, aliases: tuple[tuple[str, str], ...]) -> DataFrame:
    """Readable copies of macro columns; the originals stay."""
    present = {name.lower() for name in df.columns}
    return df.withColumns({new: F.col(old) for old, new in aliases if old.lower() in present})


def with_yoy(dates: DataFrame, level: str, periods: int, name: str = "inflation_yoy") -> DataFrame:
    """Change of a level against ``periods`` dates before."""
    w = calendar_window()
    return dates.withColumn(name, R.change(F.col(level), w, periods))


def pair_correlations(
    dates: DataFrame,
    candidate: Series,
    windows: dict[Series, dict[int, str]],
    calendar: str = "union",
) -> DataFrame:
    """Rolling correlation of the candidate with other series: date and one named column per frame.

    Frames count rows of the union calendar (dates with any return) or, with ``pair``, of the dates
    both series have. The pairs are laid out below each other and take linear time at any length.
    """
    if calendar not in ("union", "pair"):
        raise ValueError(f"unknown calendar {calendar!r}")
    x = F.col(f"{candidate.label}_return")
    pairs = []
    for other in windows:
        y = F.col(f"{other.label}_return")
        both = x.isNotNull() & y.isNotNull()
        pairs.append(
            F.struct(
                F.lit(other.label).alias("pair"),
                F.when(both, x).alias("x"),
                F.when(both, y).alias("y"),
                (F.lit(True) if calendar == "union" else both).alias("counted"),
            )
        )
    long = dates.where("any_return").select("date", F.inline(F.array(*pairs)))
    lengths = sorted({n for names in windows.values() for n in names})
    frames = {f"_{n}": Frame("correlation", n, "x", "y") for n in lengths}
    done = with_frames(long, ["pair", "counted"], frames, direct_up_to=0)
    return done.groupBy("date").agg(
        *[
            F.max(F.when(F.col("pair") == other.label, F.col(f"_{n}"))).alias(name)
            for other, names in windows.items()
            for n, name in names.items()
        ]
    )


def with_rolling_correlations(dates: DataFrame, profile: Profile, calendar: str = "union") -> DataFrame:
    """Candidate against benchmark and peers, one column per window in use."""
    benchmark, n = profile.benchmark, profile.peer_corr_window
    windows = {benchmark: {k: profile.rolling_corr(benchmark, k) for k in profile.benchmark_corr_windows}}
    windows.update({peer: {n: profile.rolling_corr(peer, n)} for peer in profile.peers})
    found = pair_correlations(dates, profile.candidate, windows, calendar)
    return dates.join(broadcast_days(found), "date", "left")


def multi_window_correlations(dates: DataFrame, profile: Profile, calendar: str = "union") -> DataFrame:
    """Every pair at every window, on the dates that have any return."""
    windows = {
        other: {n: profile.multi_corr(other, n) for n in profile.multi_corr_windows}
        for other in (profile.benchmark, *profile.peers)
    }
    return pair_correlations(dates, profile.candidate, windows, calendar)


def correlation_view(
    correlations: DataFrame, profile: Profile, others: list[Series], window: int, start: str, end: str
) -> DataFrame:
    """Long (date, pair, value) of the chosen pairs in a closed date range, without empty values."""
    names = [profile.multi_corr(o, window) for o in others]
    chosen = correlations.where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).select("date", *names)
    return chosen.unpivot(["date"], names, "pair", "correlation").dropna(subset=["correlation"])
