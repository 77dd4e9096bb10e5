"""What to analyse: roles, thresholds, windows, weights and events.

A ``Profile`` names the assets that play a role, the macro variables and the cut-offs. Output column
names are derived from the short labels, so the same operators serve any market.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Series:
    """An asset with the short label used in column names."""

    asset: str
    label: str


@dataclass(frozen=True)
class Event:
    """A named closed date interval."""

    name: str
    start_date: date
    end_date: date
    description: str = ""


@dataclass(frozen=True)
class Weights:
    """Weights of the six score dimensions; they sum to one."""

    mean_return: float = 0.25
    outperform: float = 0.20
    drawdown: float = 0.15
    volatility: float = 0.10
    correlation: float = 0.15
    hit_rate: float = 0.15


@dataclass(frozen=True)
class Profile:
    candidate: Series
    benchmark: Series
    peers: tuple[Series, ...]
    macro_variables: tuple[str, ...]
    macro_aliases: tuple[tuple[str, str], ...]
    stress_variable: str
    stress_label: str
    stress_threshold: float
    recession_variable: str
    recession_threshold: float
    price_index: str
    drawdown_threshold: float
    events: tuple[Event, ...]
    groups: tuple[tuple[str, tuple[str, ...]], ...]
    display_names: tuple[tuple[str, str], ...] = ()
    classes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default_class: str = "stock_etf"
    optional_assets: tuple[str, ...] = ()
    hidden_aliases: tuple[str, ...] = ()
    default_assets: tuple[str, ...] = ()
    weights: Weights = Weights()
    short_window: int = 21
    medium_window: int = 63
    moving_averages: tuple[int, ...] = (20, 50, 200)
    return_periods: tuple[int, ...] = (5, 21, 63)
    benchmark_corr_windows: tuple[int, ...] = (30, 90)
    peer_corr_window: int = 90
    multi_corr_windows: tuple[int, ...] = (30, 90, 180)
    yoy_periods: int = 252
    annual_days: int = 252

    @property
    def panel_aliases(self) -> tuple[str, ...]:
        """Alias columns that the analysis panel shows."""
        left_out = {self.price_index, *self.hidden_aliases}
        return tuple(name for variable, name in self.macro_aliases if variable not in left_out)

    @property
    def roles(self) -> tuple[Series, ...]:
        return (self.candidate, self.benchmark, *self.peers)

    @property
    def benchmark_drawdown(self) -> str:
        return f"{self.benchmark.label}_drawdown"

    @property
    def stress_flag(self) -> str:
        return f"crisis_by_{self.stress_label}"

    @property
    def drawdown_flag(self) -> str:
        return f"crisis_by_{self.benchmark.label}_drawdown"

    @property
    def success(self) -> str:
        return f"{self.candidate.label}_safe_haven_success"

    @property
    def short_volatility(self) -> str:
        return f"rolling_volatility_{self.short_window}d"

    @property
    def medium_volatility(self) -> str:
        return f"rolling_volatility_{self.medium_window}d"

    def rolling_corr(self, other: Series, window: int) -> str:
        return f"rolling_corr_{self.candidate.label}_{other.label}_{window}d"

    def multi_corr(self, other: Series, window: int) -> str:
        return f"corr_{self.candidate.label}_{other.label}_{window}d"

    @property
    def score_corr(self) -> str:
        """Rolling correlation with the benchmark over the longest benchmark window."""
        return self.rolling_corr(self.benchmark, max(self.benchmark_corr_windows))

    @property
    def rolling_corr_columns(self) -> tuple[str, ...]:
        own = tuple(self.rolling_corr(self.benchmark, n) for n in self.benchmark_corr_windows)
        return own + tuple(self.rolling_corr(p, self.peer_corr_window) for p in self.peers)


# Tickers, series, thresholds, weights and events of the default market.
MARKET = Profile(
    candidate=Series("GC=F", "gold"),
    benchmark=Series("SPY", "spy"),
    peers=(Series("TLT", "tlt"), Series("UUP", "uup"), Series("BTC-USD", "btc")),
    macro_variables=(
        "SP500", "VIXCLS", "USREC", "FEDFUNDS", "EFFR", "CPIAUCSL",
        "DGS10", "DFII10", "T10YIE", "T10Y3M", "DTWEXBGS",
    ),
    macro_aliases=(
        ("VIXCLS", "vix_level"),
        ("USREC", "recession_flag"),
        ("CPIAUCSL", "cpi_level"),
        ("FEDFUNDS", "fed_rate"),
        ("EFFR", "effr"),
        ("DGS10", "treasury_10y"),
        ("DFII10", "real_yield"),
        ("T10YIE", "breakeven_inflation"),
        ("DTWEXBGS", "dollar_index"),
    ),
    hidden_aliases=("EFFR",),
    stress_variable="VIXCLS",
    stress_label="vix",
    stress_threshold=30.0,
    recession_variable="USREC",
    recession_threshold=1.0,
    price_index="CPIAUCSL",
    drawdown_threshold=-0.10,
    events=(
        Event("Dotcom Bubble Burst", date(2000, 3, 10), date(2002, 10, 9),
              "Technology shares collapse"),
        Event("Global Financial Crisis (GFC)", date(2007, 10, 9), date(2009, 3, 9),
              "Subprime losses and bank failures"),
        Event("European Debt Crisis", date(2010, 4, 23), date(2012, 7, 24),
              "Sovereign debt of the euro periphery"),
        Event("China Crash / Oil Crash", date(2015, 6, 12), date(2016, 2, 11),
              "Chinese equities and crude oil fall"),
        Event("COVID-19 Pandemic Crash", date(2020, 2, 19), date(2020, 3, 23),
              "Pandemic sell-off"),
        Event("2022 Rate Hike / Inflation Shock", date(2022, 1, 3), date(2022, 10, 12),
              "Fast rate rises hit shares and bonds"),
    ),
    groups=(
        ("gold", ("GC=F", "XAUUSD=X", "GLD", "IAU")),
        ("stock_etf", ("SPY", "QQQ", "DIA", "IWM")),
        ("bonds", ("TLT", "IEF", "SHY")),
        ("usd", ("UUP",)),
        ("crypto", ("BTC-USD", "ETH-USD")),
        ("commodities", ("SI=F", "SLV", "USO", "DBC")),
        ("sector_etf", ("XLF", "XLK", "XLE", "XLV", "XLY", "XLP", "XLI", "XLU", "XLB", "XLRE")),
        ("magnificent_7", ("AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "META", "TSLA")),
    ),
    display_names=(
        ("GC=F", "XAUUSD GOLD"),
        ("GLD", "GLD (Gold ETF)"),
        ("SI=F", "XAGUSD (Silver)"),
        ("SPY", "SPY (S&P 500)"),
        ("TLT", "TLT (20Y Bond)"),
        ("BTC-USD", "BTC (Bitcoin)"),
        ("ETH-USD", "ETH (Ethereum)"),
        ("UUP", "UUP (US Dollar)"),
    ),
    classes=(
        ("gold", ("GC=F", "GLD", "IAU", "XAUUSD=X", "XAUUSD GOLD", "GLD (Gold ETF)")),
        ("bond", ("TLT", "IEF", "SHY", "TLT (20Y Bond)")),
        ("crypto", ("BTC-USD", "ETH-USD", "BTC (Bitcoin)", "ETH (Ethereum)")),
        ("commodity", ("SI=F", "SLV", "USO", "DBC", "XAGUSD (Silver)")),
        ("usd", ("UUP", "UUP (US Dollar)")),
    ),
    optional_assets=("XAUUSD=X",),
    default_assets=("GC=F", "SPY", "TLT", "UUP", "BTC-USD"),
)
