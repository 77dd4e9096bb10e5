"""Regime and defensive-asset analytics on daily asset panels, built on Spark DataFrames."""

from stormglass.config import MARKET, Profile, Series

__all__ = ["MARKET", "Profile", "Series"]
