"""Tick-snapshot analytics on Spark: latest values, bars, snapshot sets, channels."""

from tickweave.settings import Settings

__all__ = ["Settings"]
