"""Latest tick per instrument and window, final values, and point reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import shift
from tickweave.operators import windows as W
from tickweave.settings import Settings

_TICK = ("price", "event_ts", "arrival_seq")


def _last(*cols: str) -> Column:
    """Aggregate: the values of the row that arrived last."""
    return F.max_by(F.struct(*cols), "arrival_seq").alias("_t")


def latest_windows(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Last-arrived tick of each (instrument, window), no row dropped.

    Rows are reduced to one per (instrument, slide) before they are copied to the windows.
    """
    panes = ticks.groupBy("instrument_id", W.grid_floor(F.col("event_ts"), s.slide).alias("pane")).agg(_last(*_TICK))
    spread = W.panes_to_windows(panes.select("instrument_id", "pane", "_t.*"), s)
    return spread.groupBy("instrument_id", "window_start", "window_end").agg(_last(*_TICK)).select("instrument_id", "window_start", "window_end", "_t.*")


def latest_windows_late(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """As :func:`latest_windows`, with late (row, window) pairs dropped by exact stream time."""
    return latest_reached(W.with_stream_time(ticks, s), s)


def latest_reached(timed: DataFrame, s: Settings) -> DataFrame:
    """Last-arrived tick of each (instrument, window) that took it, from rows with ``stream_time``.

    Rows are reduced to one per (instrument, pane, reach) before they are copied to the windows.
    """
    panes = W.with_reach(timed, s, s.grace).groupBy("instrument_id", "pane", "reach").agg(_last(*_TICK))
    kept = W.reached_windows(panes.select("instrument_id", "pane", "reach", "_t.*"), s)
    return kept.groupBy("instrument_id", "window_start", "window_end").agg(_last(*_TICK)).select("instrument_id", "window_start", "window_end", "_t.*")


def final_values(ticks: DataFrame, s: Settings = Settings(), *, flush: bool = False) -> DataFrame:
    """One row per (instrument, window) that closed; ``flush`` also emits the open windows."""
    latest = latest_windows_late(ticks, s)
    return latest if flush else W.closed_only(latest, ticks.agg(F.max("event_ts").alias("last_time")), s.grace)


def latest_at(ticks: DataFrame, snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """Latest tick of every instrument in the window that ends at ``snap``; nothing off the grid.

    Reads the time range directly instead of copying rows to all windows.
    """
    end = F.lit(snap).cast("timestamp")
    rows = ticks.filter((F.col("event_ts") >= shift(end, -s.window)) & (F.col("event_ts") < end) & W.on_grid(end, s.slide))
    return rows.groupBy("instrument_id").agg(_last(*_TICK)).select("instrument_id", "_t.*")


def latest_one(ticks: DataFrame, instrument: str, snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    return latest_at(ticks.filter(F.col("instrument_id") == instrument), snap, s)


def latest_list(ticks: DataFrame, instruments: list[str], snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """One row per listed instrument in list order (``position``); nulls where there is no tick."""
    spark = ticks.sparkSession
    asked = spark.createDataFrame(list(enumerate(instruments)), "position INT, instrument_id STRING")
    found = latest_at(ticks.filter(F.col("instrument_id").isin(instruments)), snap, s)
    return asked.join(found, "instrument_id", "left").select("position", "instrument_id", *_TICK)


def range_of_one(ticks: DataFrame, instrument: str, start: dt.datetime, end: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """:func:`range_fetch` of :func:`latest_windows`, from the ticks that can stand in those windows alone."""
    near = ticks.filter((F.col("instrument_id") == instrument) & (F.col("event_ts") >= F.lit(start).cast("timestamp")) & (F.col("event_ts") < shift(F.lit(end).cast("timestamp"), s.window)))
    return range_fetch(latest_windows(near, s), instrument, start, end)


def range_fetch(latest: DataFrame, instrument: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Windows of one instrument whose start lies in [start, end]."""
    return latest.filter((F.col("instrument_id") == instrument) & F.col("window_start").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
