"""Window assignment, stream time and exact lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import shift
from tickweave.settings import Settings


def grid_floor(ts: Column, step: int) -> Column:
    """Start of the epoch-aligned step that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(step * 1_000_000)) * step)


def on_grid(ts: Column, step: int) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(step * 1_000_000)) == 0


def hopping(df: DataFrame, s: Settings, ts: str = "event_ts") -> DataFrame:
    """One row per (row, window that holds it): ``window_start``, ``window_end`` (exclusive)."""
    w = F.window(ts, f"{s.window} seconds", f"{s.slide} seconds")
    return df.withColumn("_w", w).select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def tumbling(df: DataFrame, size: int, ts: str = "event_ts") -> DataFrame:
    start = grid_floor(F.col(ts), size)
    return df.withColumns({"window_start": start, "window_end": shift(start, size)})


def panes_to_windows(df: DataFrame, s: Settings, pane: str = "pane") -> DataFrame:
    """Each pane start becomes the windows that hold the pane."""
    k = F.explode(F.sequence(F.lit(0), F.lit(s.panes - 1)))
    keep = [c for c in df.columns if c != pane]
    start = F.timestamp_seconds(F.unix_seconds(pane) - F.col("_k") * s.slide)
    return df.withColumn("_k", k).select(*keep, start.alias("window_start"), shift(start, s.window).alias("window_end"))


def with_stream_time(df: DataFrame, s: Settings, partition: str | None = None) -> DataFrame:
    """Adds ``stream_time``: the largest ``event_ts`` among the rows that arrived so far.

    Arrival order is cut in blocks of ``seq_block``; one task orders a block, and only one
    maximum per block takes part in the ordering of blocks.
    """
    keys = [partition] if partition else []
    blocked = df.withColumn("_block", F.floor(F.col("arrival_seq") / s.seq_block))
    tops = blocked.groupBy(*keys, "_block").agg(F.max("event_ts").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "_block", F.max("_top").over(earlier).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(before, [*keys, "_block"])
    return joined.withColumn("stream_time", F.greatest(F.max("event_ts").over(within), F.col("_before"))).select(*df.columns, "stream_time")


def with_reach(timed: DataFrame, s: Settings, grace: int) -> DataFrame:
    """Adds ``pane`` and ``reach``, the number of windows over the pane that still take the row; rows that none takes go.

    The windows over a pane end one slide apart, so those whose grace has not run out in ``stream_time`` are the
    latest ones: the first ``reach`` of ``panes_to_windows``.
    """
    step, seconds = s.slide * 1_000_000, s.window + grace
    pane = grid_floor(F.col("event_ts"), s.slide)
    left = F.unix_micros(pane) + F.lit(seconds * 1_000_000) - F.unix_micros("stream_time")
    reach = F.least(F.ceil(left / F.lit(step)), F.lit(s.panes)).cast("int")
    return timed.withColumns({"pane": pane, "reach": reach}).filter("reach > 0")


def reached_windows(df: DataFrame, s: Settings) -> DataFrame:
    """Rows with ``pane`` and ``reach`` copied to the windows that take them."""
    keep = [c for c in df.columns if c not in ("pane", "reach")]
    start = F.timestamp_seconds(F.unix_seconds("pane") - F.col("_k") * s.slide)
    spread = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    return spread.select(*keep, start.alias("window_start"), shift(start, s.window).alias("window_end"))


def drop_late(windowed: DataFrame, grace: int) -> DataFrame:
    """Keeps a (row, window) pair while the window's grace has not run out in stream time."""
    return windowed.filter(shift(F.col("window_end"), grace) > F.col("stream_time"))


def closed_only(windowed: DataFrame, stream_end: DataFrame, grace: int) -> DataFrame:
    """Windows whose grace ended by the last stream time; ``stream_end`` has one row ``last_time``."""
    return windowed.crossJoin(F.broadcast(stream_end)).filter(shift(F.col("window_end"), grace) <= F.col("last_time")).drop("last_time")
