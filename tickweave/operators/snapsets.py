"""Snapshot sets: per (set, window) the latest price of each instrument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import shift, sorted_map
from tickweave.operators import windows as W
from tickweave.operators.config_index import current_configs, memberships
from tickweave.operators.latest import latest_at, latest_reached
from tickweave.settings import Settings

_KEYS = ("set_id", "window_start", "window_end", "instrument_id")


def simple_rows(ticks: DataFrame, changelog: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Precomputed with grace: stream time runs over the ticks that belong to some set."""
    return _to_sets(latest_reached(_set_time(ticks, changelog, s), s), changelog)


def _set_time(ticks: DataFrame, changelog: DataFrame, s: Settings) -> DataFrame:
    """The ticks that belong to some set, with stream time over these alone."""
    return W.with_stream_time(ticks.join(memberships(changelog).select("instrument_id").distinct(), "instrument_id", "left_semi"), s)


def _to_sets(latest: DataFrame, changelog: DataFrame) -> DataFrame:
    """A row per set that ever listed the instrument; an index row counts once."""
    index = memberships(changelog).select("instrument_id", "set_id").distinct()
    return latest.join(index, "instrument_id").select(*_KEYS, "price")


def simple_at(ticks: DataFrame, changelog: DataFrame, set_id: str, end: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """:func:`at_end` of :func:`simple_rows`: stream time over all, windows of the one set and end alone."""
    own = changelog.filter(F.col("set_id") == set_id)
    members, last = memberships(own).select("instrument_id").distinct(), F.lit(end).cast("timestamp")
    inside = (F.col("event_ts") >= shift(last, -s.window)) & (F.col("event_ts") < last) & W.on_grid(last, s.slide)
    timed = _set_time(ticks, changelog, s).filter(inside & (shift(last, s.grace) > F.col("stream_time"))).join(members, "instrument_id", "left_semi")
    found = timed.groupBy("instrument_id").agg(F.max_by("price", "arrival_seq").alias("price"))
    return found.select(F.lit(set_id).alias("set_id"), shift(last, -s.window).alias("window_start"), last.alias("window_end"), "instrument_id", "price")


def sharded_rows(ticks: DataFrame, changelog: DataFrame, s: Settings = Settings(), *, by_shard: bool = False) -> DataFrame:
    """Precomputed without grace, in slide-sized panes; ``by_shard`` keeps partial rows apart."""
    shard = [F.pmod(F.hash("instrument_id"), F.lit(s.shards)).alias("shard")] if by_shard else []
    extra = ["shard"] if by_shard else []
    panes = ticks.groupBy("instrument_id", W.grid_floor(F.col("event_ts"), s.slide).alias("pane")).agg(
        F.max_by(F.struct("price", "arrival_seq"), "arrival_seq").alias("_t")
    )
    latest = W.panes_to_windows(panes.select("instrument_id", "pane", "_t.*"), s)
    latest = latest.groupBy("instrument_id", "window_start", "window_end").agg(F.max_by("price", "arrival_seq").alias("price"))
    return _to_sets(latest, changelog).select(*_KEYS, "price", *shard).select(*_KEYS, *extra, "price")


def as_maps(rows: DataFrame) -> DataFrame:
    """(set, window) to map; reads one set at a time stay small, the rows stay the stored form."""
    keys = [c for c in rows.columns if c not in ("instrument_id", "price")]
    return rows.groupBy(*keys).agg(sorted_map("instrument_id", "price").alias("instruments"))


def merge_shards(partials: DataFrame) -> DataFrame:
    """Joins the maps of the shards; an instrument lives in one shard."""
    return as_maps(partials.drop("shard"))


def at_end(rows: DataFrame, set_id: str, end: dt.datetime) -> DataFrame:
    return rows.filter((F.col("set_id") == set_id) & (F.col("window_end") == F.lit(end).cast("timestamp")))


def at_start(rows: DataFrame, set_id: str, start: dt.datetime) -> DataFrame:
    return rows.filter((F.col("set_id") == set_id) & (F.col("window_start") == F.lit(start).cast("timestamp")))


def on_demand_rows(ticks: DataFrame, changelog: DataFrame, set_id: str, snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """Instruments of the set in configured order with their latest tick, null where none."""
    listed = current_configs(changelog.filter(F.col("set_id") == set_id)).select("set_id", F.posexplode("instruments").alias("position", "instrument_id"))
    return listed.join(latest_at(ticks, snap, s), "instrument_id", "left").select("set_id", "position", "instrument_id", "price", "event_ts", "arrival_seq")


def on_demand_map(ticks: DataFrame, changelog: DataFrame, set_id: str, snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """Always one row; the map is empty when nothing is found."""
    rows = on_demand_rows(ticks, changelog, set_id, snap, s).filter(F.col("arrival_seq").isNotNull())
    return rows.agg(sorted_map("instrument_id", "price").alias("instruments")).select(F.lit(set_id).alias("set_id"), "instruments")


def direct_rows(ticks: DataFrame, changelog: DataFrame, set_id: str, snap: dt.datetime, s: Settings = Settings()) -> DataFrame:
    """The set's rows of one window straight from the time range (no-grace semantics)."""
    members = changelog.filter(F.col("set_id") == set_id).select(F.explode("instruments").alias("instrument_id")).distinct()
    end = F.lit(snap).cast("timestamp")
    found = latest_at(ticks, snap, s).join(members, "instrument_id", "left_semi")
    return found.select(F.lit(set_id).alias("set_id"), shift(end, -s.window).alias("window_start"), end.alias("window_end"), "instrument_id", "price")
