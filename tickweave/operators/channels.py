"""Channel delivery: live pushes, bootstrap snapshots, subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import shift
from tickweave.operators import windows as W
from tickweave.operators.config_index import fan_out
from tickweave.settings import Settings


def _live(wall: str):
    """Strictly before the channel's snap end; channels without one are always live."""
    return F.col("snap_end").isNull() | (F.col(wall) < F.col("snap_end"))


def subscribed(channels: DataFrame, subscriptions: DataFrame, kind: str, key: str) -> DataFrame:
    picked = subscriptions.filter(F.col("kind") == kind).select(F.col("key").alias(key), "channel_id")
    return picked.join(channels, "channel_id")


def individual_push(ticks: DataFrame, channels: DataFrame, subscriptions: DataFrame, *, wall: str = "event_ts") -> DataFrame:
    """Ticks sent to the channels subscribed to their instrument."""
    joined = ticks.join(subscribed(channels, subscriptions, "instrument", "instrument_id"), "instrument_id")
    return joined.filter(_live(wall)).select("channel_id", F.col("arrival_seq").alias("seq"), "instrument_id", "price")


def set_push(ticks: DataFrame, changelog: DataFrame, channels: DataFrame, subscriptions: DataFrame, *, wall: str = "event_ts") -> DataFrame:
    """Ticks sent through sets; an instrument in two subscribed sets is sent twice."""
    joined = fan_out(ticks, changelog).join(subscribed(channels, subscriptions, "set", "set_id"), "set_id")
    kept = joined.filter(_live(wall))
    return kept.select("channel_id", F.col("arrival_seq").alias("seq"), "set_id", "instrument_id", "price", "is_new", "snap_end", F.col(wall).alias("wall"))


def bootstrap(ticks: DataFrame, changelog: DataFrame, channels: DataFrame, subscriptions: DataFrame, s: Settings = Settings(), *, inclusive: bool, wall: str = "event_ts") -> DataFrame:
    """The snapshot a new channel gets before its first tick for which one exists.

    The snapshot is that of the tick's set in the window ending at the channel's snap end (for
    channels without one: at the wall clock, found only when that lies on the grid), from the
    rows that arrived before the triggering tick, or up to it when ``inclusive``.
    """
    sent = set_push(ticks, changelog, channels, subscriptions, wall=wall).filter("is_new").distinct()
    sent = sent.withColumn("end", F.coalesce("snap_end", "wall")).filter(W.on_grid(F.col("end"), s.slide))
    members = fan_out(ticks, changelog).select("set_id", "instrument_id", "price", "event_ts", "arrival_seq").distinct()
    ends = sent.select("set_id", "end").distinct()
    stored = members.join(ends, "set_id").filter((F.col("event_ts") >= shift(F.col("end"), -s.window)) & (F.col("event_ts") < F.col("end")))
    first = stored.groupBy("set_id", "end").agg(F.min("arrival_seq").alias("first_seq"))
    after = (lambda a, b: a >= b) if inclusive else (lambda a, b: a > b)
    ready = sent.join(first, ["set_id", "end"]).filter(after(F.col("seq"), F.col("first_seq")))
    trigger = ready.groupBy("channel_id").agg(F.min_by(F.struct("seq", "set_id", "end"), F.struct("seq", "set_id")).alias("_x")).select("channel_id", "_x.*")
    seen = trigger.join(stored, ["set_id", "end"]).filter(after(F.col("seq"), F.col("arrival_seq")))
    return seen.groupBy("channel_id", "set_id", F.col("seq").alias("trigger_seq"), "instrument_id").agg(F.max_by("price", "arrival_seq").alias("price"))


def messages(ticks: DataFrame, changelog: DataFrame, channels: DataFrame, subscriptions: DataFrame, s: Settings = Settings(), *, inclusive: bool = True, wall: str = "event_ts") -> DataFrame:
    """What each channel receives, ordered by (seq, phase): aggregates, set ticks, keyed ticks."""
    ticks_out = set_push(ticks, changelog, channels, subscriptions, wall=wall).select("channel_id", "seq", F.lit(1).alias("phase"), F.lit("tick").alias("kind"), "set_id", "instrument_id", "price")
    snaps = bootstrap(ticks, changelog, channels, subscriptions, s, inclusive=inclusive, wall=wall).select("channel_id", F.col("trigger_seq").alias("seq"), F.lit(0).alias("phase"), F.lit("aggregate").alias("kind"), "set_id", "instrument_id", "price")
    keyed = individual_push(ticks, channels, subscriptions, wall=wall).select("channel_id", "seq", F.lit(1).alias("phase"), F.lit("keyed_tick").alias("kind"), F.lit(None).cast("string").alias("set_id"), "instrument_id", "price")
    return snaps.unionByName(ticks_out).unionByName(keyed)
