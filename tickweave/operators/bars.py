"""High/low bars over tumbling windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import price_key
from tickweave.operators import windows as W
from tickweave.settings import Settings


def bars(ticks: DataFrame, size: int, s: Settings = Settings(), *, late: bool = True) -> DataFrame:
    """High and low tick of each (instrument, window); equal prices: the first that arrived."""
    rows = W.tumbling(W.with_stream_time(ticks, s) if late else ticks, size)
    if late:
        rows = W.drop_late(rows, s.bar_grace)
    rows = rows.withColumn("_p", price_key(F.col("price")))
    tick = F.struct("price", "event_ts", "arrival_seq")
    return rows.groupBy("instrument_id", "window_start", "window_end").agg(
        F.max_by(tick, F.struct(F.col("_p"), -F.col("arrival_seq"))).alias("high"),
        F.min_by(tick, F.struct(F.col("_p"), F.col("arrival_seq"))).alias("low"),
    )


def flat(bar: DataFrame) -> DataFrame:
    return bar.select(
        "instrument_id", "window_start", "window_end",
        F.col("high.price").alias("high"), F.col("high.arrival_seq").alias("high_seq"),
        F.col("low.price").alias("low"), F.col("low.arrival_seq").alias("low_seq"),
    )


def bar_at(ticks: DataFrame, size: int, end: dt.datetime, instrument: str, s: Settings = Settings()) -> DataFrame:
    """The bar of one instrument that ends at ``end``; lateness still follows all rows."""
    end_col = F.lit(end).cast("timestamp")
    return bars(ticks, size, s).filter((F.col("instrument_id") == instrument) & (F.col("window_end") == end_col))
