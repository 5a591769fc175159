"""Change between consecutive values and conversation transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import price_key


def delta(ticks: DataFrame) -> DataFrame:
    """Price change against the instrument's previous arrival; null for the first."""
    w = Window.partitionBy("instrument_id").orderBy("arrival_seq")
    change = (price_key(F.col("price")) - price_key(F.lag("price").over(w))).cast("decimal(18,4)")
    return ticks.select("instrument_id", "arrival_seq", "price", change.alias("delta"))


def transcript(conversations: DataFrame) -> DataFrame:
    """One text per conversation, turns in order, ``role: text`` lines."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return conversations.groupBy("conv_id").agg(F.array_join(line, "\n").alias("transcript"), F.count("*").alias("n_turns"))
