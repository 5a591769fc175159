"""Set configurations: current table, inverted index, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_configs(changelog: DataFrame) -> DataFrame:
    """Last published instruments of each set."""
    return changelog.groupBy("set_id").agg(F.max_by("instruments", "arrival_seq").alias("instruments"))


def memberships(changelog: DataFrame) -> DataFrame:
    """One row per (set, instrument) of every publication, in changelog order."""
    return changelog.select(F.explode("instruments").alias("instrument_id"), "set_id", "arrival_seq")


def inverse_index(changelog: DataFrame, *, current: bool = False) -> DataFrame:
    """Instrument to its sets. By default a republished set is listed again and never removed;
    ``current`` lists each set of the present configuration once."""
    if current:
        flat = current_configs(changelog).select(F.explode("instruments").alias("instrument_id"), "set_id").distinct()
        return flat.groupBy("instrument_id").agg(F.array_sort(F.collect_list("set_id")).alias("set_ids"))
    listed = F.array_sort(F.collect_list(F.struct("arrival_seq", "set_id")))
    return memberships(changelog).groupBy("instrument_id").agg(F.transform(listed, lambda x: x["set_id"]).alias("set_ids"))


def instruments_of(changelog: DataFrame, set_id: str) -> list[str]:
    """Instruments of one set; raises on an unknown set."""
    rows = current_configs(changelog.filter(F.col("set_id") == set_id)).take(1)
    if not rows:
        raise KeyError(set_id)
    return list(rows[0].instruments)


def sets_by_index(changelog: DataFrame, instrument: str) -> DataFrame:
    return inverse_index(changelog).filter(F.col("instrument_id") == instrument)


def sets_by_scan(changelog: DataFrame, instrument: str) -> DataFrame:
    return current_configs(changelog).filter(F.array_contains("instruments", instrument)).select("set_id")


def fan_out(ticks: DataFrame, changelog: DataFrame, *, as_of_arrival: bool = False) -> DataFrame:
    """One row per (tick, set listing its instrument), duplicates of the index included.

    ``as_of_arrival``: only publications that arrived before the tick count.
    """
    index = memberships(changelog).withColumnRenamed("arrival_seq", "config_seq")
    joined = ticks.join(index, "instrument_id")
    if as_of_arrival:
        joined = joined.filter(F.col("config_seq") < F.col("arrival_seq"))
    return joined.drop("config_seq")
