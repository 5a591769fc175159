"""Registered queries over the test tables and their SQL twins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.operators import bars, channels, config_index, extras, latest, snapsets
from tickweave.operators.windows import grid_floor
from tickweave.settings import Settings
from tickweave.sources.ticks import event_configs, event_ticks, table

Query = Callable[[SparkSession, str], DataFrame]
S = Settings()
SNAP = dt.datetime(2024, 1, 10, 12, 0, tzinfo=dt.UTC)
SNAP_SQL = "TIMESTAMP '2024-01-10 12:00:00'"
USER, SET = "u3", "m3"
LISTED = ["u5", "u1", "u404404", "u3"]
BAR_END = dt.datetime(2024, 1, 10, 12, 0, tzinfo=dt.UTC)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL twin has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def channel_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [("c1", "set", True, None), ("c2", "set", True, None), ("c3", "individual", True, None), ("c4", "late", True, SNAP), ("c5", "late", True, SNAP), ("c6", "individual", False, SNAP)]
    subs = [("set", "m1", "c1"), ("set", "m1", "c2"), ("set", "n1", "c2"), ("instrument", "u3", "c3"), ("set", "n2", "c4"), ("set", "m4", "c5"), ("set", "n4", "c5"), ("instrument", "u5", "c6"), ("instrument", "u3", "c6")]
    return spark.createDataFrame(rows, schemas.CHANNELS), spark.createDataFrame(subs, schemas.SUBSCRIPTIONS)


def _ticks(f: Callable[[DataFrame], DataFrame], *, late: bool = False) -> Query:
    return lambda spark, d: plain(f(event_ticks(spark, d, late=late)))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame], *, late: bool = False) -> Query:
    return lambda spark, d: plain(f(event_ticks(spark, d, late=late), event_configs(spark, d)))


def _configs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: plain(f(event_configs(spark, d)))


def _channels(f, *, late: bool = False) -> Query:
    return lambda spark, d: plain(f(event_ticks(spark, d, late=late), event_configs(spark, d), *channel_rows(spark)))


def _flat_index(c: DataFrame) -> DataFrame:
    return config_index.inverse_index(c).select("instrument_id", F.posexplode("set_ids").alias("position", "set_id"))


def _flat_config(c: DataFrame) -> DataFrame:
    return config_index.current_configs(c).select("set_id", F.posexplode("instruments").alias("position", "instrument_id"))


def _map_rows(df: DataFrame) -> DataFrame:
    return df.select("set_id", F.explode("instruments").alias("instrument_id", "price"))


def _first_bar(ticks: DataFrame, size: int) -> DataFrame:
    """Point read of one bar: that of the user's first tick."""
    start = ticks.filter(F.col("instrument_id") == USER).agg(F.min("event_ts").alias("t")).select(F.unix_seconds(grid_floor(F.col("t"), size)).alias("t")).first().t
    return bars.flat(bars.bar_at(ticks, size, dt.datetime.fromtimestamp(start + size, dt.UTC), USER))


def queries() -> dict[str, Query]:
    return {
        "a1_latest_windows": _ticks(latest.latest_windows),
        "t6_late_drop_latest": _ticks(latest.latest_windows_late, late=True),
        "t7_final_values": _ticks(latest.final_values, late=True),
        "a2_bars_1m": _ticks(lambda t: bars.flat(bars.bars(t, S.bar_short)), late=True),
        "a3_bars_10m": _ticks(lambda t: bars.flat(bars.bars(t, S.bar_long)), late=True),
        "a4_simple_late": _both(snapsets.simple_rows, late=True),
        "a5_sharded_late": _both(snapsets.sharded_rows, late=True),
        "a6_inverse_index": _configs(_flat_index),
        "a7_config_latest": _configs(_flat_config),
        "j1_fanout": _both(lambda t, c: config_index.fan_out(t, c).drop("currency")),
        "j1_fanout_as_of": _both(lambda t, c: config_index.fan_out(t, c.withColumn("arrival_seq", F.when(F.col("arrival_seq") < -200, -1).otherwise(F.col("arrival_seq") + 5300)), as_of_arrival=True).drop("currency")),
        "q1_latest_one": _ticks(lambda t: latest.latest_one(t, USER, SNAP)),
        "q2_latest_all": _ticks(lambda t: latest.latest_at(t, SNAP)),
        "q3_latest_list": _ticks(lambda t: latest.latest_list(t, LISTED, SNAP)),
        "q4_snap_rows": _both(lambda t, c: snapsets.on_demand_rows(t, c, SET, SNAP)),
        "q5_snap_ondemand": _both(lambda t, c: _map_rows(snapsets.on_demand_map(t, c, SET, SNAP))),
        "q6_snap_simple": _both(lambda t, c: snapsets.simple_at(t, c, SET, SNAP), late=True),
        "q7_snap_sharded": _both(lambda t, c: snapsets.direct_rows(t, c, SET, SNAP), late=True),
        "q7_snap_sharded_start": _both(lambda t, c: snapsets.direct_rows(t, c, SET, SNAP + dt.timedelta(seconds=S.window)), late=True),
        "q8_bar_1m_at": _ticks(lambda t: bars.flat(bars.bars(t, S.bar_short).filter(F.col("window_end").between(F.lit(BAR_END).cast("timestamp") - F.expr("INTERVAL 6 HOURS"), F.lit(BAR_END).cast("timestamp"))))),
        "q9_bar_10m_at": _ticks(lambda t: bars.flat(bars.bars(t, S.bar_long).filter((F.col("instrument_id") == USER)))),
        "q8_bar_1m_point": _ticks(lambda t: _first_bar(t, S.bar_short)),
        "q9_bar_10m_point": _ticks(lambda t: _first_bar(t, S.bar_long)),
        "q10_set_keys": _configs(lambda c: _flat_config(c.filter(F.col("set_id") == SET))),
        "q11_inverse_fast": _configs(lambda c: _flat_index(c).filter(F.col("instrument_id") == USER)),
        "q12_inverse_scan": _configs(lambda c: config_index.sets_by_scan(c, USER)),
        "q13_all_configs": _configs(lambda c: _flat_config(c).select(F.lit("config").alias("kind"), "set_id", "instrument_id").unionByName(_flat_index(c).select(F.lit("inverse").alias("kind"), "set_id", "instrument_id"))),
        "q14_range_fetch": _ticks(lambda t: latest.range_of_one(t, USER, SNAP - dt.timedelta(hours=21), SNAP - dt.timedelta(hours=18))),
        "q15_full_scan": _ticks(lambda t: latest.latest_windows(t).orderBy("instrument_id", "window_start").select("instrument_id", "window_start", "price")),
        "c1_individual_push": _channels(lambda t, c, ch, su: channels.individual_push(t, ch, su)),
        "c6_set_push": _channels(lambda t, c, ch, su: channels.set_push(t, c, ch, su).drop("is_new", "snap_end", "wall")),
        "c2_bootstrap_simple": _channels(lambda t, c, ch, su: channels.bootstrap(t, c, ch, su, inclusive=False), late=True),
        "c2_bootstrap_sharded": _channels(lambda t, c, ch, su: channels.bootstrap(t, c, ch, su, inclusive=True), late=True),
        "s4_channel_messages": _channels(lambda t, c, ch, su: channels.messages(t, c, ch, su), late=True),
        "r1_delta": _ticks(extras.delta),
        "r2_transcript": lambda spark, d: extras.transcript(table(spark, d, "conversations")),
    }


_TICKS = """ticks AS (SELECT 'u' || user_id AS instrument_id, CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) AS price, ts AS event_ts,
  CAST({seq} AS BIGINT) AS arrival_seq FROM events)"""
_LATE = "2 * (event_id + CASE WHEN event_id % 7 = 0 THEN 40 ELSE 0 END) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END"
_CONFIGS = """users AS (SELECT DISTINCT user_id, 'u' || user_id AS name FROM events),
cfg AS (
  SELECT 'm' || user_id % 10 AS set_id, list_sort(list(name)) AS instruments, user_id % 10 - 300 AS arrival_seq FROM users WHERE user_id % 2 = 0 GROUP BY user_id % 10
  UNION ALL SELECT 'm' || user_id % 10, list_sort(list(name)), user_id % 10 - 200 FROM users GROUP BY user_id % 10
  UNION ALL SELECT 'n' || user_id % 7, list_sort(list(name)), user_id % 7 - 100 FROM users GROUP BY user_id % 7),
idx AS (SELECT unnest(instruments) AS instrument_id, set_id, arrival_seq AS config_seq FROM cfg),
cur AS (SELECT set_id, arg_max(instruments, arrival_seq) AS instruments FROM cfg GROUP BY set_id),
cur_flat AS (SELECT set_id, CAST(unnest(range(0, len(instruments))) AS INTEGER) AS position, unnest(instruments) AS instrument_id FROM cur),
inv AS (SELECT instrument_id, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY config_seq, set_id) - 1 AS INTEGER) AS position, set_id FROM idx)"""
_TIMED = "timed AS (SELECT *, max(event_ts) OVER (ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) AS st FROM {src})"
_HOPS = """hops AS (SELECT t.*, time_bucket(INTERVAL '30 minutes', event_ts, TIMESTAMP '1970-01-01') - k * INTERVAL '30 minutes' AS window_start,
  time_bucket(INTERVAL '30 minutes', event_ts, TIMESTAMP '1970-01-01') - k * INTERVAL '30 minutes' + INTERVAL '24 hours' AS window_end
  FROM {src} t, (SELECT unnest(range(0, 48)) AS k))"""
_KEPT = "kept AS (SELECT * FROM hops WHERE window_end + INTERVAL '5 minutes' > st)"
_LATEST = "SELECT instrument_id, window_start, window_end, arg_max(price, arrival_seq) AS price, arg_max(event_ts, arrival_seq) AS event_ts, max(arrival_seq) AS arrival_seq FROM {src} GROUP BY ALL"
_SNAP_ROWS = f"""atsnap AS (SELECT instrument_id, arg_max(price, arrival_seq) AS price, arg_max(event_ts, arrival_seq) AS event_ts, max(arrival_seq) AS arrival_seq
  FROM ticks WHERE event_ts >= {SNAP_SQL} - INTERVAL '24 hours' AND event_ts < {SNAP_SQL} GROUP BY instrument_id)"""
_SPREAD = "spread AS (SELECT t.*, i.set_id FROM ticks t JOIN idx i USING (instrument_id))"
_SETROWS = "SELECT set_id, window_start, window_end, instrument_id, arg_max(price, arrival_seq) AS price FROM {src} GROUP BY ALL"
_CHANNELS = f"""ch AS (SELECT * FROM (VALUES ('c1', true, NULL), ('c2', true, NULL), ('c3', true, NULL), ('c4', true, {SNAP_SQL}), ('c5', true, {SNAP_SQL}), ('c6', false, {SNAP_SQL})) v(channel_id, is_new, snap_end)),
subs AS (SELECT * FROM (VALUES ('set','m1','c1'), ('set','m1','c2'), ('set','n1','c2'), ('instrument','u3','c3'), ('set','n2','c4'), ('set','m4','c5'), ('set','n4','c5'), ('instrument','u5','c6'), ('instrument','u3','c6')) v(kind, key, channel_id)),
keyed AS (SELECT s.channel_id, t.arrival_seq AS seq, t.instrument_id, t.price FROM ticks t JOIN subs s ON s.kind = 'instrument' AND s.key = t.instrument_id JOIN ch USING (channel_id) WHERE snap_end IS NULL OR event_ts < snap_end),
pushed AS (SELECT s.channel_id, t.arrival_seq AS seq, t.set_id, t.instrument_id, t.price, is_new, snap_end, event_ts AS wall FROM spread t JOIN subs s ON s.kind = 'set' AND s.key = t.set_id JOIN ch USING (channel_id) WHERE snap_end IS NULL OR event_ts < snap_end)"""


def _bootstrap(op: str) -> str:
    return f"""cand AS (SELECT DISTINCT channel_id, seq, set_id, coalesce(snap_end, wall) AS "end" FROM pushed WHERE is_new AND epoch_us(coalesce(snap_end, wall)) % 1800000000 = 0),
stored AS (SELECT DISTINCT sp.set_id, e."end", sp.instrument_id, sp.price, sp.arrival_seq FROM spread sp JOIN (SELECT DISTINCT set_id, "end" FROM cand) e ON e.set_id = sp.set_id AND sp.event_ts >= e."end" - INTERVAL '24 hours' AND sp.event_ts < e."end"),
firsts AS (SELECT set_id, "end", min(arrival_seq) AS first_seq FROM stored GROUP BY ALL),
trig AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY channel_id ORDER BY seq, c.set_id) AS rn FROM cand c JOIN firsts f ON f.set_id = c.set_id AND f."end" = c."end" AND c.seq {op} f.first_seq) WHERE rn = 1),
boots AS (SELECT t.channel_id, t.set_id, t.seq AS trigger_seq, s.instrument_id, arg_max(s.price, s.arrival_seq) AS price FROM trig t JOIN stored s ON s.set_id = t.set_id AND s."end" = t."end" AND t.seq {op} s.arrival_seq GROUP BY ALL)"""


def _bars(minutes: int, where: str = "TRUE") -> str:
    return f"""w AS (SELECT *, CAST(price AS DECIMAL(18,4)) AS p, time_bucket(INTERVAL '{minutes} minutes', event_ts, TIMESTAMP '1970-01-01') AS window_start FROM timed),
k AS (SELECT *, window_start + INTERVAL '{minutes} minutes' AS window_end FROM w WHERE window_start + INTERVAL '{minutes} minutes' + INTERVAL '30 seconds' > st),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, window_start ORDER BY p DESC, arrival_seq) AS hi, row_number() OVER (PARTITION BY instrument_id, window_start ORDER BY p, arrival_seq) AS lo FROM k)
SELECT instrument_id, window_start, window_end, max(price) FILTER (hi = 1) AS high, max(arrival_seq) FILTER (hi = 1) AS high_seq, max(price) FILTER (lo = 1) AS low, max(arrival_seq) FILTER (lo = 1) AS low_seq
FROM r WHERE {where} GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    t, late = _TICKS.format(seq="event_id"), _TICKS.format(seq=_LATE)
    timed, hops = _TIMED.format(src="ticks"), _HOPS.format(src="timed")
    set_timed, set_hops = _TIMED.format(src="spread"), _HOPS.format(src="spread")
    sharded = f"WITH {late}, {_CONFIGS}, {_SPREAD}, {set_hops} " + _SETROWS.format(src="hops")
    simple = f"WITH {late}, {_CONFIGS}, {_SPREAD}, {set_timed}, {hops}, {_KEPT} " + _SETROWS.format(src="kept")
    plain_hops = _HOPS.format(src="ticks")
    chan = lambda ticks: f"WITH {ticks}, {_CONFIGS}, {_SPREAD}, {_CHANNELS}"
    fan = "SELECT t.instrument_id, price, event_ts, arrival_seq, set_id FROM ticks t JOIN idx i USING (instrument_id)"
    return {
        "a1_latest_windows": f"WITH {t}, {plain_hops} " + _LATEST.format(src="hops"),
        "t6_late_drop_latest": f"WITH {late}, {timed}, {hops}, {_KEPT} " + _LATEST.format(src="kept"),
        "t7_final_values": f"WITH {late}, {timed}, {hops}, {_KEPT}, l AS (" + _LATEST.format(src="kept") + ") SELECT * FROM l WHERE window_end + INTERVAL '5 minutes' <= (SELECT max(event_ts) FROM ticks)",
        "a2_bars_1m": f"WITH {late}, {timed}, " + _bars(1),
        "a3_bars_10m": f"WITH {late}, {timed}, " + _bars(10),
        "a4_simple_late": simple,
        "a5_sharded_late": sharded,
        "a6_inverse_index": f"WITH {_CONFIGS} SELECT instrument_id, position, set_id FROM inv",
        "a7_config_latest": f"WITH {_CONFIGS} SELECT set_id, position, instrument_id FROM cur_flat",
        "j1_fanout": f"WITH {t}, {_CONFIGS} {fan}",
        "j1_fanout_as_of": f"WITH {t}, {_CONFIGS} {fan} AND (CASE WHEN config_seq < -200 THEN -1 ELSE config_seq + 5300 END) < arrival_seq".replace("USING (instrument_id) AND", "ON t.instrument_id = i.instrument_id AND"),
        "q1_latest_one": f"WITH {t}, {_SNAP_ROWS} SELECT * FROM atsnap WHERE instrument_id = '{USER}'",
        "q2_latest_all": f"WITH {t}, {_SNAP_ROWS} SELECT * FROM atsnap",
        "q3_latest_list": f"WITH {t}, {_SNAP_ROWS} SELECT CAST(position AS INTEGER) AS position, l.instrument_id, price, event_ts, arrival_seq FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LISTED)) + ") l(position, instrument_id) LEFT JOIN atsnap a ON a.instrument_id = l.instrument_id",
        "q4_snap_rows": f"WITH {t}, {_CONFIGS}, {_SNAP_ROWS} SELECT set_id, position, c.instrument_id, price, event_ts, arrival_seq FROM cur_flat c LEFT JOIN atsnap a ON a.instrument_id = c.instrument_id WHERE set_id = '{SET}'",
        "q5_snap_ondemand": f"WITH {t}, {_CONFIGS}, {_SNAP_ROWS} SELECT set_id, c.instrument_id, price FROM cur_flat c JOIN atsnap a ON a.instrument_id = c.instrument_id WHERE set_id = '{SET}'",
        "q6_snap_simple": f"SELECT * FROM ({simple}) WHERE set_id = '{SET}' AND window_end = {SNAP_SQL}",
        "q7_snap_sharded": f"SELECT * FROM ({sharded}) WHERE set_id = '{SET}' AND window_end = {SNAP_SQL}",
        "q7_snap_sharded_start": f"SELECT * FROM ({sharded}) WHERE set_id = '{SET}' AND window_start = {SNAP_SQL}",
        "q8_bar_1m_at": f"WITH {t}, {timed}, " + _bars(1, f"window_end BETWEEN {SNAP_SQL} - INTERVAL '6 hours' AND {SNAP_SQL}"),
        "q9_bar_10m_at": f"WITH {t}, {timed}, " + _bars(10, f"instrument_id = '{USER}'"),
        "q8_bar_1m_point": f"WITH {t}, {timed}, " + _bars(1, f"instrument_id = '{USER}' AND event_ts < window_end AND window_start = (SELECT min(window_start) FROM k WHERE instrument_id = '{USER}')"),
        "q9_bar_10m_point": f"WITH {t}, {timed}, " + _bars(10, f"instrument_id = '{USER}' AND event_ts < window_end AND window_start = (SELECT min(window_start) FROM k WHERE instrument_id = '{USER}')"),
        "q10_set_keys": f"WITH {_CONFIGS} SELECT set_id, position, instrument_id FROM cur_flat WHERE set_id = '{SET}'",
        "q11_inverse_fast": f"WITH {_CONFIGS} SELECT instrument_id, position, set_id FROM inv WHERE instrument_id = '{USER}'",
        "q12_inverse_scan": f"WITH {_CONFIGS} SELECT set_id FROM cur WHERE list_contains(instruments, '{USER}')",
        "q13_all_configs": f"WITH {_CONFIGS} SELECT 'config' AS kind, set_id, instrument_id FROM cur_flat UNION ALL SELECT 'inverse', set_id, instrument_id FROM inv",
        "q14_range_fetch": f"WITH {t}, {plain_hops}, l AS (" + _LATEST.format(src="hops") + f") SELECT * FROM l WHERE instrument_id = '{USER}' AND window_start BETWEEN {SNAP_SQL} - INTERVAL '21 hours' AND {SNAP_SQL} - INTERVAL '18 hours'",
        "q15_full_scan": f"WITH {t}, {plain_hops}, l AS (" + _LATEST.format(src="hops") + ") SELECT instrument_id, window_start, price FROM l",
        "c1_individual_push": chan(t) + " SELECT * FROM keyed",
        "c6_set_push": chan(t) + " SELECT channel_id, seq, set_id, instrument_id, price FROM pushed",
        "c2_bootstrap_simple": chan(late) + f", {_bootstrap('>')} SELECT * FROM boots",
        "c2_bootstrap_sharded": chan(late) + f", {_bootstrap('>=')} SELECT * FROM boots",
        "s4_channel_messages": chan(late) + f", {_bootstrap('>=')} SELECT channel_id, seq, 1 AS phase, 'tick' AS kind, set_id, instrument_id, price FROM pushed UNION ALL SELECT channel_id, seq, 1, 'keyed_tick', NULL, instrument_id, price FROM keyed UNION ALL SELECT channel_id, trigger_seq, 0, 'aggregate', set_id, instrument_id, price FROM boots",
        "r1_delta": f"WITH {t} SELECT instrument_id, arrival_seq, price, CAST(CAST(price AS DECIMAL(18,4)) - lag(CAST(price AS DECIMAL(18,4))) OVER (PARTITION BY instrument_id ORDER BY arrival_seq) AS DECIMAL(18,4)) AS delta FROM ticks",
        "r2_transcript": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    }
