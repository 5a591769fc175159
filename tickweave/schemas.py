"""Row schemas of the engine, as Spark DDL."""

TICKS = "instrument_id STRING, bloomberg_ts_ms BIGINT, price STRING, currency STRING, event_ts TIMESTAMP, arrival_seq BIGINT"
CONFIG_CHANGELOG = "set_id STRING, instruments ARRAY<STRING>, event_ts TIMESTAMP, arrival_seq BIGINT"
INVERSE_INDEX = "instrument_id STRING, set_ids ARRAY<STRING>"
CHANNELS = "channel_id STRING, category STRING, is_new BOOLEAN, snap_end TIMESTAMP"
SUBSCRIPTIONS = "kind STRING, key STRING, channel_id STRING"
CHANNEL_MESSAGES = "channel_id STRING, seq BIGINT, phase INT, kind STRING, set_id STRING, instrument_id STRING, price STRING"
SIZING_TICKS = "id STRING, bloomberg_timestamp BIGINT, price INT"
#: Instrument used only to move stream time forward.
SYNTHETIC = "SYNTHETIC"
