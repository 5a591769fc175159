"""Named tables, channel delivery and sizes: batch by batch, replayed and after a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave import Settings, schemas
from tickweave.operators import bars, channels, config_index, latest, snapsets
from tickweave.sources import sizing
from tickweave.sources import ticks as sources
from tickweave.streaming.pipelines import set_latest_stream
from tickweave.streaming.stores import ROCKSDB, ChannelDelivery, Stores

B = dt.datetime(2019, 2, 1, 7, tzinfo=dt.UTC)
H, M = dt.timedelta(hours=1), dt.timedelta(minutes=1)
ROWS = [("AAPL", "20", B), ("GOOGL", "120", B), ("AAPL", "50", B + H), ("STARBUCKS", "490", B + H), ("AAPL", "10", B + 3 * H), ("GOOGL", "130", B + 3 * H), ("STARBUCKS", "400", B + 3 * H), ("AAPL", "7", B + 24 * H), ("AAPL", "9", B + 20 * H), ("AAPL", "8", B + 24 * H + M)]


def ticks(spark, rows, start=0):
    return spark.createDataFrame([(i, int(t.timestamp() * 1000), p, "GBP", t, k) for k, (i, p, t) in enumerate(rows, start)], schemas.TICKS)


def same(a, b):
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())) != []


def test_named_tables_equal_batch(spark, tmp_path):
    s, all_ = Settings(), ticks(spark, ROWS)
    c = spark.createDataFrame([("1", ["AAPL"], B, 1), ("2", ["AAPL", "STARBUCKS"], B, 2)], schemas.CONFIG_CHANGELOG)
    stores = Stores(spark, str(tmp_path))
    assert stores.get("latest").count() == stores.get("configs").count() == 0
    stores.take_configs(c, 0)
    for batch, (a, b) in enumerate(((0, 4), (4, 7), (4, 7), (7, 10))):
        stores.take_ticks(ticks(spark, ROWS[a:b], a), batch - (batch > 1))  # the second batch runs twice
    want = {
        "configs": config_index.current_configs(c), "inverse_index": config_index.inverse_index(c), "latest": latest.latest_windows_late(all_, s), "sets_simple": snapsets.simple_rows(all_, c, s),
        "sets_sharded": snapsets.sharded_rows(all_, c, s), "bars_short": bars.bars(all_, s.bar_short, s), "bars_long": bars.bars(all_, s.bar_long, s),
    }
    again = Stores(spark, str(tmp_path))
    assert again.names() == sorted(want)
    for name in want:
        same(again.get(name), want[name])
    with pytest.raises(KeyError):
        again.get("none such")
    stores.take_ticks(ticks(spark, [("AAPL", "1", B + 200 * H)], 10), 3)
    assert stores.get("latest").agg(F.min("window_end")).first()[0] > (B + 128 * H).replace(tzinfo=None)


@pytest.mark.parametrize("cuts", [[10], [2, 5, 10]])
def test_delivery_keeps_is_new(spark, tmp_path, cuts):
    ch = spark.createDataFrame([("1", "set", True, None), ("2", "set", False, B + 24 * H), ("3", "late", True, B + 24 * H), ("4", "one", True, None)], schemas.CHANNELS)
    su = spark.createDataFrame([("set", "2", "1"), ("set", "2", "2"), ("set", "2", "3"), ("instrument", "GOOGL", "4")], schemas.SUBSCRIPTIONS)
    c = spark.createDataFrame([("2", ["AAPL", "STARBUCKS"], B, 2)], schemas.CONFIG_CHANGELOG)
    stores = Stores(spark, str(tmp_path / "log"))
    stores.take_configs(c, 0)
    start = 0
    for batch, stop in enumerate(cuts):
        for _ in range(2):  # every batch is replayed by a new process
            ChannelDelivery(stores, str(tmp_path / "out"), ch, su).apply(ticks(spark, ROWS[start:stop], start), batch)
        start = stop
    got = ChannelDelivery(Stores(spark, str(tmp_path / "log")), str(tmp_path / "out"), ch, su)
    same(got.messages().drop("batch"), channels.messages(ticks(spark, ROWS), c, ch, su))
    state = {x.channel_id: x.is_new for x in got.channels(len(cuts) - 1).collect()}
    served = {x.channel_id for x in got.messages().filter("kind = 'aggregate'").collect()}
    assert "3" in served and state == {"1": "1" not in served, "2": False, "3": False, "4": True}


def test_delivery_as_a_stream_with_rocksdb(spark, tmp_path):
    for k in (0, 5):
        ticks(spark, ROWS[k : k + 5], k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ch = spark.createDataFrame([("4", "one", True, None)], schemas.CHANNELS)
    su = spark.createDataFrame([("instrument", "AAPL", "4")], schemas.SUBSCRIPTIONS)
    delivery = ChannelDelivery(Stores(spark, str(tmp_path / "log")), str(tmp_path / "out"), ch, su)
    delivery.start(sources.tick_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert delivery.messages().count() == 6 and delivery.stores.get("latest").count() > 48
    spark.conf.set(*ROCKSDB)
    try:
        counts = sources.tick_stream(spark, str(tmp_path / "in")).groupBy("instrument_id").count()
        counts.writeStream.format("memory").queryName("n").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
        assert {x.instrument_id: x["count"] for x in spark.table("n").collect()} == {"AAPL": 6, "GOOGL": 2, "STARBUCKS": 2}
    finally:
        spark.conf.unset(ROCKSDB[0])


def test_set_maps_as_a_stream(spark, tmp_path):
    for k in (0, 4, 8):
        ticks(spark, ROWS[k : k + 4], k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = spark.createDataFrame([("1", ["AAPL"], B, 1), ("2", ["AAPL", "STARBUCKS"], B, 2)], schemas.CONFIG_CHANGELOG)
    spread = sources.tick_stream(spark, str(tmp_path / "in")).join(config_index.memberships(c).drop("arrival_seq"), "instrument_id")
    set_latest_stream(spread).writeStream.format("memory").queryName("maps").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("maps").groupBy("set_id", "window_start", "instrument_id").agg(F.max_by("price", "arrival_seq").alias("price"))
    same(got, snapsets.sharded_rows(ticks(spark, ROWS), c).select(*got.columns))


def test_sizes_and_kafka_records(spark, tmp_path):
    rows = sources.generated_ticks(spark, 20_000)
    small = sizing.sizing_ticks(rows)
    assert small.schema.simpleString() == "struct<id:string,bloomberg_timestamp:bigint,price:int>"
    n = {(x.format, x.codec): x.bytes for x in sizing.encoded_sizes(small, str(tmp_path)).collect()}
    assert n["json", "none"] > n["parquet", "none"] > n["parquet", "zstd"] and n["json", "gzip"] < n["json", "none"]
    got = sources.from_records(sources.kafka_records(rows).withColumns({"timestamp": F.current_timestamp(), "partition": F.lit(3), "offset": F.lit(7)}))
    assert got.columns == ["instrument_id", "bloomberg_ts_ms", "price", "currency", "event_ts", "partition", "arrival_seq"]
    same(got.select("instrument_id", "bloomberg_ts_ms", "price", "currency"), rows.select("instrument_id", "bloomberg_ts_ms", "price", "currency"))
