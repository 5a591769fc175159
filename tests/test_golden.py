"""Small hand-made sequences with known results, batch and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave import Settings, schemas
from tickweave.functions import scalars
from tickweave.operators import bars, channels, config_index, latest, snapsets
from tickweave.sources import ticks as sources
from tickweave.streaming.pipelines import ConfigTables, ServingTables, bars_stream, latest_stream, set_state_stream

B = dt.datetime(2019, 2, 1, 7, tzinfo=dt.UTC)
M, H = dt.timedelta(minutes=1), dt.timedelta(hours=1)
S = Settings()
EARLY = [("AAPL", "20", B), ("GOOGL", "120", B), ("AAPL", "50", B + H), ("GOOGL", "150", B + H), ("STARBUCKS", "490", B + H)]
LATER = [("AAPL", "10", B + 3 * H), ("GOOGL", "130", B + 3 * H), ("STARBUCKS", "400", B + 3 * H)]
SYN = lambda t: ("SYNTHETIC", "88", t)


def ticks(spark, rows, start=0):
    return spark.createDataFrame([(i, int(t.timestamp() * 1000), p, "GBP", t, k) for k, (i, p, t) in enumerate(rows, start)], schemas.TICKS)


def configs(spark):
    return spark.createDataFrame([("1", ["AAPL"], B, 1), ("2", ["AAPL", "STARBUCKS"], B, 2)], schemas.CONFIG_CHANGELOG)


def finals(spark, rows):
    got = latest.final_values(ticks(spark, rows)).filter("instrument_id <> 'SYNTHETIC'").select(F.unix_seconds("window_start").alias("s")).collect()
    return sorted(x.s - int(B.timestamp()) for x in got)


def test_finals_at_boundaries(spark):
    first = [("AAPL", "20", B), SYN(B + 24 * H)]
    assert len(finals(spark, first)) == 47 and finals(spark, first)[0] == -23.5 * 3600
    assert len(finals(spark, [*first, SYN(B + 24 * H + 5 * M)])) == 48
    late = [("AAPL", "20", B - dt.timedelta(milliseconds=1)), SYN(B + M)]
    assert finals(spark, late) == []
    assert finals(spark, [*late, SYN(B + 5 * M)]) == [-24 * 3600]
    assert len(finals(spark, [*late, SYN(B + 5 * M), SYN(B + 65 * M)])) == 3


def test_grace_per_record(spark):
    rows = [("AAPL", "20", B), ("AAPL", "50", B + 31 * M), SYN(B + 63 * M), ("AAPL", "10", B + 59 * M), SYN(B + 66 * M), ("AAPL", "12", B + 59 * M)]

    def state(n):
        got = latest.latest_windows_late(ticks(spark, rows[:n])).filter("instrument_id = 'AAPL'").orderBy("window_start").collect()
        return [x.price for x in got[:4]]

    assert state(3) == ["20", "50", "50", "50"]
    assert state(5) == ["20", "10", "10", "10"]
    assert state(6) == ["20", "10", "12", "12"]  # the last tick is too late for the second window only


def test_snapshots(spark):
    t, c = ticks(spark, EARLY + LATER), configs(spark)
    want = {"1": {"AAPL": "10"}, "2": {"AAPL": "10", "STARBUCKS": "400"}}
    for s, m in want.items():
        assert snapsets.on_demand_map(t, c, s, B + 24 * H).first().instruments == m
        for rows in (snapsets.simple_rows(t, c), snapsets.sharded_rows(t, c), snapsets.direct_rows(t, c, s, B + 24 * H)):
            assert snapsets.as_maps(snapsets.at_end(rows, s, B + 24 * H)).first().instruments == m
    shards = snapsets.sharded_rows(t, c, Settings(shards=3), by_shard=True)
    assert snapsets.merge_shards(shards).filter(F.col("window_end") == F.lit(B + 24 * H)).count() == 2
    assert snapsets.on_demand_map(t, c, "1", B + 7 * M).first().instruments == {}
    assert latest.latest_at(t, B + 24 * H).count() == 3
    exclusive = ticks(spark, [("AAPL", "1", B), ("GOOGL", "3", B + 4 * H), ("AAPL", "2", B + 24 * H)])
    assert {x.instrument_id: x.price for x in latest.latest_at(exclusive, B + 24 * H).collect()} == {"AAPL": "1", "GOOGL": "3"}


def test_bars(spark):
    s = dt.timedelta(seconds=1)
    rows = [("AAPL", "20", B), ("GOOGL", "120", B), ("AAPL", "50", B + 20 * s), ("GOOGL", "150", B + 22 * s), ("AAPL", "10", B + 70 * s), ("GOOGL", "130", B + 72 * s), ("AAPL", "120", B + 2 * M), ("AAPL", "150", B + 3 * M), ("AAPL", "250", B + 4 * M), ("AAPL", "1", B + 5 * M), ("AAPL", "101000", B + 11 * M)]
    t = ticks(spark, rows)
    one = lambda size, end, i: [(x.high.price, x.low.price) for x in bars.bar_at(t, size, end, i).collect()]
    assert one(60, B + M, "AAPL") == [("50", "20")] and one(60, B + M, "GOOGL") == [("150", "120")] and one(60, B + 20 * M, "AAPL") == []
    assert one(600, B + 10 * M, "AAPL") == [("250", "1")] and one(600, B + 20 * M, "AAPL")[0][0] == "101000" and one(600, B + 30 * M, "AAPL") == []
    tie = bars.bars(ticks(spark, [("A", "9", B), ("A", "9.0", B), ("A", "10", B), ("A", "10.0", B)]), 60).first()
    assert (tie.high.price, tie.low.price) == ("10", "9")


def test_configs(spark):
    c = configs(spark)
    assert config_index.sets_by_index(c, "AAPL").first().set_ids == ["1", "2"]
    assert config_index.sets_by_scan(c, "GOOGL").count() == 0 and config_index.sets_by_scan(c, "STARBUCKS").count() == 1
    assert config_index.current_configs(c).count() == config_index.inverse_index(c).count() == 2
    again = c.unionByName(c.withColumn("arrival_seq", F.col("arrival_seq") + 10))
    assert config_index.sets_by_index(again, "AAPL").first().set_ids == ["1", "2", "1", "2"]
    assert config_index.inverse_index(again, current=True).filter("instrument_id = 'AAPL'").first().set_ids == ["1", "2"]
    with pytest.raises(KeyError):
        config_index.instruments_of(c, "9")


def test_channels(spark):
    ch = spark.createDataFrame([("1", "set", True, None), ("2", "set", True, None), ("3", "ind", True, None), ("4", "late", True, B + 24 * H)], schemas.CHANNELS)
    su = spark.createDataFrame([("set", "1", "1"), ("set", "1", "2"), ("set", "2", "2"), ("instrument", "GOOGL", "3"), ("set", "2", "4")], schemas.SUBSCRIPTIONS)
    t = ticks(spark, EARLY + LATER).withColumn("wall", F.lit(B + dt.timedelta(seconds=7)).cast("timestamp"))
    got = channels.messages(t, configs(spark), ch.filter("channel_id <> '4'"), su, wall="wall").collect()
    assert sorted(x.channel_id for x in got) == ["1"] * 3 + ["2"] * 8 + ["3"] * 3
    assert [x.price for x in sorted(got, key=lambda x: x.seq) if x.channel_id == "3"] == ["120", "150", "130"]
    late = [(*x,) for x in channels.messages(t, configs(spark), ch.filter("channel_id = '4'"), su, inclusive=True, wall="wall").orderBy("seq", "phase").select("phase", "instrument_id", "price").collect()]
    assert late[:2] == [(0, "AAPL", "20"), (1, "AAPL", "20")]
    before = channels.bootstrap(t, configs(spark), ch.filter("channel_id = '4'"), su, inclusive=False, wall="wall").collect()
    assert [(x.instrument_id, x.price, x.trigger_seq) for x in before] == [("AAPL", "20", 2)]
    after = t.withColumn("wall", F.lit(B + 24 * H + M).cast("timestamp"))
    assert channels.set_push(after, configs(spark), ch, su, wall="wall").filter("channel_id = '4'").count() == 0


def test_money_and_generators(spark):
    one = spark.range(1).select(scalars.of_minor(F.lit(150), F.lit("NZD")).alias("a"), scalars.add_money(F.lit(1), F.lit("GBP"), F.lit(2), F.lit("GBP")).alias("b")).first()
    assert float(one.a) == 1.5 and one.b == 3
    with pytest.raises(Exception, match="currency mismatch"):
        spark.range(1).select(scalars.add_money(F.col("id"), F.lit("GBP"), F.lit(2), F.lit("EUR"))).collect()
    a, b = (sources.generated_ticks(spark, 500).collect() for _ in range(2))
    assert a == b and len({x.event_ts for x in a}) == 500 and sources.generated_instruments(spark).distinct().count() == 2000


@pytest.fixture
def files(spark, tmp_path):
    rows = [*EARLY, *LATER, SYN(B + 30 * H), ("AAPL", "99", B + H), SYN(B + 60 * H)]
    for k in range(0, len(rows), 4):
        ticks(spark, rows[k : k + 4], k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path)


def test_streaming_serving_tables_equal_batch(spark, files):
    rows, path = files
    tables = ServingTables(spark, f"{path}/serve", Settings(retention=1000 * 3600))
    tables.start(sources.tick_stream(spark, f"{path}/in"), f"{path}/cp").awaitTermination()
    cols = ["instrument_id", "window_start", "price", "arrival_seq"]
    rowset = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rowset(tables.latest()) == rowset(latest.latest_windows_late(ticks(spark, rows)))
    assert rowset(tables.finals()) == rowset(latest.final_values(ticks(spark, rows)))


def test_streaming_watermark_finals(spark, files):
    rows, path = files
    stream = latest_stream(sources.tick_stream(spark, f"{path}/in"))
    q = stream.writeStream.format("memory").queryName("finals").outputMode("append").option("checkpointLocation", f"{path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("finals").filter("instrument_id = 'GOOGL'")
    assert got.count() == latest.final_values(ticks(spark, rows)).filter("instrument_id = 'GOOGL'").count() > 40
    b = bars_stream(sources.tick_stream(spark, f"{path}/in"), 600)
    q = b.writeStream.format("memory").queryName("bars").outputMode("update").option("checkpointLocation", f"{path}/cp3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bars").filter("instrument_id = 'GOOGL'").count() == 3


def test_streaming_state_and_configs(spark, files):
    rows, path = files
    spread = sources.tick_stream(spark, f"{path}/in").join(config_index.memberships(configs(spark)).drop("arrival_seq"), "instrument_id")
    q = set_state_stream(spread).writeStream.format("memory").queryName("sets").outputMode("append").option("checkpointLocation", f"{path}/cp4").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("sets").groupBy("set_id", "window_start", "instrument_id").agg(F.max_by("price", "arrival_seq").alias("price"))
    want = snapsets.sharded_rows(ticks(spark, rows), configs(spark)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    configs(spark).write.parquet(f"{path}/cfg")
    tables = ConfigTables(spark, f"{path}/cfgs")
    tables.start(spark.readStream.schema(schemas.CONFIG_CHANGELOG).parquet(f"{path}/cfg"), f"{path}/cp5").awaitTermination()
    assert config_index.current_configs(tables.changelog()).count() == 2
