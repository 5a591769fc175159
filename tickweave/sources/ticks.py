"""Sources: ticks and set configurations from tables or streams, and seeded generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str, *, late: bool = False) -> DataFrame:
    """``events`` as ticks. ``late``: every seventh event arrives forty events later than it happened."""
    seq = F.col("event_id")
    if late:
        slow = F.col("event_id") % 7 == 0
        seq = 2 * (seq + F.when(slow, 40).otherwise(0)) + F.when(slow, 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("instrument_id"),
        F.col("value").cast("decimal(18,4)").cast("string").alias("price"),
        F.lit("GBP").alias("currency"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        seq.cast("bigint").alias("arrival_seq"),
    )


def event_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changelog of set configurations over the users in ``events``.

    Sets m0..m9 are first published with the even users only, then whole; n0..n6 once.
    """
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.concat(F.lit("u"), F.col("user_id"))

    def publish(prefix: str, mod: int, base: int, keep) -> DataFrame:
        return (
            users.filter(keep)
            .groupBy((F.col("user_id") % mod).alias("k"))
            .agg(F.array_sort(F.collect_list(name)).alias("instruments"))
            .select(F.concat(F.lit(prefix), F.col("k")).alias("set_id"), "instruments", (F.col("k") - base).alias("arrival_seq"))
        )

    return (
        publish("m", 10, 300, F.col("user_id") % 2 == 0)
        .unionByName(publish("m", 10, 200, F.lit(True)))
        .unionByName(publish("n", 7, 100, F.lit(True)))
    )


def tick_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from a folder of Parquet files, as a stream."""
    return spark.readStream.schema(schemas.TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: The value of a record.
RECORD = "bloomberg_ts_ms BIGINT, price STRING, currency STRING"


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Kafka records as ticks; needs the connector on the class path."""
    return from_records(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load())


def from_records(raw: DataFrame) -> DataFrame:
    """Records as ticks. Offsets order the rows of one ``partition`` only, so stream time is to be kept by partition
    (``with_stream_time(partition="partition")``); a key's records share a partition, so its last one is well defined."""
    parsed = F.from_json(F.col("value").cast("string"), RECORD)
    flat = raw.select(F.col("key").cast("string").alias("instrument_id"), parsed.alias("v"), F.col("timestamp").alias("event_ts"), "partition", F.col("offset").cast("bigint").alias("arrival_seq"))
    return flat.select("instrument_id", "v.*", "event_ts", "partition", "arrival_seq")


def kafka_records(ticks: DataFrame) -> DataFrame:
    """(key, value) rows for a Kafka sink: ``.write.format("kafka")`` or ``.writeStream.format("kafka")``."""
    return ticks.select(F.col("instrument_id").alias("key"), F.to_json(F.struct("bloomberg_ts_ms", "price", "currency")).alias("value"))


def generated_instruments(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Unique instrument names, the same for the same ``n``."""
    return spark.range(n).select(F.col("id"), F.format_string("I%06d", F.col("id")).alias("instrument_id"))


def generated_ticks(spark: SparkSession, n: int, *, instruments: int = 2000, seed: int = 7, start_ms: int = 395_107_200_000) -> DataFrame:
    """Seeded ticks, one millisecond apart, prices 0 to 999."""
    draw = lambda k, m: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(m))
    return spark.range(1, n + 1).select(
        F.format_string("I%06d", draw(1, instruments)).alias("instrument_id"),
        (F.lit(start_ms) + F.col("id")).alias("bloomberg_ts_ms"),
        draw(2, 1000).cast("string").alias("price"),
        F.lit("GBP").alias("currency"),
        F.timestamp_millis(F.lit(start_ms) + F.col("id")).alias("event_ts"),
        F.col("id").alias("arrival_seq"),
    )
