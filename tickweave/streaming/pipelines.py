"""Structured Streaming forms: watermark finals, exact serving tables, ordered per-set state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave.functions.scalars import price_key, shift
from tickweave.operators import windows as W
from tickweave.settings import Settings


def latest_stream(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Latest per (instrument, window) under Spark's own watermark.

    In ``append`` mode each closed window comes out once, in ``update`` mode every change does.
    The watermark moves between micro-batches, so a late row inside one batch is still taken:
    :class:`ServingTables` has the exact rule.
    """
    w = F.window("event_ts", f"{s.window} seconds", f"{s.slide} seconds")
    grouped = ticks.withWatermark("event_ts", f"{s.grace} seconds").groupBy("instrument_id", w)
    out = grouped.agg(F.max_by(F.struct("price", F.col("event_ts").alias("ts"), "arrival_seq"), "arrival_seq").alias("t"))
    return out.select("instrument_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "t.price", F.col("t.ts").alias("event_ts"), "t.arrival_seq")


def bars_stream(ticks: DataFrame, size: int, s: Settings = Settings()) -> DataFrame:
    """High/low bars under Spark's watermark; its own query, as the grace differs."""
    tick = F.struct("price", "arrival_seq")
    keyed = ticks.withColumn("_p", price_key(F.col("price"))).withWatermark("event_ts", f"{s.bar_grace} seconds")
    out = keyed.groupBy("instrument_id", F.window("event_ts", f"{size} seconds")).agg(
        F.max_by(tick, F.struct(F.col("_p"), -F.col("arrival_seq"))).alias("high"), F.min_by(tick, F.struct(F.col("_p"), F.col("arrival_seq"))).alias("low")
    )
    return out.select("instrument_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.col("high.price").alias("high"), F.col("low.price").alias("low"))


class ServingTables:
    """Keeps the readable ``latest`` table and the once-only ``finals`` with per-row lateness.

    Every micro-batch computes stream time over arrival order, seeded with the largest time of the
    batches before, merges the batch's windows into the stored table by arrival, and writes the
    next version; a batch that is run again rewrites the same version. Windows past ``retention``
    leave the stored table, after those that closed in the batch went to the finals.
    """

    def __init__(self, spark: SparkSession, path: str, s: Settings = Settings()) -> None:
        self.spark, self.path, self.s = spark, path, s
        self.batch = self._found()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _found(self) -> int:
        """The last batch that was written whole, by an earlier process too: its finals come last and are committed."""
        p, fs = self._fs(f"{self.path}/finals")
        done = [int(x.getPath().getName()[1:]) for x in (fs.listStatus(p) if fs.exists(p) else []) if fs.exists(self._fs(f"{x.getPath()}/_SUCCESS")[0])]
        return max(done, default=-1)

    def _version(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/v{batch}"

    def latest(self) -> DataFrame | None:
        return self.spark.read.parquet(self._version("latest", self.batch)) if self.batch >= 0 else None

    def finals(self) -> DataFrame | None:
        paths = [self._version("finals", b) for b in range(self.batch + 1)]
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """Body of ``foreachBatch``; also callable with a plain DataFrame."""
        s, old, before = self.s, None, None
        if batch_id > 0:
            old = self.spark.read.parquet(self._version("latest", batch_id - 1))
            before = self.spark.read.parquet(self._version("time", batch_id - 1)).first().stream_time
        seeded = W.with_stream_time(rows, s)
        floor = F.lit(before).cast("timestamp")
        seeded = seeded.withColumn("stream_time", F.greatest("stream_time", floor))
        rows.agg(F.greatest(F.max("event_ts"), floor).alias("stream_time")).write.mode("overwrite").parquet(self._version("time", batch_id))
        now = self.spark.read.parquet(self._version("time", batch_id)).first().stream_time
        kept = W.drop_late(W.hopping(seeded, s), s.grace).select("instrument_id", "window_start", "window_end", "price", "event_ts", "arrival_seq")
        merged = (old.drop("final").unionByName(kept) if old is not None else kept).groupBy("instrument_id", "window_start", "window_end")
        merged = merged.agg(F.max_by(F.struct("price", "event_ts", "arrival_seq"), "arrival_seq").alias("t")).select("instrument_id", "window_start", "window_end", "t.*")
        end, last = F.col("window_end"), F.lit(now).cast("timestamp")
        closed = (shift(end, s.grace) <= last) if now else F.lit(False)
        whole = merged.withColumn("final", closed).persist()
        (whole.filter(shift(end, s.retention) > last) if now else whole).write.mode("overwrite").parquet(self._version("latest", batch_id))
        # A window may close and pass retention in one batch, so finals come from all windows.
        new = whole.filter("final").drop("final")
        if before is not None:
            new = new.filter(shift(end, s.grace) > F.lit(before).cast("timestamp"))
        new.write.mode("overwrite").parquet(self._version("finals", batch_id))
        whole.unpersist()
        self.batch = batch_id
        for name in ("latest", "time"):  # the version before stays, as a batch that runs again reads it
            p, fs = self._fs(self._version(name, batch_id - 2))
            fs.delete(p, True)

    def start(self, ticks: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return ticks.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ConfigTables:
    """Streamed configuration changes: appended changelog and the upserted current table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def changelog(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def start(self, configs: DataFrame, checkpoint: str) -> StreamingQuery:
        return configs.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def set_state_stream(spread: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every change of a set's window map, no grace: one row per (set, tick) row and window, in append mode.

    A change needs no state; the maps are these rows folded by arrival, see :func:`set_latest_stream`.
    """
    return W.hopping(spread, s).select("set_id", "window_start", "instrument_id", "price", "arrival_seq")


def set_latest_stream(spread: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The entries of each set's window maps as they change, in update mode: state is one row per (set, window, instrument).

    The watermark is the retention, so a window leaves the state that long after its end.
    """
    w = F.window("event_ts", f"{s.window} seconds", f"{s.slide} seconds")
    last = F.max_by(F.struct("price", "arrival_seq"), "arrival_seq").alias("t")
    out = spread.withWatermark("event_ts", f"{s.retention} seconds").groupBy("set_id", w, "instrument_id").agg(last)
    return out.select("set_id", F.col("window.start").alias("window_start"), "instrument_id", "t.*")


def channel_sink(messages, path: str):
    """``foreachBatch`` body that turns a batch of ticks into channel messages by ``messages(rows)``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        messages(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
