"""Named tables that can be read while windows are open, and channel delivery, from logs kept by micro-batches.

Micro-batches only append: a batch that runs again rewrites its own folder, so a replay changes nothing, and all
state is in the folders, so a restarted process goes on where the last one stood. Tables are read through the
same operators as the batch form; a filter on a key or time reaches the scan of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave import schemas
from tickweave.functions.scalars import shift
from tickweave.operators import bars, channels, config_index, latest, snapsets
from tickweave.settings import Settings

#: Spark setting that keeps streaming state in RocksDB instead of on the heap.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Stores:
    """The registry of tables over one log of ticks and one of set configurations."""

    def __init__(self, spark: SparkSession, path: str, s: Settings = Settings()) -> None:
        self.spark, self.path, self.s = spark, path, s
        self.tables: dict[str, Callable[[], DataFrame]] = {
            "configs": lambda: config_index.current_configs(self.changelog()),
            "inverse_index": lambda: config_index.inverse_index(self.changelog()),
            "latest": lambda: self._retained(latest.latest_windows_late(self.ticks(), s)),
            "sets_simple": lambda: self._retained(snapsets.simple_rows(self.ticks(), self.changelog(), s)),
            "sets_sharded": lambda: self._retained(snapsets.sharded_rows(self.ticks(), self.changelog(), s)),
            "bars_short": lambda: self._retained(bars.bars(self.ticks(), s.bar_short, s)),
            "bars_long": lambda: self._retained(bars.bars(self.ticks(), s.bar_long, s)),
        }

    def names(self) -> list[str]:
        return sorted(self.tables)

    def get(self, name: str) -> DataFrame:
        """A table as of the batches taken so far; KeyError for a name that is not registered."""
        return self.tables[name]()

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch BIGINT")

    def ticks(self, upto: int | None = None) -> DataFrame:
        rows = self._log("ticks", schemas.TICKS)
        return (rows if upto is None else rows.filter(F.col("batch") <= upto)).drop("batch")

    def changelog(self) -> DataFrame:
        return self._log("configs", schemas.CONFIG_CHANGELOG).drop("batch")

    def _retained(self, table: DataFrame) -> DataFrame:
        last = self.ticks().agg(F.max("event_ts").alias("_last"))
        return table.crossJoin(F.broadcast(last)).filter(shift(F.col("window_end"), self.s.retention) > F.col("_last")).drop("_last")

    def take_ticks(self, rows: DataFrame, batch_id: int) -> None:
        """Body of ``foreachBatch`` for ticks; also callable with a plain DataFrame."""
        rows.select(*[c.split()[0] for c in schemas.TICKS.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/ticks/batch={batch_id}")

    def take_configs(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/configs/batch={batch_id}")

    def start(self, stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ChannelDelivery:
    """Messages to channels batch by batch, with ``is_new`` kept: a channel gets its snapshot once, in whichever batch.

    A batch writes the messages of its own ticks and then the channels' state after it.
    """

    def __init__(self, stores: Stores, path: str, registered: DataFrame, subscriptions: DataFrame, *, inclusive: bool = True) -> None:
        self.stores, self.path, self.registered, self.subscriptions, self.inclusive = stores, path, registered, subscriptions, inclusive

    def channels(self, batch_id: int) -> DataFrame:
        """The channels after a batch."""
        return self.stores.spark.read.schema(schemas.CHANNELS).parquet(f"{self.path}/channels/v{batch_id}")

    def messages(self) -> DataFrame:
        return self.stores.spark.read.schema(f"{schemas.CHANNEL_MESSAGES}, batch BIGINT").parquet(f"{self.path}/messages")

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """Body of ``foreachBatch``: logs the ticks and delivers."""
        self.stores.take_ticks(rows, batch_id)
        now = self.registered if batch_id == 0 else self.channels(batch_id - 1)
        first = rows.agg(F.min("arrival_seq").alias("first"))
        out = channels.messages(self.stores.ticks(batch_id), self.stores.changelog(), now, self.subscriptions, self.stores.s, inclusive=self.inclusive)
        target = f"{self.path}/messages/batch={batch_id}"
        own = out.crossJoin(F.broadcast(first)).filter(F.col("seq") >= F.col("first")).drop("first")
        own.write.mode("overwrite").parquet(target)
        served = self.stores.spark.read.schema(schemas.CHANNEL_MESSAGES).parquet(target).filter("kind = 'aggregate'").select("channel_id").distinct().withColumn("served", F.lit(True))
        after = now.join(served, "channel_id", "left").withColumn("is_new", F.col("is_new") & F.col("served").isNull()).drop("served")
        after.select(*now.columns).write.mode("overwrite").parquet(f"{self.path}/channels/v{batch_id}")

    def start(self, ticks: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return self.stores.start(ticks, self.apply, checkpoint, **trigger)
