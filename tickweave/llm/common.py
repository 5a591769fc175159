"""Shared folder, lineage cuts, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's, or one of our own where none is set and all run in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(found := "file://" + tempfile.mkdtemp(prefix="shared"))
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and safe when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, which is compressed and read by column."""
    df.write.parquet(path := fresh_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: log2 of the words in a bit map of hashes, and of the words in one row of it.
MAP_WORDS, ROW_WORDS = 20, 3


def _row(h) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_WORDS + ROW_WORDS)


def _word(h) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_WORDS).bitwiseAND(F.lit((1 << ROW_WORDS) - 1))


def _bit(h) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58 - MAP_WORDS).bitwiseAND(F.lit(63)).cast("int"))


def marked(hashes: DataFrame) -> DataFrame:
    """A bit map of 64-bit hashes (the one column) of fixed size: 2^(MAP_WORDS - ROW_WORDS) rows of 2^ROW_WORDS words at most, at any size of input.

    The driver collects, builds and sends it, and a row costs it several times the word it holds; hence the words in a row.
    """
    h = hashes.columns[0]
    words = [F.bit_or(F.when(_word(h) == j, _bit(h)).otherwise(F.lit(0).cast("bigint"))).alias(f"_bits{j}") for j in range(1 << ROW_WORDS)]
    return hashes.groupBy(_row(h).alias("_row")).agg(*words)


def maybe_in(rows: DataFrame, column: str, bits: DataFrame, both: bool = False):
    """The rows whose hash ``column`` may be marked in the map: all that are, and few others; with ``both``, the others too.

    A filter before a shuffle that decides nothing by itself: a map that is full lets all rows pass, which
    costs a larger shuffle and changes no result. What is broadcast has a fixed bound (see ``marked``).
    """
    h = rows[column]
    found = rows.join(F.broadcast(bits), _row(h) == F.col("_row"), "left" if both else "inner")
    held = F.coalesce(*[F.when(_word(h) == j, F.col(f"_bits{j}")) for j in range(1 << ROW_WORDS)])
    hit = F.coalesce(held.bitwiseAND(_bit(h)) != 0, F.lit(False))
    return (found.filter(hit).select(*rows.columns), found.filter(~hit).select(*rows.columns)) if both else found.filter(hit).select(*rows.columns)


#: Edges that ``grouped`` settles on the driver at most: 16 bytes each.
AT_ONCE = 200_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        lx, ly = low[x], low[y]
        apart = lx != ly
        if not apart.any():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(lx[apart], ly[apart]), np.minimum(lx[apart], ly[apart]))
        while (low[low] != low).any():
            low = low[low]


def released(spark: SparkSession) -> None:
    """Has the driver give up what nothing holds any more; Spark drops the broadcasts, shuffles and cut rows behind it only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grouped(edges: DataFrame) -> DataFrame:
    """What ``components`` gives, for edges that were cut before; at most AT_ONCE of them take no rounds of jobs and no shuffles."""
    released(edges.sparkSession)
    if edges.count() > AT_ONCE:
        return cut(components(edges))
    table = edges.filter("a <> b").select("a", "b").toArrow()
    nodes, low = smallest(*(table.column(c).to_numpy().astype(np.int64) for c in "ab"))
    found = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(low, pa.int64())})
    return cut(edges.sparkSession.createDataFrame(found, "node BIGINT, component BIGINT"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component: its smallest node.

    Alternates large-star and small-star contraction until the edges stay the same. Minima are
    aggregated before they are joined back, so no node's neighbours meet in one task.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    seen = None
    while True:
        e = cut(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
