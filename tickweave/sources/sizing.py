"""Stored sizes of the same rows in different formats and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = (("json", "none"), ("json", "gzip"), ("orc", "none"), ("orc", "snappy"), ("orc", "zstd"), ("parquet", "none"), ("parquet", "snappy"), ("parquet", "gzip"), ("parquet", "zstd"))


def sizing_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks in the small schema that sizes are compared on (``schemas.SIZING_TICKS``)."""
    return ticks.select(F.col("instrument_id").alias("id"), F.col("bloomberg_ts_ms").alias("bloomberg_timestamp"), F.col("price").cast("int").alias("price"))


def encoded_sizes(rows: DataFrame, folder: str, formats: tuple[tuple[str, str], ...] = FORMATS) -> DataFrame:
    """(format, codec, bytes, share): what ``rows`` take in each format, and of the largest; files stay in ``folder``."""
    spark, out = rows.sparkSession, []
    for kind, codec in formats:
        rows.write.mode("overwrite").format(kind).option("compression", codec).save(target := f"{folder}/{kind}-{codec}")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        out.append((kind, codec, path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()))
    top = max(n for *_, n in out)
    return spark.createDataFrame([(k, c, n, n / top) for k, c, n in out], "format STRING, codec STRING, bytes BIGINT, share DOUBLE")
