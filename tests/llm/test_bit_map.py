"""The bit map that is broadcast before shuffles: few wide rows, no marked hash lost, others split off."""

import random

from pyspark.sql import functions as F

from tickweave.llm import common


def test_map_has_few_rows_and_loses_no_hash(spark):
    """40,000 hashes took as many rows, nearly, when a row held one word."""
    r = random.Random(16)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(40_000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    rest = [r.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    hashes = spark.createDataFrame([(h,) for h in some], "h BIGINT")
    bits = common.marked(hashes)
    most = 1 << common.MAP_WORDS - common.ROW_WORDS
    assert bits.count() <= min(most, len(set(some)))
    wide = common.marked(spark.range(1_000_000).select(F.xxhash64("id").alias("h")))
    assert wide.count() <= most == 1 << 17
    rows = spark.createDataFrame([*((h, True) for h in some[:40_000]), *((h, False) for h in rest)], "own BIGINT, held BOOLEAN")
    inside, outside = common.maybe_in(rows, "own", bits, both=True)
    assert inside.filter("held").count() == 40_000 and outside.filter("held").count() == 0
    assert inside.count() + outside.count() == 60_000 and inside.filter("NOT held").count() < 400
    edges = spark.createDataFrame([(h,) for h in some[40_000:]], "own BIGINT")
    assert common.maybe_in(edges, "own", bits).count() == 4
    assert common.maybe_in(rows, "own", bits.limit(0)).count() == 0
