"""Finals of windows that close and pass retention within one micro-batch."""

import datetime as dt

from tickweave import Settings, schemas
from tickweave.operators import latest
from tickweave.streaming.pipelines import ServingTables

B = dt.datetime(2019, 2, 1, 7, tzinfo=dt.UTC)


def test_finals_do_not_depend_on_batches(spark, tmp_path):
    at = [("A", "20", B), ("A", "30", B + dt.timedelta(hours=1)), ("S", "1", B + dt.timedelta(hours=200)), ("A", "40", B + dt.timedelta(hours=201)), ("S", "2", B + dt.timedelta(hours=500))]
    rows = [(i, int(t.timestamp() * 1000), p, "GBP", t, k) for k, (i, p, t) in enumerate(at)]
    cols = ["instrument_id", "window_start", "price", "arrival_seq"]
    rowset = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    want = rowset(latest.final_values(spark.createDataFrame(rows, schemas.TICKS), Settings()))
    for name, cuts in (("one", [5]), ("two", [2, 5]), ("three", [1, 3, 5])):
        tables, start = ServingTables(spark, str(tmp_path / name)), 0
        for batch, stop in enumerate(cuts):
            tables.apply(spark.createDataFrame(rows[start:stop], schemas.TICKS), batch)
            start = stop
        assert rowset(tables.finals()) == want


def test_restart_and_replay(spark, tmp_path):
    """Every batch in a process of its own, one of them twice: the same tables, and old versions go."""
    rows = [("A", 100 * k, str(k), "GBP", B + dt.timedelta(hours=20 * k), k) for k in range(12)]
    frame = lambda a, b: spark.createDataFrame(rows[a:b], schemas.TICKS)
    cols = ["instrument_id", "window_start", "price", "arrival_seq"]
    rowset = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    path = str(tmp_path / "serve")
    assert ServingTables(spark, path).latest() is None
    for batch, (a, b) in ((0, (0, 3)), (1, (3, 6)), (1, (3, 6)), (2, (6, 12))):
        ServingTables(spark, path).apply(frame(a, b), batch)
    again = ServingTables(spark, path)
    assert again.batch == 2 and rowset(again.finals()) == rowset(latest.final_values(frame(0, 12), Settings()))
    assert again.latest().count() > 0 and sorted(p.name for p in (tmp_path / "serve" / "latest").iterdir()) == ["v1", "v2"]
