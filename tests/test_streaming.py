from __future__ import annotations

import datetime as dt

import pytest

from corpusmill.operators.store import KeyedTable
from corpusmill.streaming.posts import alone, changed_stream, miss_counts, run_available, upsert_stream, windowed_counts


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def collected(spark, query, checkpoint):
    found = []
    run_available(query, lambda batch, _: found.extend(map(tuple, batch.collect())), checkpoint)
    return found


def test_upsert_stream_can_be_replayed(spark, tmp_path):
    schema = "id int, v string, at int"
    rows = stream(spark, f"{tmp_path}/in", [(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema)
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], spark.createDataFrame([], schema).schema)
    upsert_stream(rows, table, ["at"], f"{tmp_path}/ck1").awaitTermination()
    stream(spark, f"{tmp_path}/in", [(2, "d", 5)], schema)
    upsert_stream(rows, table, ["at"], f"{tmp_path}/ck1").awaitTermination()
    upsert_stream(rows, table, ["at"], f"{tmp_path}/ck2").awaitTermination()
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "b"), (2, "d")]


def test_miss_counts(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False)]
    query = miss_counts(stream(spark, f"{tmp_path}/in", rows, "k string, run long, seen boolean"), "k", "run")
    found = collected(spark, query, f"{tmp_path}/ck")
    assert {(k, r): (n, e) for k, r, n, e in found} == {("a", 1): (1, False), ("a", 2): (2, False), ("a", 3): (3, True), ("b", 1): (1, False), ("b", 2): (0, False), ("b", 3): (1, False)}


def test_changed_stream_keeps_state_between_runs(spark, tmp_path):
    schema = "k string, h string, v long"
    # Out of order within a batch, a version twice, a missing digest.
    rows = [("a", "2", 5), ("a", "1", 1), ("b", "1", 1), ("a", "2", 4), ("a", "2", 5), ("c", None, 1)]
    query = changed_stream(stream(spark, f"{tmp_path}/in", rows, schema), "k", "h", "v")
    assert sorted(collected(spark, query, f"{tmp_path}/ck")) == [("a", 1, "1", "new"), ("a", 4, "2", "updated"), ("b", 1, "1", "new")]
    stream(spark, f"{tmp_path}/in", [("a", "2", 6), ("b", "2", 2), ("a", "0", 3)], schema)
    assert collected(spark, query, f"{tmp_path}/ck") == [("b", 2, "2", "updated")]


def test_runs_do_not_overlap(spark, tmp_path):
    lock = f"{tmp_path}/x.lock"
    with alone(spark, lock):
        with pytest.raises(RuntimeError, match="another run"), alone(spark, lock):
            pass
    with alone(spark, lock):
        pass


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(t, "x"), (t + dt.timedelta(minutes=5), "x"), (t + dt.timedelta(hours=3), "y")]
    query = windowed_counts(stream(spark, f"{tmp_path}/in", rows, "ts timestamp, k string"), "ts", "k")
    found = collected(spark, query, f"{tmp_path}/ck")
    assert (t, "x", 2) in found
