"""Streams: records that are stored once, a leaderboard kept as state, folders that are deleted."""

import datetime
import os
import random
import time

from pyspark.sql import functions as F

from plotgauge.sources import writers
from plotgauge.streaming import results


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_null_orders_lose_no_record(spark, tmp_path):
    """A null order is the lowest; a key that has no other keeps its record."""
    schema = spark.createDataFrame([], "model string, task string, sample string, error_count long, at long").schema
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    rows = [("m", "t", "a", 3, None), ("m", "t", "b", 4, 1), ("m", "t", "b", 5, None), ("m", "t", "c", 6, None), ("m", "t", "c", 6, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(drop)
    results.stream_new_results(results.read_stream(spark, drop, schema), out, str(tmp_path / "ck"), order="at")
    got = sorted(values(results.stored_results(spark, out, schema), "model", "sample", "error_count", "at"))
    assert got == [("m", "a", 3, None), ("m", "b", 4, 1), ("m", "c", 6, None)]
    board = results.running_leaderboard(results.read_stream(spark, drop, schema), str(tmp_path / "board"), str(tmp_path / "ck2"), order="at")
    assert values(board, "n", "executable") == [(3, 0)]


def test_leaderboard_over_batches_and_a_restart(spark, tmp_path):
    """Four batches in two runs, in any order of arrival: after each batch the board is that of the records so far, and a third run changes nothing."""
    rng = random.Random(6)
    schema = spark.createDataFrame([], "model string, task string, sample string, error_count long, at struct<day:date,n:long>").schema
    drop, out, ck = (str(tmp_path / x) for x in ("drop", "out", "ck"))
    seen = []

    def expected():
        last = {}
        for m, t, s, e, at in seen:
            place = tuple((v is not None, v) for v in (*(at or (None, None)), e))
            if (m, t, s) not in last or place > last[m, t, s][0]:
                last[m, t, s] = (place, e is not None and e <= (t == "data_update"))
        out = {}
        for (m, t, _), (_, ok) in last.items():
            n, k = out.get((m, t), (0, 0))
            out[m, t] = (n + 1, k + ok)
        return sorted((*key, *counts) for key, counts in out.items())

    wanted = []
    for run in range(2):
        for _ in range(2):
            rows = [(f"m{rng.randrange(2)}", rng.choice(["data_update", "data_edit"]), str(rng.randrange(15)), rng.choice([None, 0, 1, 2]), rng.choice([None, (datetime.date(2024, 1, rng.randrange(1, 5)), rng.choice([None, 1, 2]))])) for _ in range(40)]
            seen += rows
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(drop)
            wanted.append(expected())
            time.sleep(1.1)  # files are taken in the order of their times
        board = results.running_leaderboard(results.read_stream(spark, drop, schema, files_per_batch=1), out, ck, order="at")
        assert sorted(tuple(r) for r in board.collect()) == wanted[-1]
    every = results.boards(spark, out)
    assert [sorted(tuple(r)[:4] for r in every.where(F.col("batch") == k).collect()) for k in range(4)] == wanted
    again = results.running_leaderboard(results.read_stream(spark, drop, schema, files_per_batch=1), out, ck, order="at")
    assert sorted(tuple(r) for r in again.collect()) == wanted[-1] and results.boards(spark, out).agg(F.max("batch")).first()[0] == 3


def test_scratch_is_deleted(spark):
    df = writers.settle(spark.range(3), "numbers")
    path = writers._MADE[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    kept = writers._MADE[spark.sparkContext.applicationId][:-1]
    writers._MADE[spark.sparkContext.applicationId] = [path]
    writers.drop_scratch(spark)
    writers._MADE[spark.sparkContext.applicationId] = kept
    assert not os.path.exists(path.removeprefix("file:"))


def test_last_of_a_batch_before_python():
    """One row of each key leaves a batch: the last by order, null lowest, then by error count."""
    import pyarrow as pa

    rows = [("m", "t", None, 9), ("m", "t", 2, 1), ("m", "t", 2, 3), ("m", "t", 1, 8), ("m", "u", None, 4), ("m", "u", None, None), (None, "u", 5, 0)]
    names = ["model", "task", "_o0", "_errors"]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows)), pa.array([k % 2 == 0 for k in range(len(rows))])], names=[*names, "_executable"])
    got = results._last_in_batch(batch, 2).to_pylist()
    assert sorted((tuple(r.values()) for r in got), key=str) == sorted([("m", "t", 2, 3, True), ("m", "u", None, 4, True), (None, "u", 5, 0, True)], key=str)
    assert results._last_in_batch(batch.slice(0, 0), 2).num_rows == 0
