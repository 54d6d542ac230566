"""Incremental evaluation: new results are stored once, leaderboards follow along."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.writers import scratch  # noqa: F401

KEYS = ("model", "task", "sample")


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Result files as they arrive in a folder, all that are new as one batch unless `files_per_batch` is given."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_new_results(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = KEYS, order: str | None = None, replace: bool = False, buckets: int = 64):
    """Store the records of samples that have no result yet, and wait until what is there now is done.

    A batch is first reduced to one record for each key, the last by `order` if it is given; a null `order` is the lowest. A key whose stored record has an error
    count is done, and what comes later for it is left out; without one, as the gate leaves it, the sample is evaluated anew and the later
    record counts. With `replace` every later record counts. Keys are stored in `buckets` by their hash, so that a batch reads the
    buckets that it has keys of, not all keys ever stored. A batch that is run again after a failure replaces its own part.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        record = F.struct(*batch.columns)
        fresh = batch.groupBy(*keys).agg((F.max_by(record, _rank(order)) if order else F.first(record)).alias("_r")).select("_r.*")
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if not replace and _exists(spark, out):
            own = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # `buckets` numbers at most
            done = _stored(spark, out, batch.schema).where(F.col("bucket").isin(own) & (F.col("batch") < number) & F.col("error_count").isNotNull())
            fresh = fresh.join(done.select(*keys), list(keys), "left_anti")
        fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _rank(order: str) -> Column:
    """`order` as a value that is never null, so that no record is passed over: null first, then by value."""
    return F.struct(F.col(order).isNotNull(), F.col(order))


def _stored(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    whole = StructType(list(schema.fields)).add("bucket", "integer").add("batch", "long")
    return spark.read.schema(whole).parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_results(spark: SparkSession, out: str, schema: StructType, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The record that counts for each key: of several, that of the last batch. Nothing stored gives no rows."""
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    rows = _stored(spark, out, schema).groupBy("bucket", *keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("_r"))
    return rows.select("_r.*")


BOARD = "model string, task string, n long, executable long"


#: Keys whose last record a task holds before it hands them on.
HELD_KEYS = 50_000


def _place(values: tuple) -> tuple:
    """Order of records: by `order`, null lowest, then by error count."""
    return tuple((v is not None, v) for v in values)


def _last_in_batch(batch: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    """The last row of each key, so that Python sees one row a key and not all of them."""
    rows = batch.take(pc.sort_indices(batch, sort_keys=[(n, "ascending") for n in batch.schema.names[n_keys:-1]], null_placement="at_start"))
    at = pa.array(np.arange(rows.num_rows))
    keys = pa.Table.from_arrays([*rows.columns[:n_keys], at], names=[*(f"k{k}" for k in range(n_keys)), "at"])
    return rows.take(keys.group_by([f"k{k}" for k in range(n_keys)]).aggregate([("at", "max")])["at_max"].combine_chunks())


def _last_in_task(rows: DataFrame, n_keys: int) -> DataFrame:
    """(keys..., _value): of the rows of each task the last one for each key, as a pickled tuple, before anything is shuffled. A key that most rows bear stays small."""
    keys = rows.schema.fields[:n_keys]

    def run(batches):
        last: dict[tuple, tuple] = {}

        def handed_on(like):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*last), like.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(pickle.dumps, last.values()), pa.binary())], names=[*like.names[:n_keys], "_value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in _last_in_batch(batch, n_keys).columns)):
                key, value = row[:n_keys], row[n_keys:]
                if key not in last or _place(value[:-1]) > _place(last[key][:-1]):
                    last[key] = value
            if len(last) > HELD_KEYS:
                yield from handed_on(batch.schema)
                last.clear()
        if last:
            yield from handed_on(batch.schema)

    return rows.mapInArrow(run, StructType(keys).add("_value", "binary"))


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the last record of a key as its state, and tell what it changes about the counts of its model and task."""
    last = max((pickle.loads(v) for f in frames for v in f["_value"]), key=lambda v: _place(v[:-1]))
    old = tuple(state.get) if state.exists else None
    if old is not None and len(old) > 2 and _place(last[:-1]) < _place(old[:-1]):
        return
    state.update(last)
    new, gone = int(last[-1]), 0 if old is None else int(old[-1])
    if old is None or new != gone:
        yield pd.DataFrame({"model": [key[0]], "task": [key[1]], "n": [int(old is None)], "executable": [new - gone]})


def running_leaderboard(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = KEYS, order: str | None = None) -> DataFrame:
    """(model, task, n, executable): counts over everything evaluated so far, kept up to date by each batch; see ``boards`` for all of them.

    Each key counts once, by its last record: the one of greatest `order` (a column, or a struct of plain columns; null is the lowest),
    ties by error count, whatever batch it came in; without `order` that of the last batch. What counts of a key is Spark's state of
    that key: a later record takes the old one's part back and adds its own, and nothing that was stored is read
    again. A batch writes the whole board, at most a row for each model and task, from the board before it; run again after a failure
    it writes the same. The first two of `keys` are model and task.
    """
    spark = stream.sparkSession
    fields = [] if order is None else [F.col(f"{order}.{f.name}") for f in stream.schema[order].dataType.fields] if isinstance(stream.schema[order].dataType, StructType) else [F.col(order)]
    ok = F.coalesce(F.col("error_count") <= F.when(F.col("task") == "data_update", 1).otherwise(0), F.lit(False))
    rows = stream.select(*keys, *[c.alias(f"_o{k}") for k, c in enumerate(fields)], F.col("error_count").cast("long").alias("_errors"), ok.alias("_executable"))
    kept = StructType(rows.schema.fields[len(keys) :])
    changes = _last_in_task(rows, len(keys)).groupBy(*keys).applyInPandasWithState(_follow, BOARD, kept, "update", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, number: int) -> None:
        # foreachBatch numbers batches one by one, so the board before this one is that of the number before
        before = batch.sparkSession.read.schema(BOARD).parquet(f"{out}/batch={number - 1}") if number and _exists(batch.sparkSession, f"{out}/batch={number - 1}") else None
        both = batch if before is None else batch.unionByName(before)
        both.groupBy("model", "task").agg(F.sum("n").alias("n"), F.sum("executable").alias("executable")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    every = boards(spark, out)
    last = every.agg(F.max("batch").alias("_last"))
    return every.join(last, F.col("batch") == F.col("_last")).select("model", "task", "n", "executable")


def boards(spark: SparkSession, out: str) -> DataFrame:
    """(model, task, n, executable, batch): the leaderboard after each batch."""
    if not _exists(spark, out):
        return spark.createDataFrame([], BOARD + ", batch long")
    return spark.read.schema(BOARD + ", batch long").parquet(out)
