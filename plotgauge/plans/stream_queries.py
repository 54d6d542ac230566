"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..streaming import results as R
from .registry import query

_TASK = "CASE l_partkey % 6 WHEN 0 THEN 'before_complex' WHEN 1 THEN 'after_complex' WHEN 2 THEN 'data_edit' WHEN 3 THEN 'data_interaction' WHEN 4 THEN 'data_newStyle' ELSE 'data_update' END"
_ERRORS = "CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 < 3 THEN 2 WHEN l_partkey % 6 = 5 THEN 1 ELSE 0 END"


def _stream(spark, d):
    """Line items as arriving evaluation records."""
    schema = table(spark, d, "lineitem").schema
    rows = R.read_stream(spark, f"{d}/lineitem*.parquet", schema, "parquet")
    return rows.select(
        F.concat(F.lit("m"), F.lpad((F.col("l_suppkey") % 17).cast("string"), 2, "0")).alias("model"),
        F.expr(_TASK).alias("task"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("sample"),
        F.expr(f"CAST({_ERRORS} AS BIGINT)").alias("error_count"),
    )


_RECORDS = f"""
SELECT DISTINCT concat('m', lpad(CAST(l_suppkey % 17 AS VARCHAR), 2, '0')) AS model, {_TASK} AS task, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS sample, CAST({_ERRORS} AS BIGINT) AS error_count
FROM lineitem"""


@query("r1_stream_new_results", _RECORDS)
def r1(spark, d):
    out = R.scratch(spark, "results")
    stream = _stream(spark, d)
    R.stream_new_results(stream, out, R.scratch(spark, "checkpoint"))
    return R.stored_results(spark, out, stream.schema)


_LAST = """
SELECT model, task, sample, arg_max(error_count, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS error_count FROM (
  SELECT concat('m', lpad(CAST(l_suppkey % 17 AS VARCHAR), 2, '0')) AS model, {task} AS task, CAST(l_orderkey % 50 AS VARCHAR) AS sample, CAST({errors} AS BIGINT) AS error_count, * FROM lineitem)
GROUP BY model, task, sample"""


@query("r2_running_leaderboard", "SELECT model, task, count(*) AS n, CAST(sum(CASE WHEN error_count <= CASE WHEN task = 'data_update' THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS executable FROM (" + _LAST.format(task=_TASK, errors=_ERRORS) + ") GROUP BY model, task")
def r2(spark, d):
    """Samples that are evaluated again and again, arriving in several batches; the last record by ship date counts."""
    dealt = R.scratch(spark, "arriving")
    lines = table(spark, d, "lineitem")
    lines.repartition(24, "l_partkey").write.parquet(dealt)
    rows = R.read_stream(spark, dealt, lines.schema, "parquet", files_per_batch=8).select(
        F.concat(F.lit("m"), F.lpad((F.col("l_suppkey") % 17).cast("string"), 2, "0")).alias("model"),
        F.expr(_TASK).alias("task"),
        (F.col("l_orderkey") % 50).cast("string").alias("sample"),
        F.expr(f"CAST({_ERRORS} AS BIGINT)").alias("error_count"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("evaluated"),
    )
    return R.running_leaderboard(rows, R.scratch(spark, "leaderboard"), R.scratch(spark, "checkpoint"), order="evaluated")
