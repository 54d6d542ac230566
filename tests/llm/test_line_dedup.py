"""Operator 10: the registered query against its SQL, and texts of very many lines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plotgauge.llm import line_dedup
from test_llm import lines_expected


@pytest.mark.parametrize("window", [2, 3, 5])
def test_windows_of_any_size(spark, window):
    rows = [(1, "a\nb\nc\nd\ne\nf"), (2, "x\nb\nc\nd\ne\nf\ny"), (3, "a\nb"), (4, "b\nc\nz")]
    got = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()}
    assert got == {1: rows[0][1], 2: "x\ny", 3: "" if window == 2 else "a\nb", 4: "z" if window == 2 else "b\nc\nz"}


def test_very_many_lines(spark):
    """Two documents of 300,000 lines that share a few windows; a quadratic step would take hours."""
    n = 300_000
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i % 60_000 < 4), F.concat(F.lit("shared "), i.cast("string"))).otherwise(F.concat_ws(" ", F.lit("own"), F.col("id").cast("string"), i.cast("string")))), "\n").alias("text"))
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    texts = [r["text"] for r in rows.orderBy("doc_id").collect()]
    for i, (lines, gone, kept) in lines_expected(texts).items():
        assert (got[i]["n_lines"], got[i]["n_removed"]) == (lines, gone)
        assert hashlib.md5(got[i]["kept_text"].encode()).digest() == hashlib.md5(kept.encode()).digest()
    assert got[1]["n_removed"] == 20
