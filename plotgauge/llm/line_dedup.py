"""Operator 10: line dedup over overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, write_table

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, window: int) -> Column:
    """Two 64-bit hashes of each window of consecutive lines, in order, so that different ones don't meet even among 10^12. Nothing is looked up by place, so the work is linear in the lines."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    run = F.transform(hashed, lambda h: F.array(h))
    for k in range(1, window):
        run = F.zip_with(run, F.slice(hashed, k + 1, F.greatest(F.size(hashed) - k, F.lit(0))), lambda w, h: F.concat(w, F.array(h)))
    run = F.slice(run, 1, F.size(lines) - (window - 1))
    each = lambda w, part: [w[k][part] for k in range(window)]
    return F.transform(run, lambda w: F.struct(F.xxhash64(*each(w, "a")).alias("a"), F.xxhash64(*each(w, "b")).alias("b")))


def repeated_windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(_id, _version, _at): windows of `window` consecutive lines whose lines also stand earlier, by (id, place)."""
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"), _lines(F.col(text_col)).alias("_l")).where(F.size("_l") >= window)
    windows = rows.select("_id", "_version", F.posexplode(_windows(F.col("_l"), window)).alias("_at", "_h")).select("_id", "_version", "_at", "_h.a", "_h.b")
    # counting combines on the map side, so a window that a third of all documents share stays small
    first = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_at")).alias("_first")).where("_n > 1").select("a", "b", "_first")
    # written, so that both sides of the join are plain tables and Spark can split a hot window's rows, or send a small side around
    first = write_table(first, "first-windows")
    return windows.join(first, ["a", "b"]).where(F.struct("_id", "_at") != F.col("_first")).select("_id", "_version", "_at")


def _without(lines: Column, starts: Column, n: Column, window: int) -> tuple[Column, Column]:
    """The lines that no window from `starts` covers, and how many are covered. Linear but for one sort: lines meet their marks side by side, none is looked up by place."""
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (window - 1)))))
    left = F.array_except(F.sequence(F.lit(0), n - 1), covered)
    mark = lambda places, gone: F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(gone).alias("gone")))
    marks = F.array_sort(F.concat(mark(left, False), mark(covered, True)))
    return F.array_join(F.zip_with(lines, marks, lambda x, m: F.when(~m["gone"], x)), "\n"), F.size(covered)  # nulls are left out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, n_lines, n_removed, kept_text), one row per input row; `row` holds all columns of `df`, so their names can't clash.

    Lines are what `\\n` separates, unchanged. A line goes if a window of three consecutive lines covers it that also
    stands earlier: in a row of smaller id, or higher up in its own text. Rows of null id come before all others.
    Windows are judged on the input. Texts of fewer than three lines have no window and stay whole. Rows with the same
    id and text are one document, of which neither comes later; rows with the same id and other texts are judged
    each by its own lines, ties in place being no repeat. A null text has 0 lines and stays null.
    """
    marked = repeated_windows(df, id_col, text_col, window).groupBy("_id", "_version").agg(F.collect_set("_at").alias("_starts"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"))
    marked = marked.withColumnsRenamed({"_id": "_mid", "_version": "_mversion"})
    both = rows.join(marked, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_version") == F.col("_mversion")), "left")
    text = F.col("row")[text_col]  # shuffled once, inside its row
    lines = _lines(text)
    n = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))
    kept, gone = _without(lines, F.col("_starts"), n, window)
    whole = F.col("_starts").isNull()
    return both.select("row", n.cast("long").alias("n_lines"), F.when(whole, 0).otherwise(gone).cast("long").alias("n_removed"), F.when(whole, text).otherwise(kept).alias("kept_text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def dedup_sql(table: str) -> str:
    """DuckDB CTEs: line_kept(doc_id, n_lines, n_removed, kept) of a table with doc_id and text."""
    return rf"""
line_rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {table}),
line_at AS (SELECT doc_id, text, unnest(l) AS line, unnest(range(len(l))) AS pos FROM line_rows),
line_win AS (
  SELECT doc_id, pos, l[pos + 1] AS l1, l[pos + 2] AS l2, l[pos + 3] AS l3
  FROM (SELECT doc_id, l, unnest(range(greatest(len(l) - 2, 0))) AS pos FROM line_rows)),
line_later AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, rank() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS r FROM line_win) WHERE r > 1),
line_gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM line_later, (VALUES (0), (1), (2)) t(k)),
line_kept AS (
  SELECT d.doc_id, len(d.l) AS n_lines, coalesce(g.n, 0) AS n_removed,
         CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.kept, '') END AS kept
  FROM line_rows d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM line_gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
  LEFT JOIN (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.pos) AS kept FROM line_at x
             ANTI JOIN line_gone y ON x.doc_id = y.doc_id AND x.pos = y.pos GROUP BY x.doc_id) k ON k.doc_id = d.doc_id)"""


OP10_SQL = f"WITH {dedup_sql('documents')} SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM line_kept"
