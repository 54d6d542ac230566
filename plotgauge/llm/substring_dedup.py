"""Operator 5: substring dedup by seed and extend on winnowed anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashMemo, bytes_of, documents, map_texts, mix, stretches, write_table

#: Words of a repeat at least, and of a seed. Every repeat holds the same seeds wherever it stands.
MIN_WORDS, SEED_WORDS = 50, 12

#: Rows that a task makes of its documents before it hands them on.
ROWS_AT_ONCE = 100_000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 2**64)


class Spans:
    """Hashes of any stretches of a word sequence, each from one running sum."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, _BASE, np.uint64)
            powers[0] = 1
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * np.cumprod(powers)[:n])])
            inverse = np.full(n + 1, _INVERSE, np.uint64)
            inverse[0] = 1
            self.inverse = np.cumprod(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(spans: Spans, n: int, min_words: int, seed_words: int):
    """(seed hash, context hash, first window, last window) of each winnowed anchor of a text of n words.

    A window of `min_words` words has its lowest seed hash (the leftmost of equals) as anchor, so equal windows have
    equal anchors at equal places. Windows with the same anchor are neighbours; the context is all that they cover.
    """
    m = n - seed_words + 1
    at = np.arange(m)
    seeds = spans.of(at, at + seed_words)
    width = min_words - seed_words + 1
    windows = np.lib.stride_tricks.sliding_window_view(seeds, width)
    chosen = np.arange(len(windows)) + windows.argmin(axis=1)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(windows)) - 1
    anchor = chosen[first]
    with np.errstate(over="ignore"):
        shape = ((anchor - first) * 4096 + (last - first)).astype(np.uint64)
        context = mix(spans.of(first, last + min_words) + mix(shape))
    return seeds[anchor], context, first, last


def _seed_rows(rows: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    def run(batches):
        memo = HashMemo()
        for batch in batches:
            out = []
            for i, raw in enumerate(batch.column(2)):
                words = memo.of_text(raw.as_py())
                if len(words) < min_words:
                    continue
                seed, context, first, last = anchors(Spans(words), len(words), min_words, seed_words)
                out.append((np.full(len(seed), i), seed.view(np.int64), context.view(np.int64), first.astype(np.int32), last.astype(np.int32)))
            memo.trim()
            if out:
                row, seed, context, first, last = (np.concatenate(x) for x in zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(seed), pa.array(context), pa.array(first), pa.array(last)], names=["id", "version", "seed", "context", "first", "last"])

    return map_texts(rows.where("id IS NOT NULL"), run, "id long, version long, seed long, context long, first int, last int")


def _extended(rows: DataFrame, asked: DataFrame, min_words: int) -> DataFrame:
    """(seed, context, id, at, window): the hashes of all windows around the seeds that `asked` names, by reading their texts."""
    lists = asked.groupBy("id", "version").agg(F.collect_list(F.struct("seed", "context", "first", "last")).alias("asked"))
    joined = rows.join(lists, ["id", "version"]).dropDuplicates(["id", "version"]).select("id", "text", "asked.seed", "asked.context", "asked.first", "asked.last")

    def run(batches):
        memo = HashMemo()

        def rows_of(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["id", "seed", "context", "at", "window"])

        for batch in batches:
            out, held = [], 0
            ids = batch.column(0).to_pylist()
            for i, raw in enumerate(batch.column(1)):
                spans = Spans(memo.of_text(raw.as_py()))
                seed, context, first, last = (np.array(batch.column(c)[i].as_py(), np.int64) for c in range(2, 6))
                size = last - first + 1
                which = np.repeat(np.arange(len(size)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = first[which] + at
                out.append((np.full(len(at), ids[i]), seed[which], context[which], at.astype(np.int32), spans.of(start, start + min_words).view(np.int64)))
                held += len(at)
                if held >= ROWS_AT_ONCE:
                    yield rows_of(out)
                    out, held = [], 0
            memo.trim()
            if out:
                yield rows_of(out)

    return map_texts(joined, run, "id long, seed long, context long, at int, window long")


def repeated_spans(rows: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(id, version, start, end): stretches of at least `min_words` words, each of whose windows also starts in a document of smaller id.

    rows: (id, version, text as bytes). Seeds that only one document has are dropped. A seed is extended both ways to all
    windows around it: where everything around it agrees in all documents that have it, the seed's context decides at once,
    else the windows of one text for each context are compared. All comparing is grouping by hash with the
    smallest id, never pairs of documents, so a passage that a third of all documents share costs its rows and no more.
    """
    seeds = write_table(_seed_rows(rows, min_words, seed_words), "seeds")
    # which seeds do several documents have, and do their surroundings differ
    found = seeds.groupBy("seed").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("context").alias("c1"), F.max("context").alias("c2")).where("least < most")
    # written, so that both sides of the join are plain tables and Spark can split a hot seed's rows
    found = write_table(found.select("seed", "least", (F.col("c1") == F.col("c2")).alias("alike")), "found-seeds")
    shared = write_table(seeds.join(found, "seed"), "shared-seeds")
    whole = [shared.where("alike AND id > least").select("id", "version", F.col("first").alias("start"), (F.col("last") + min_words).alias("end"))]

    mixed = shared.where("NOT alike")
    one = mixed.groupBy("seed", "context").agg(F.min(F.struct("id", "version", "first", "last")).alias("one")).select("seed", "context", "one.*")
    one = write_table(one, "contexts")
    least = one.select("seed", "context", F.col("id").alias("own"))
    later = mixed.join(least, ["seed", "context"]).where("id > own")
    whole.append(later.select("id", "version", F.col("first").alias("start"), (F.col("last") + min_words).alias("end")))

    windows = write_table(_extended(rows, one, min_words), "windows")
    earlier = windows.groupBy("seed", "window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("seed", "window", "least")
    earlier = write_table(earlier, "earlier")
    hits = windows.join(earlier, ["seed", "window"]).where("id > least").groupBy("seed", "context", "id").agg(F.collect_set("at").alias("hits"))
    # the first document of a context has it in few places, so this join has no hot key
    parts = mixed.join(write_table(hits, "hits"), ["seed", "context", "id"]).select("id", "version", "first", F.explode("hits").alias("at"))
    whole.append(parts.select("id", "version", (F.col("first") + F.col("at")).alias("start"), (F.col("first") + F.col("at") + min_words).alias("end")))
    return whole[0].unionByName(whole[1]).unionByName(whole[2])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), bytes_of(text_col).alias("text"))


def cut_words(raw: bytes, start: np.ndarray | None, end: np.ndarray | None, with_text: bool) -> tuple[int, int, str]:
    """How many words a text has and loses, and the kept ones joined by one space, or their SHA-256. The text is split a stretch at a time."""
    merged = []  # spans as (start, end) in order, none touching another
    if start is not None:
        order = np.argsort(start)
        start, end = start[order], np.maximum.accumulate(end[order])
        fresh = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        merged = list(zip(start[fresh].tolist(), end[np.append(fresh[1:], len(start)) - 1].tolist()))
    total, left, out, digest, at = 0, 0, [], hashlib.sha256(), 0
    for part in stretches(raw):
        words = part.split()
        low, stay = total, []
        total += len(words)
        while low < total:
            while at < len(merged) and merged[at][1] <= low:
                at += 1
            begin, stop = merged[at] if at < len(merged) else (total, total)
            if begin > low:
                high = min(begin, total)
                stay += words[low - total + len(words) : high - total + len(words)]
                low = high
            else:
                low = min(stop, total)
        if stay:
            said = b" ".join(stay)
            if with_text:
                out.append(said)
            else:
                digest.update(b" " * (left > 0) + said)
            left += len(stay)
    return total, total - left, b" ".join(out).decode("utf-8", "replace") if with_text else digest.hexdigest()


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of repeats that a document of smaller id has too.

    A word goes if one of the windows of `min_words` consecutive words over it also starts in a document of smaller id;
    windows are judged on the input. Overlapping windows merge to maximal repeats. `kept` is the kept words joined by one
    space, or its SHA-256 with ``with_text=False``. A null text is empty. Rows of null id neither lose words nor take any. Rows of the
    same id take none from each other, whether their texts are equal or not. Other columns are left out, whatever
    their names.
    """
    rows = _rows(df, id_col, text_col)
    spans = repeated_spans(rows, min_words, seed_words).groupBy("id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, ["id", "version"], "left").select("id", "text", "spans.start", "spans.end")

    def run(batches):
        for batch in batches:
            rows = []
            for raw, start, end in zip(batch.column(1), batch.column(2), batch.column(3)):
                rows.append(cut_words(raw.as_py(), *(None if x.as_py() is None else np.array(x.as_py(), np.int64) for x in (start, end)), with_text))
            total, gone, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return map_texts(joined, run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), with_text=False).withColumnRenamed("kept", "kept_sha256")


OP5_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {MIN_WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {MIN_WORDS - 2})) AS i FROM w WHERE len(ws) >= {MIN_WORDS})),
early AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
later AS (SELECT DISTINCT win.doc_id, i FROM win JOIN early ON early.h = win.h WHERE least < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range({MIN_WORDS}) t(k)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
