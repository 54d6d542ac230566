"""Operator 11: runs of periodically repeated words, found with a dictionary of basic factors."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, HashMemo, bytes_of, documents, map_texts, mix, portions, stretches

LEAST_WORDS = 12
#: Bytes of text whose words are named together: a number of texts, or one longer text.
PORTION = 1 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Level:
    """The factors of one power-of-two length that occur at least twice: a name at each of their places, 0 at all others."""

    def __init__(self, places: np.ndarray, keys: np.ndarray, size: int):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        often = (np.append(same, False) | np.append(False, same))[: len(keys)]
        # places of a factor stand together, in order
        self.places = places[order[often]]
        firsts = np.append(True, keys[often][1:] != keys[often][:-1])[: len(self.places)]
        self.names = np.zeros(size, np.int32)
        self.names[self.places] = np.cumsum(firsts)
        self.follows = ~firsts

    def double(self, length: int) -> Level:
        """Factors twice as long, each named by the names of its halves."""
        left, right = self.names[:-length], self.names[length:]
        places = np.flatnonzero((left > 0) & (right > 0))
        return Level(places, left[places].astype(np.int64) << 32 | right[places], len(self.names))


def basic_factors(words: np.ndarray) -> list[Level]:
    """Level k names the factors of 2^k words; the last level is the longest length of which any factor occurs twice."""
    levels = [Level(np.arange(len(words)), words, len(words))]
    while len(levels[-1].places) and len(words) > 1 << len(levels):
        levels.append(levels[-1].double(1 << (len(levels) - 1)))
    return levels


def proposals(level: Level, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): where a factor and a later occurrence of it less than `longest` apart may lie one period apart.

    Occurrences that overlap at equal distances form one progression. Besides each occurrence's successor it is the first one
    after its own progression, and the last one before its successor's, that can be a period away: a period that is a
    multiple of the progression's distance wouldn't be the smallest one.
    """
    at, n = level.places, len(level.places)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = np.where(level.follows[1:], np.diff(at), 0)
    gap = np.where(gap < longest, gap, 0)
    steady = gap[1:] == gap[:-1]
    places = np.arange(n - 1)
    # the last gap of each stretch of equal gaps, and the first one
    last = np.minimum.accumulate(np.where(np.append(~steady, True), places, n)[::-1])[::-1]
    first = np.maximum.accumulate(np.where(np.append(True, ~steady), places, -1))
    found = [(at[:-1][gap > 0], gap[gap > 0])]
    beyond = last + 1
    ok = (gap > 0) & (beyond < n - 1)
    ok[ok] = gap[beyond[ok]] > 0
    found.append((at[:-1][ok], at[beyond[ok] + 1] - at[:-1][ok]))
    ok = (gap > 0) & (first > 0)
    ok[ok] = gap[first[ok] - 1] > 0
    before = at[first[ok] - 1]
    found.append((before, at[1:][ok] - before))
    place, distance = (np.concatenate(x) for x in zip(*found))
    near = distance < longest
    return place[near], distance[near]


def _first_of_stretches(place: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in a row that propose the same period only the first: they lie in one run."""
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    keep = np.append(True, (np.diff(place) > 1) | (np.diff(distance) > 0))[: len(place)]
    return place[keep], distance[keep]


def _extend(levels: list[Level], place: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around `place` whose words equal those `distance` later: (first, end). One step a level: no common stretch is longer than what a last level's factor and the shorter ones make."""
    end, first = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, length = levels[k].names, 1 << k
        ok = end + distance + length <= len(names)
        ok[ok] = (names[end[ok]] > 0) & (names[end[ok]] == names[(end + distance)[ok]])
        end[ok] += length
        ok = first >= length
        ok[ok] = (names[first[ok] - length] > 0) & (names[first[ok] - length] == names[(first + distance)[ok] - length])
        first[ok] -= length
    return first, end


def periodic_runs(words: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in an array of words, by start and period.

    A run is a stretch that repeats its first `period` words at least twice over and has `least` words or more, that can't be
    made longer, and of which no smaller period holds. A period of 2^k to 2^(k+1) - 1 words is proposed by the
    factors of 2^k words; `least` lets the first level looked at serve all shorter periods too.
    """
    levels = basic_factors(words)
    lowest = max(0, (least // 3).bit_length() - 1)
    found = [np.empty((0, 3), np.int64)]
    for k in range(lowest, len(levels)):
        place, distance = proposals(levels[k], 2 << k)
        ok = distance >= (1 << k if k > lowest else 1)
        place, distance = _first_of_stretches(place[ok], distance[ok])
        first, end = _extend(levels, place, distance)
        length = end - first + distance
        ok = length >= np.maximum(least, 2 * distance)
        found.append(np.stack([first[ok], length[ok], distance[ok]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch may be proposed with a multiple of its period, too; the smallest comes first
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    again = np.append(False, (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1]))[: len(runs)]
    runs = runs[~again]
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    return runs[order, 0], runs[order, 1], runs[order, 2]


def _collapse(raw: bytes, n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    keep = np.cumsum(marks[:n]) == 0
    parts, at = [], 0
    for stretch in stretches(raw):
        words = stretch.split()
        held = keep[at : at + len(words)]
        at += len(words)
        parts.append(b" ".join(words if held.all() else [words[i] for i in np.flatnonzero(held)]))
    return b" ".join(filter(None, parts))


@functools.cache
def _worker_memo() -> HashMemo:
    return HashMemo()


def find_runs(df: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find all periodic runs of every whole text: (id, n_words, runs, collapsed), one row per input row.

    `runs` is an array of (start, length, period), counted in words, by start and period; `collapsed` is the text with each run cut
    down to its first period, words joined by one space. A null or empty text, or one of white space, has no words, no
    runs and an empty `collapsed`. Ids may be null or repeat; other columns are left out, whatever their names.

    Words are compared by 64-bit hashes within their text. Texts are worked on in portions of about `PORTION` bytes; a longer
    text takes some 50 bytes of memory a word, and 4 more for each doubling of its longest repeated passage.
    """

    def run(batches):
        memo = _worker_memo()
        for batch in portions(batches, PORTION):
            texts = [raw.as_py() for raw in batch.column(1)]
            hashed = [memo.of_text(raw) for raw in texts]
            memo.trim()
            sizes = np.array([len(h) for h in hashed], np.int64)
            ends = np.cumsum(sizes)
            # words of different texts get different names, so that no factor counts as repeated outside its text
            owner = np.repeat(mix(np.arange(1, len(texts) + 1, dtype=np.uint64)), sizes)
            start, length, period = periodic_runs(mix(np.concatenate(hashed) ^ owner), least)
            of = np.searchsorted(ends, start, side="right")
            start = start - (ends - sizes)[of]
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            collapsed = [_collapse(raw, n, start[a:b], length[a:b], period[a:b]) for raw, n, a, b in zip(texts, sizes, cuts[:-1], cuts[1:])]
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "runs", "collapsed"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), bytes_of(text_col).alias("text"))
    return map_texts(rows, run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one id in ten, by its CRC-32, the text's words go on repeating themselves from some word on. A null id or text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.expr("CAST((n - a) DIV p + 1 AS INT)")))
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), F.lit(1), F.col("n").cast("int"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def _lines_of(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(plant_repeats(documents(spark, sf_dir).select("doc_id", "text")))
    # greatest length first, then smallest start, then smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("top"))
    length, period = F.col("top.length"), -F.col("top.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * top.length) DIV (-top.p)").alias("exponent_milli"),
        F.sha2(_lines_of(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
