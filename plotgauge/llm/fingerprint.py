"""Operator 6: document fingerprints, a digest of improbable features in chained Bloom filters."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRETCH, bytes_of, documents, map_texts, sha256_hex, write_table

WINDOW = 64  # bytes of a feature, and features of a neighbourhood in which ranks are compared
POPULAR = 16  # neighbourhoods a feature must win
BITS, HASHES, FEATURES = 2048, 5, 160  # of one Bloom filter
TYPICAL_BITS = 3.7  # entropy of the common run of text; windows far from it are rare
LOWEST_BITS = 1.0  # windows of less entropy say nothing
SHORT, SHORT_TEXT = 8, 320  # texts of fewer bytes, or without a chosen window, get all their windows of SHORT bytes as well
TINY, TINY_TEXT = 3, 32  # and these those of TINY bytes

_SCALE = 1 << 16
_NLOGN = np.rint(np.append(0, np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))) * _SCALE).astype(np.int64)


def window_entropy(b: np.ndarray) -> np.ndarray:
    """Shannon entropy, in bits, of the bytes of each window of 64: sliding by one byte changes the counts of two values."""
    n = len(b)
    order = np.argsort(b, kind="stable")
    key = b[order].astype(np.int64) * (n + WINDOW + 1) + order
    at = np.arange(n)
    ends = np.searchsorted(key, key + WINDOW)
    ahead = np.empty(n, np.int64)  # how often a byte's value stands in the window that it begins
    ahead[order] = ends - at
    behind = np.empty(n, np.int64)  # and in the window that it ends
    behind[order] = at + 1 - np.cumsum(np.bincount(ends, minlength=n + 1)[:n])
    first = int(_NLOGN[np.bincount(b[:WINDOW], minlength=256)].sum())
    out = ahead[: n - WINDOW]
    into = behind[WINDOW:]
    change = _NLOGN[out - 1] - _NLOGN[out] + _NLOGN[into] - _NLOGN[into - 1]
    total = np.append(first, first + np.cumsum(change))
    return np.log2(WINDOW) - total / (_SCALE * WINDOW)


def leftmost_best(rank: np.ndarray) -> np.ndarray:
    """Place of the leftmost highest rank in each neighbourhood, by maxima over 2, 4 ... 64 places."""
    n = len(rank)
    best = (rank.astype(np.int64) << 40) | np.arange(n, 0, -1)
    width = 1
    while width < WINDOW:
        best = np.maximum(best[:-width], best[width:])
        width *= 2
    return n - (best & ((1 << 40) - 1))


def popular_windows(raw: bytes) -> list[int]:
    """Places of the windows that win 16 neighbourhoods or more. A very long text is ranked a stretch at a time, each with the margins that its wins depend on."""
    n, margin, chosen = len(raw) - WINDOW + 1, WINDOW - 1, []
    for low in range(0, n, STRETCH):
        high = min(n, low + STRETCH)
        begin, end = max(0, low - margin), min(n, high + margin)
        entropy = window_entropy(np.frombuffer(raw[begin : end + margin], np.uint8))
        rank = np.where(entropy < LOWEST_BITS, 0, 1 + np.minimum(np.abs(entropy - TYPICAL_BITS) * 64, 254)).astype(np.uint8)
        if n >= WINDOW:
            wins = np.bincount(leftmost_best(rank), minlength=len(rank))
        else:
            wins = np.zeros(len(rank), np.int64)
            wins[rank.argmax()] = POPULAR
        own = slice(low - begin, high - begin)
        chosen += (np.flatnonzero((wins[own] >= POPULAR) & (rank[own] > 0)) + low).tolist()
    return chosen


def features(raw: bytes) -> np.ndarray:
    """64-bit hashes of the chosen features in order, each once.

    A window's rank is how far its entropy lies from the typical one. In each neighbourhood of 64 windows the leftmost of
    the highest rank wins; windows with 16 wins are chosen. A text of under 320 bytes, or without such a
    window, adds all its windows of 8 bytes, and one of under 32 bytes those of 3, so that near copies of short texts share
    features too; what is added never replaces, so two short texts on either side of a limit stay comparable. A text of under 3 bytes is one feature.
    """
    if not raw:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    chosen = dict.fromkeys(digest(raw[i : i + WINDOW]) for i in popular_windows(raw)) if len(raw) >= WINDOW else {}
    if len(raw) < SHORT_TEXT or not chosen:
        for width in (SHORT, TINY) if len(raw) < TINY_TEXT else (SHORT,):
            chosen |= dict.fromkeys(digest(raw[i : i + width]) for i in range(len(raw) - width + 1))
    return np.array(list(chosen) or [digest(raw)], np.uint64)


def chain(feats: np.ndarray) -> np.ndarray:
    """Bloom filters as rows of bits; a new one begins after every 160 features."""
    bits = np.zeros((-(-len(feats) // FEATURES), BITS), np.float32)
    row = np.arange(len(feats)) // FEATURES
    for k in range(HASHES):
        bits[row, (feats >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return bits


def digest_text(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits.astype(bool), axis=1).tobytes()).decode() if len(bits) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain, the best overlap with one of the other beyond what chance gives, weighted by its bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    na, nb = a.sum(axis=1), b.sum(axis=1)
    best = np.empty(len(a))
    for low in range(0, len(a), 256):
        part, size = a[low : low + 256], na[low : low + 256, None]
        chance = size * nb[None] / BITS
        best[low : low + 256] = ((part @ b.T - chance) / (np.minimum(size, nb[None]) - chance)).max(axis=1)
    return float(min(1.0, max(0.0, (np.clip(best, 0, 1) * na).sum() / na.sum())))


class Print:
    """One text with its filters."""

    def __init__(self, raw: bytes):
        self.text = raw.decode("utf-8", "replace")
        self.raw = raw
        self.bits = chain(features(raw))

    def row(self, following: Print) -> tuple:
        """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
        n = len(self.text)
        cut = n // 3
        edited = (self.text[: n - cut] + following.text[:cut]).encode()
        bits = chain(features(edited)) if edited != self.raw else self.bits
        return n, sha256_hex(edited), digest_text(self.bits), digest_text(bits), likeness(self.bits, bits), likeness(self.bits, following.bits)


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_KINDS = [_TYPES[x.split()[1]] for x in _ROW.split(", ")]


def _batch(ids, rows, **more):
    columns = [pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS))]
    return pa.RecordBatch.from_arrays([*columns, *more.values()], names=["id", *_NAMES, *more])


def _in_order(batches):
    """Results of all rows but the last of a partition, whose follower is elsewhere; its first and last text come along, with the partition's number."""
    last_id, last, first = None, None, True
    part = TaskContext.get().partitionId()
    edge_ids, edge_texts, edge_kinds = [], [], []
    for batch in batches:
        ids, rows = [], []
        for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            now = Print(raw.as_py())
            if first:
                edge_ids, edge_texts, edge_kinds, first = [id_], [now.raw], [1], False
            if last is not None:
                ids.append(last_id)
                rows.append(last.row(now))
            last_id, last = id_, now
        if rows:
            yield _batch(ids, rows, kind=pa.array([0] * len(ids), pa.int32()), part=pa.array([part] * len(ids), pa.int32()), text=pa.nulls(len(ids), pa.binary()))
    if last is not None:
        edge_ids.append(last_id)
        edge_texts.append(last.raw)
        edge_kinds.append(2)
        yield _batch(edge_ids, [(None,) * len(_NAMES)] * 2, kind=pa.array(edge_kinds, pa.int32()), part=pa.array([part] * 2, pa.int32()), text=pa.array(edge_texts, pa.binary()))


def _pairs(batches):
    for batch in batches:
        rows = [Print(a.as_py()).row(Print(b.as_py())) for a, b in zip(batch.column(1), batch.column(2))]
        yield _batch(batch.column(0).to_pylist(), rows)


def fingerprint_chain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per input row.

    In descending order of id (null last, equal ids by text), a document's last third of code points is replaced by the first
    as many of the next document's; after the last comes the first. Adds n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. A null text is empty: no filters, "" as fingerprint, alike (1) to an
    empty text and not (0) to others. A lone row follows itself. Other columns are left out, whatever their names.

    Texts are shuffled once, by ranges of ids and of the first 64 bytes of texts; each task streams its range in order. Only the first and the last
    text of each range meet their neighbours in a second, small step, by a join on the ranges' numbers.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), bytes_of(text_col).alias("text"))
    # rows of equal or null id are dealt by how their texts begin; whole texts as keys would be sampled to the driver
    ranges = rows.repartitionByRange(F.col("id").desc_nulls_last(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("id").desc_nulls_last(), "text")
    done = write_table(map_texts(ranges, _in_order, f"id long, {_ROW}, kind int, part int, text binary"), "fingerprints")
    # the number of each range that has rows: one for each task, and nothing of the documents
    parts = sorted(r["part"] for r in done.where("kind = 1").select("part").collect())
    follows = df.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    last = done.where("kind = 2").select("id", "part", "text").join(follows, "part")
    first = done.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    closed = map_texts(last.join(first, "next").select("id", "text", "following"), _pairs, f"id long, {_ROW}")
    return done.where("kind = 0").select("id", *_NAMES).unionByName(closed).withColumnRenamed("id", id_col)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(documents(spark, sf_dir))
