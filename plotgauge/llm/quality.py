"""Operator 2: quality rules with a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRETCH, HashMemo, bytes_of, documents, map_texts, stretches, window_hashes, write_table

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityParams:
    gram: int = 4  # bytes of an n-gram
    bits: int = 16  # n-grams are hashed into 2^bits classes
    least_ratio: float = -0.2  # mean log-likelihood ratio of a kept text, in nats per n-gram
    repeat: int = 5  # words of a window that may not recur
    least_words: int = 10
    most_repeat_percent: int = 20


def hashed_grams(raw: bytes, gram: int, bits: int) -> np.ndarray:
    """Class of each n-gram of bytes, in order."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - gram + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = h * np.uint64(257) + b[k : k + n]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_stretches(raw: bytes, gram: int):
    """A text in stretches that share gram - 1 bytes, so that each n-gram lies in one of them."""
    for low in range(0, max(len(raw), 1), STRETCH):
        yield raw[low : low + STRETCH + gram - 1]


FILTER_BITS = 26


def _places(id_: str) -> list:
    """Where an id stands in the filter, as (word, bit) of 64-bit words."""
    h = F.xxhash64(id_)
    spots = [F.shiftrightunsigned(h, k).bitwiseAND((1 << FILTER_BITS) - 1) for k in (0, FILTER_BITS)]
    return [F.struct(F.shiftright(x, 6).alias("word"), x.bitwiseAND(63).alias("bit")) for x in spots]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids (_id), 2^26 bits whatever their number: 8 MiB come to the driver and to each executor.

    Some 10^7 ids leave it letting through a few per cent of the others; beyond that it only filters less.
    """
    spots = ids.select(F.explode(F.array(*_places("_id"))).alias("_s")).select("_s.word", F.expr("shiftleft(1L, CAST(_s.bit AS INT))").alias("mask"))
    words = spots.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


#: Counts of so many languages are held by a task at a time; they are handed on beyond it.
HELD_LANGUAGES = 32


def _filtered(word1, bit1, word2, bit2, words: np.ndarray) -> np.ndarray:
    """Whether the filter lets ids through, from the places where they stand in it; a null id never."""
    hit = [(words[pc.fill_null(w, 0).to_numpy(zero_copy_only=False)] >> pc.fill_null(b, 0).to_numpy(zero_copy_only=False)) & 1 for w, b in ((word1, bit1), (word2, bit2))]
    return (hit[0] & hit[1]).astype(bool) & pc.is_valid(word1).to_numpy(zero_copy_only=False)


def _with_places(rows: DataFrame, *columns: str) -> DataFrame:
    spots = [F.when(F.col("_id").isNotNull(), s[part]) for s in _places("_id") for part in ("word", "bit")]
    return rows.select(*columns, *[x.alias(f"_p{k}") for k, x in enumerate(spots)])


def let_through(rows: DataFrame, shared, *columns: str) -> DataFrame:
    """The rows (_id and others) whose id the filter lets through."""

    @F.arrow_udf("boolean")
    def maybe(word1: pa.Array, bit1: pa.Array, word2: pa.Array, bit2: pa.Array) -> pa.Array:
        return pa.array(_filtered(word1, bit1, word2, bit2, shared.value))

    return _with_places(rows.where("_id IS NOT NULL"), *columns).where(maybe("_p0", "_p1", "_p2", "_p3")).select(*columns)


def counted_grams(rows: DataFrame, p: QualityParams, shared=None) -> DataFrame:
    """(lang, good, class, n): how often each n-gram class occurs in the rows (_id, lang, text), by language and by what the filter of ids says.

    Whole numbers, so the sums are the same however rows are dealt. Each task adds up its own counts before they are
    shuffled, and holds those of `HELD_LANGUAGES` languages.
    """

    def batch_of(held):
        for (lang, good), total in held.items():
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([good] * len(at), pa.bool_()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "good", "class", "n"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            good = np.zeros(batch.num_rows, bool) if shared is None else _filtered(*batch.columns[2:6], shared.value)
            for lang, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), good.tolist()):
                if (lang, flag) not in held:
                    if len(held) >= 2 * HELD_LANGUAGES:
                        yield from batch_of(held)
                        held.clear()
                    held[lang, flag] = np.zeros(1 << p.bits, np.int64)
                for part in gram_stretches(text.as_py(), p.gram):
                    classes = hashed_grams(part, p.gram, p.bits)
                    if len(classes) << 4 > 1 << p.bits:
                        held[lang, flag] += np.bincount(classes, minlength=1 << p.bits)
                    else:
                        np.add.at(held[lang, flag], classes, 1)
        yield from batch_of(held)

    rows = _with_places(rows, "lang", "text") if shared is not None else rows.select("lang", "text")
    return map_texts(rows, run, "lang string, good boolean, class int, n long").groupBy("lang", "good", "class").agg(F.sum("n").alias("n"))


#: Weighted counts are added up in whole millionths, so that their sums don't depend on the order.
SCALE = 1_000_000


def gram_counts(df: DataFrame, labels: DataFrame, p: QualityParams, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(class, raw, target): n-gram counts of all texts, and of the trusted ones, those labelled quality 1.

    With `lang_col`, a text's raw counts are weighted by the trusted part of its language, so that each language weighs the
    same in both; a null language is one of its own. All counts come from one scan of the texts, which are not shuffled: a filter of
    the trusted ids marks them there. Which other ids it lets through is found on ids alone, and only if there are any are
    those few texts counted once more and taken off again.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    rows = df.select(F.col(id_col).alias("_id"), lang.alias("lang"), bytes_of(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(id_filter(trusted))
    counts = counted_grams(rows, p, shared).select("lang", "class", F.col("n").alias("raw"), F.when(F.col("good"), F.col("n")).otherwise(0).alias("target"))
    wrong = write_table(let_through(rows.select("_id"), shared, "_id").join(trusted, "_id", "left_anti").distinct(), "not-trusted")
    if wrong.limit(1).count():
        off = counted_grams(let_through(rows, shared, "_id", "lang", "text").join(wrong, "_id", "left_semi"), p)
        counts = counts.unionByName(off.select("lang", "class", F.lit(0).cast("long").alias("raw"), (-F.col("n")).alias("target")))
    counts = write_table(counts.groupBy("lang", "class").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "gram-counts")
    weight = F.lit(1.0)
    if lang_col is not None:
        sums = counts.groupBy(F.col("lang").alias("of")).agg((F.sum("target") / F.greatest(F.sum("raw"), F.lit(1))).alias("share"))
        counts, weight = counts.join(write_table(sums, "language-shares"), F.col("lang").eqNullSafe(F.col("of"))), F.col("share")
    raw = F.sum(F.round(F.col("raw") * weight * SCALE).cast("decimal(28,0)"))
    return counts.groupBy("class").agg((raw.cast("double") / SCALE).alias("raw"), F.sum("target").cast("double").alias("target"))


def ratio_weights(counts: DataFrame, p: QualityParams) -> np.ndarray:
    """Log ratio of the trusted to the raw multinomial, both with add-one smoothing; zeros if nothing is trusted. At most 2^bits numbers come to the driver."""
    raw, target = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    found = counts.toArrow()
    at = found.column("class").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not target.sum():
        return np.zeros(1 << p.bits)
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def repeated_words(h: np.ndarray, width: int) -> int:
    """How many words lie in windows of `width` words that the text has twice or more, the first ones included; `h`: hashes of its words in order."""
    windows = window_hashes(h, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    for k in range(width):  # windows with the same hash are the same words
        same &= h[order[1:] + k] == h[order[:-1] + k]
    again = np.append(False, same) | np.append(same, False)
    edge = np.zeros(len(h) + 1, np.int64)
    edge[order[again]] += 1
    edge[order[again] + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_counts(raw: bytes, p: QualityParams, memo: HashMemo) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. What is kept of a long text at once are numbers: a hash for each word and line."""
    words = memo.of_text(raw)
    chars = symbols = 0
    for part in stretches(raw):
        chars += len(part.translate(None, BLANKS).decode("utf-8", "replace"))
        symbols += len(part) - len(part.translate(None, SYMBOLS))
    lines = np.fromiter((xxhash.xxh64_intdigest(x) for x in _lines(raw) if x.strip(BLANKS)), np.uint64)
    return len(words), chars, symbols, len(lines) - len(np.unique(lines)), repeated_words(words, p.repeat)


def _lines(raw: bytes):
    low = 0
    while low <= len(raw):
        high = raw.find(b"\n", low)
        high = len(raw) if high < 0 else high
        yield raw[low:high]
        low = high + 1


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: QualityParams = QualityParams(), lang_col: str | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept), one row per input row.

    `base_failed`: under 10 words, or over 20 % of the words in repeated windows. `ratio` is the mean over a text's n-grams of the log
    ratio between what trusted texts and what all texts hold; every text is held against the same fixed threshold. Texts
    with no n-gram have ratio 0. A null text has no words and fails. Labels (doc_id, quality) may have nulls, repeats and unknown
    ids; if none is trusted, ratios are 0 and the base rules alone decide. With `lang_col`, texts are held against what all texts
    would hold if each language had its share among the trusted ones: how few texts of a language are labelled then makes
    none of them worse, and n-grams that only languages without a trusted text hold count as 0. Other columns are left out, whatever their names.
    """
    weights = ratio_weights(gram_counts(df, labels, p, id_col, text_col, lang_col), p)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        w, memo = shared.value, HashMemo()
        for batch in batches:
            base, ratios = [], []
            for text in batch.column(1):
                raw = text.as_py()
                base.append(base_counts(raw, p, memo))
                memo.trim()
                total = sum(float(w[hashed_grams(part, p.gram, p.bits)].sum()) for part in gram_stretches(raw, p.gram))
                ratios.append(round(total / max(1, len(raw) - p.gram + 1), 6))
            columns = [pa.array(x, pa.int64()) for x in zip(*base)] if base else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(ratios, pa.float64())], names=["id", *names, "ratio"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = map_texts(df.select(F.col(id_col).alias("id"), bytes_of(text_col).alias("text")), run, f"id {kind}, {', '.join(f'{x} long' for x in names)}, ratio double")
    failed = (F.col("n_words") < p.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.most_repeat_percent)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= p.least_ratio)).withColumnRenamed("id", id_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), lang_col="lang")
