"""Operator 8: language ID by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import STRETCH, documents, give_back, map_texts, short_batches, write_table

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    orders: int = 4  # n-grams of 1 to so many characters of the lower-cased text
    bits: int = 15  # n-grams are hashed into 2^bits features
    sample_rows: int = 2000  # the classifier is fitted on so many labelled rows at most, as many of each label,
    least_rows: int = 5  # or on so many of each label, where that is more
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    calibration: int = 5  # each 5th sampled row calibrates instead of training
    least_score: float = 0.3  # the pipeline rejects below it
    most_labels: int = 1000  # training needs some 20 bytes on the driver for each feature and label, and refuses more labels


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode's letter categories; numerals such as ½ or Ⅷ aren't letters."""
    return any(map(str.isalpha, text))


def gram_features(text: str, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, n-grams of its code points, and how often each occurs."""
    lower, counts = text.lower(), 0
    with np.errstate(over="ignore"):
        for low in range(0, len(lower), STRETCH):  # stretches share what the longest n-gram needs
            c = np.frombuffer(lower[low : low + STRETCH + p.orders - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h, found = np.zeros(len(c), np.uint64), []
            for order in range(1, min(p.orders, len(c)) + 1):
                n = len(c) - order + 1
                h = h[:n] * np.uint64(0x100000001B3) + c[order - 1 :] + np.uint64(order)
                found.append(h[: min(STRETCH, n)])
            keys = (np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - p.bits)
            counts = counts + np.bincount(keys.view(np.int64), minlength=1 << p.bits)
    at = np.flatnonzero(counts)
    return at, counts[at] if len(at) else np.empty(0, np.int64)


class Model:
    """Weights by feature and label (only those that aren't zero), biases, inverse document frequencies and temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, p: LanguageParams):
        self.labels, self.idf, self.p = labels, idf, p
        self.keep(np.zeros((len(idf), 0), np.float32))
        self.bias = np.zeros(len(labels))
        self.temperature = 1.0

    def keep(self, weights: np.ndarray) -> None:
        """Store weights (features x labels) by row: where each feature's entries begin, their labels and values."""
        at, self.label_of = np.nonzero(weights)
        self.value_of = weights[at, self.label_of]
        self.begin = np.searchsorted(at, np.arange(len(self.idf) + 1))

    def values(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        begin, size = self.begin[at], self.begin[at + 1] - self.begin[at]
        place = np.arange(size.sum()) + np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size)
        x = np.repeat(self.values(at, counts), size)
        return np.bincount(self.label_of[place], weights=x * self.value_of[place], minlength=len(self.labels)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(*gram_features(text, self.p)) / self.temperature
        q = np.exp(z - z.max())
        best = int(z.argmax())
        return self.labels[best], float(q[best] / q.sum())

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Follow the regularised leader, row by row, with l1 and l2 penalties; then one temperature for held-back rows."""
        p, k = self.p, len(self.labels)
        has = np.zeros(len(self.idf), bool)
        for _, at, _ in rows:
            has[at] = True
        used = np.flatnonzero(has)  # features that the sample has
        rows = [(y, np.searchsorted(used, at).astype(np.int32), self.values(at, counts).astype(np.float32)) for y, at, counts in rows]
        z, n = np.zeros((len(used), k), np.float32), np.zeros((len(used), k), np.float32)
        zb, nb = np.zeros(k), np.zeros(k)
        own, rest = [r for i, r in enumerate(rows) if i % p.calibration], rows[:: p.calibration]

        def weights(z_, n_, l1, l2):
            return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((p.beta + np.sqrt(n_)) / p.alpha + l2))

        for _ in range(p.epochs):
            for y, at, x in own or rows:
                za, na = z[at], n[at]
                w, b = weights(za, na, p.l1, p.l2), weights(zb, nb, 0.0, p.l2)
                s = x @ w + b
                g = np.exp(s - s.max())
                g /= g.sum()
                g[y] -= 1
                gx = x[:, None] * g[None]
                z[at] = za + gx - (np.sqrt(na + gx * gx) - np.sqrt(na)) / p.alpha * w
                n[at] = na + gx * gx
                zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * b, nb + g * g
        w, self.bias = weights(z, n, p.l1, p.l2), weights(zb, nb, 0.0, p.l2)
        all_weights = np.zeros((len(self.idf), k), np.float32)
        all_weights[used] = w
        self.keep(all_weights)
        if not rest:
            return
        scores = np.array([x @ w[at] for _, at, x in rest]) + self.bias
        truth = np.array([y for y, _, _ in rest])

        def loss(log_t: float) -> float:
            s = scores / np.exp(log_t)
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        low, high, golden = -4.0, 2.0, (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def draw_sample(rows: DataFrame, p: LanguageParams) -> tuple[list[str], DataFrame]:
    """The labels, and a sample (_draw, _lang, _text) of rows (_id, _text, _lang): of each label the rows of lowest hash of id and text, rows that are equal in both counting once.

    No label is left out; more than `most_labels` of them raise. Labels meet the rows as a table that Spark broadcasts while it is small; the sample holds at most
    `sample_rows` rows, or `least_rows` of each label if that is more.
    """
    drawn = rows.withColumn("_draw", F.xxhash64("_id", "_text"))
    sizes = write_table(drawn.groupBy("_lang").agg(F.approx_count_distinct("_draw").alias("_rows")), "label-sizes")
    if sizes.count() > p.most_labels:
        raise ValueError(f"over {p.most_labels} different labels; clean them, or set most_labels and give the driver the memory that they need")
    labels = sorted(r["_lang"] for r in sizes.select("_lang").collect())
    each = max(p.least_rows, p.sample_rows // max(1, len(labels)))
    # a label's lowest hashes lie below a bound that leaves some three times as many rows as are wanted
    share = F.least(F.lit(1.0), F.lit(3.0 * each + 30) / F.greatest("_rows", F.lit(1)))
    bits = F.shiftrightunsigned("_draw", 24).cast("double")
    few = drawn.join(sizes, "_lang").where(bits < share * float(1 << 40)).groupBy("_lang", "_draw").agg(F.max("_text").alias("_text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw"))
    return labels, few.withColumn("_n", place).where(F.col("_n") <= each).select("_draw", "_lang", "_text")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", p: LanguageParams = LanguageParams()) -> Model:
    """Fit a model on the labelled rows that aren't held out.

    Document frequencies are counted over all of these rows, each task adding up its own before at most 2^bits rows of it are
    shuffled. The regression is fitted on the driver, on the bounded sample of ``draw_sample``; its memory is the features
    that the sample has times the labels. Without labelled rows the model has no labels and predicts `und`.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col(id_col)))
    labels, sample = draw_sample(rows, p)
    if not labels:
        return Model([], np.ones(1 << p.bits), p)

    def frequencies(batches):
        total, docs = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                at, _ = gram_features(text.as_py(), p)
                total[at] += 1
                docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["feature", "docs"])

    counted = map_texts(rows.select("_text"), frequencies, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    feature, docs = (counted.column(c).to_numpy() for c in ("feature", "docs"))
    df_counts = np.zeros(1 << p.bits)
    df_counts[feature[feature >= 0]] = docs[feature >= 0]
    model = Model(labels, np.log((1 + docs[feature < 0].sum()) / (1 + df_counts)) + 1, p)

    def features(batches):
        for batch in batches:
            found = [gram_features(t.as_py(), p) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["draw", "lang", "at", "counts"])

    fitted = map_texts(sample, features, "draw long, lang string, at binary, counts binary").collect()
    fitted.sort(key=lambda r: (r["draw"], r["lang"]))
    place = {x: k for k, x in enumerate(labels)}
    model.fit([(place[r["lang"]], np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in fitted])
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score), one row per input row; `row` holds all columns of `df`, so their names can't clash.

    A null text, or one without a letter, is `und` with score 0. Only the text goes to Python.
    """
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in parts:
            said = [m.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["lang_pred", "score"])
        give_back()

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), found(F.col(text_col)).alias("_found"))
    return rows.select("row", "_found.lang_pred", "_found.score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = predict(docs.select("doc_id", "text"), train(docs))
    return done.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
