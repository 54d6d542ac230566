"""Operator 8 against a plain TF-IDF and follow-the-regularised-leader in dictionaries, many labels, repeated rows, and the registered query."""

import collections
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plotgauge.llm import language_id

SMALL = language_id.LanguageParams(bits=10, sample_rows=60, epochs=2)


def plain_features(text, p):
    """Counts of hashed character n-grams, one gram at a time."""
    found = collections.Counter()
    for order in range(1, p.orders + 1):
        for i in range(len(text) - order + 1):
            h = 0
            for k, c in enumerate(text.lower()[i : i + order]):
                h = (h * 0x100000001B3 + ord(c) + k + 1) % 2**64
            found[(h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - p.bits)] += 1
    return found


def plain_model(rows, texts, labels, p):
    """Weights, biases and temperature; rows: (label, text) in order, texts: all labelled ones."""
    df = collections.Counter(f for t in texts for f in plain_features(t, p))

    def values(text):
        x = {f: math.log1p(c) * (math.log((1 + len(texts)) / (1 + df[f])) + 1) for f, c in plain_features(text, p).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / norm for f, v in x.items()}

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key, l1):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((p.beta + math.sqrt(n[key])) / p.alpha + p.l2)

    def scores(x):
        return [sum(v * weight((f, k), p.l1) for f, v in x.items()) + weight(("bias", k), 0.0) for k in range(len(labels))]

    for _ in range(p.epochs):
        for i, (label, text) in enumerate(rows):
            if i % p.calibration == 0:
                continue
            x = values(text)
            s = scores(x)
            e = [math.exp(v - max(s)) for v in s]
            for k in range(len(labels)):
                g = e[k] / sum(e) - (labels[k] == label)
                for f, v, l1 in [(f, v, p.l1) for f, v in x.items()] + [("bias", 1.0, 0.0)]:
                    w = weight((f, k), l1)
                    z[f, k] += g * v - (math.sqrt(n[f, k] + (g * v) ** 2) - math.sqrt(n[f, k])) / p.alpha * w
                    n[f, k] += (g * v) ** 2
    held = [(labels.index(label), scores(values(text))) for i, (label, text) in enumerate(rows) if i % p.calibration == 0]
    loss = lambda t: sum(math.log(sum(math.exp((v - max(s)) / t) for v in s)) - (s[y] - max(s)) / t for y, s in held)
    best = min((math.exp(k / 50) for k in range(-200, 101)), key=loss)
    return scores, values, best, loss


def made_docs(n=160):
    rng = random.Random(4)
    sounds = {"en": "the ing tion sh w th".split(), "ру": "ый ться ст ого в".split(), "日": "の です ます 日本 ない".split()}
    labels = list(sounds)
    return [(i, " ".join("".join(rng.choice(sounds[labels[i % 3]]) for _ in range(3)) for _ in range(rng.randrange(2, 9))), labels[i % 3]) for i in range(n)]


def test_features():
    for text in ("", "a", "ab", "Ünïcode 日本語 😀", "aaaa aaaa"):
        at, counts = language_id.gram_features(text, SMALL)
        assert dict(zip(at.tolist(), counts.tolist())) == plain_features(text, SMALL)


def test_against_plain_training(spark):
    rows = made_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = language_id.train(df, p=SMALL)
    labelled = df.where(~language_id.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    labels, sample = language_id.draw_sample(labelled, SMALL)
    drawn = sorted((r["_draw"], r["_lang"], r["_text"]) for r in sample.collect())
    assert labels == model.labels == sorted(labels) and collections.Counter(x for _, x, _ in drawn) == {x: 20 for x in labels}
    scores, values, best, loss = plain_model([(x, t) for _, x, t in drawn], [r["_text"] for r in labelled.collect()], labels, SMALL)
    for _, text, lang in rows:
        at, counts = language_id.gram_features(text, SMALL)
        assert dict(zip(at.tolist(), np.round(model.values(at, counts), 9).tolist())) == {f: round(v, 9) for f, v in sorted(values(text).items())}
        assert np.allclose(model.logits(at, counts), scores(values(text)), atol=1e-3)
        assert model.predict(text)[0] == lang
    assert loss(model.temperature) <= loss(best) + 1e-3


def test_many_labels(spark):
    """Every one of 600 labels is learned and found again."""
    rng = random.Random(1)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(2)] for _ in range(600)]
    rows = [(k * 40 + i, " ".join(rng.choice(words[k]) for _ in range(4)), f"l{k}") for k in range(600) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, p=language_id.LanguageParams(epochs=2))
    assert model.labels == sorted(f"l{k}" for k in range(600))
    right = language_id.predict(df, model).select((F.col("lang_pred") == F.col("row.lang")).alias("ok")).where("ok").count()
    assert right > 0.95 * len(rows)


def test_repeated_rows_and_null_ids(spark):
    """One row 20,000 times, many rows without an id, rare labels: the sample stays bounded and no label goes without rows."""
    rare = [(k, f"текст номер {k}", "ru") for k in range(10)] + [(None, f"numero {k} del texto", "es") for k in range(3000)]
    df = spark.range(20_000).select(F.lit(77).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    rows = df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    labels, sample = language_id.draw_sample(rows, language_id.LanguageParams())
    assert labels == ["en", "es", "ru"]
    assert collections.Counter(r["_lang"] for r in sample.collect()) == {"en": 1, "es": 666, "ru": 10}
    mixed = df.unionByName(spark.createDataFrame([(k, f"one more text {k}", "en") for k in range(100, 130)], "doc_id long, text string, lang string"))
    model = language_id.train(mixed)
    assert [model.predict(t)[0] for t in ("one more text 7", "numero 7 del texto", "текст номер")] == ["en", "es", "ru"]


def test_letters():
    """Unicode's letter categories and nothing else."""
    import unicodedata

    for text, ok in (("½", False), ("²", False), ("Ⅷ", False), ("123 _ -", False), ("① ٣", False), ("", False), ("ª", True), ("日", True), ("ʰ", True), ("1 x", True)):
        assert language_id.has_letter(text) == ok
    assert all(language_id.has_letter(chr(c)) == unicodedata.category(chr(c)).startswith("L") for c in range(0x3000))
    model = language_id.Model(["en"], np.ones(1 << 15), language_id.LanguageParams())
    assert model.predict("½ ² Ⅷ 123 _") == ("und", 0.0)


def test_too_many_labels(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="labels"):
        language_id.train(df, p=language_id.LanguageParams(most_labels=20))


def test_clashing_columns(spark):
    names = ["row", "_row", "lang_pred", "score", "_found", "_score", "_lang_pred", "_text", "_id", "_lang"]
    df = spark.createDataFrame([(1, "the thing", "en", *names)], ["doc_id", "text", "lang", *names])
    out = language_id.predict(df, language_id.train(df)).select("row.*")
    assert out.columns == df.columns and out.collect() == df.collect()


def test_query(spark, sf_dir):
    """Held-out accuracy on the given table; labels, sources and ids aren't inputs of a prediction."""
    got = {r["doc_id"]: r for r in language_id.op8_language_id(spark, sf_dir).collect()}
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    judged = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"] and got[d["doc_id"]]["lang_pred"] != "und"]
    assert judged and sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in judged) >= 0.97 * len(judged)
    for d in docs:
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (got[d["doc_id"]]["lang_pred"], got[d["doc_id"]]["score"]) == ("und", 0.0)
