"""The registered queries on the smallest tables: against their SQL, against the libraries, or against plain versions written out here."""

import base64
import collections
import hashlib
import math
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from plotgauge.llm import fingerprint, quality
from plotgauge.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def given(sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        path = f"{sf_dir}/{t}.parquet"
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_op4_and_op7(spark, sf_dir, given):
    coded, counted = by_id(QUERIES["op4_piece_codec"](spark, sf_dir)), by_id(QUERIES["op7_token_count"](spark, sf_dir))
    assert coded.keys() == counted.keys() == given.keys()
    for i, text in given.items():
        ids = SP.encode(text)
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))
        assert (counted[i]["n_bytes"], counted[i]["n_tokens"], counted[i]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 4096)


def test_op2(spark, sf_dir, given):
    """Base columns by counting, the ratio by an n-gram hash that is written out."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    trusted = {r["doc_id"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist() if r["quality"] == 1}

    def classes(text):
        raw = text.encode()
        for i in range(len(raw) - 3):
            h = 0
            for c in raw[i : i + 4]:
                h = h * 257 + c
            yield (h * 0x9E3779B97F4A7C15 % 2**64) >> 48

    grams = {i: collections.Counter(classes(t)) for i, t in given.items()}
    raw_of, good_of = collections.Counter(), collections.Counter()
    for d in docs:
        raw_of[d["lang"]] += grams[d["doc_id"]].total()
        good_of[d["lang"]] += grams[d["doc_id"]].total() * (d["doc_id"] in trusted)
    raw, target = np.zeros(2**16), np.zeros(2**16)
    for d in docs:
        for c, n in grams[d["doc_id"]].items():
            raw[c] += n * good_of[d["lang"]] / max(1, raw_of[d["lang"]])
            target[c] += n * (d["doc_id"] in trusted)
    weight = np.log((target + 1) / (target.sum() + 2**16)) - np.log((raw + 1) / (raw.sum() + 2**16))
    got = by_id(QUERIES["op2_quality"](spark, sf_dir))
    for i, text in given.items():
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count, seen, dup = collections.Counter(windows), set(), 0
        covered = {k + j for k, g in enumerate(windows) if count[g] > 1 for j in range(5)}
        for line in text.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)
        ratio = sum(weight[c] * n for c, n in grams[i].items()) / max(1, grams[i].total())
        assert abs(r["ratio"] - ratio) < 2e-6 and r["kept"] == (not failed and r["ratio"] >= quality.QualityParams().least_ratio)


def plain_features(raw):
    """Chosen byte windows by counting each window's bytes anew, in order, each once."""
    found = []
    n = len(raw) - 63
    rank = []
    for i in range(n):
        entropy = 6 - sum(c * math.log2(c) for c in collections.Counter(raw[i : i + 64]).values()) / 64
        rank.append(0 if entropy < 1 - 1e-9 else 1 + int(min(abs(entropy - 3.7) * 64 + 1e-9, 254)))
    wins = [0] * max(0, n)
    if n >= 64:
        for i in range(n - 63):
            part = rank[i : i + 64]
            wins[i + part.index(max(part))] += 1
    elif n > 0:
        wins[rank.index(max(rank))] = 16
    found = list(dict.fromkeys(raw[i : i + 64] for i in range(max(0, n)) if wins[i] >= 16 and rank[i] > 0))
    if len(raw) < 320 or not found:
        for width in (8, 3) if len(raw) < 32 else (8,):
            found += [raw[i : i + width] for i in range(len(raw) - width + 1)]
    return list(dict.fromkeys(found)) or ([raw] if raw else [])


def plain_chain(raw):
    """Sets of bits, a new one for every 160 features."""
    hashes = [xxhash.xxh64_intdigest(f) for f in plain_features(raw)]
    return [{h >> (11 * k) & 2047 for h in hashes[low : low + 160] for k in range(5)} for low in range(0, len(hashes), 160)]


def plain_print(chain):
    return base64.b64encode(b"".join(sum(1 << (2047 - b) for b in bits).to_bytes(256, "big") for bits in chain)).decode()


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a

    def overlap(x, y):
        chance = len(x) * len(y) / 2048
        return (len(x & y) - chance) / (min(len(x), len(y)) - chance)

    return min(1.0, max(0.0, sum(len(x) * min(1.0, max(0.0, max(overlap(x, y) for y in b))) for x in a) / sum(map(len, a))))


def test_op6(spark, sf_dir, given):
    """Every document whose text and next text have up to 1,500 characters, whose window entropies a plain version can count anew."""
    got = by_id(QUERIES["op6_fingerprint"](spark, sf_dir))
    order = sorted(given, reverse=True)
    held = 0
    for place, i in enumerate(order):
        text, following = given[i], given[order[(place + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), sha(edited))
        if max(len(text), len(following)) > 1500:
            continue
        own, changed, after = (plain_chain(t.encode()) for t in (text, edited, following))
        assert got[i]["fingerprint"] == plain_print(own) and got[i]["edited_fingerprint"] == plain_print(changed)
        assert abs(got[i]["near_edited"] - plain_likeness(own, changed)) < 1e-6 and abs(got[i]["near_next"] - plain_likeness(own, after)) < 1e-6
        held += 1
    assert held > 20


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_op6_ranges(spark, sf_dir, partitions):
    """However the ids are dealt, some ranges empty: each document meets the next one."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint_chain(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    order = sorted(texts, reverse=True)
    assert got == {i: sha(texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[order[(k + 1) % len(order)]][: len(texts[i]) // 3]) for k, i in enumerate(order)}


def test_op6_equal_ids(spark):
    """One id for all rows, or none: rows are dealt by their texts and still follow each other in order."""
    texts = [f"{chr(97 + k % 26)} text {k}" for k in range(80)] + ["same"] * 5
    for id_ in (7, None):
        df = spark.createDataFrame([(id_, t) for t in texts], "doc_id long, text string").repartition(4)
        got = sorted(r["edited_sha256"] for r in fingerprint.fingerprint_chain(df).collect())
        order = sorted(texts)
        assert got == sorted(sha(t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][: len(t) // 3]) for k, t in enumerate(order))
    done = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartitionByRange(4, F.col("doc_id").desc_nulls_last(), F.substring(F.col("text").cast("binary"), 1, 64))
    assert done.select(F.spark_partition_id()).distinct().count() == 4


def test_op1_common_shingle(spark):
    """One shingle in every different text, and a template that hardly any of them is like: the same components as by brute force, and the hot list is not compared on full sets."""
    from test_llm import near_expected, words_text
    import random

    rng = random.Random(5)
    texts = ["one shingle stands in every text " + words_text(rng, rng.randrange(20, 60), 5000) for _ in range(300)]
    texts += [" ".join(t.split()[:-1]) for t in texts[::10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    from plotgauge.llm import near_dedup

    for p in (near_dedup.NearParams(block=32), near_dedup.NearParams(exact=True, block=32)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(df, p=p).collect()}
        assert got == near_expected(texts)


def test_op2_crowded_filter(spark, monkeypatch):
    """A filter that lets nearly every id through changes no count."""
    p = quality.QualityParams()
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id, 'l1' AS lang, 'no id' AS text"))
    labels = spark.range(0, 700, 7).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    count = lambda: {r["class"]: (r["raw"], r["target"]) for r in quality.gram_counts(rows, labels, p, "doc_id", "text", "lang").collect()}
    want = count()
    monkeypatch.setattr(quality, "FILTER_BITS", 8)
    assert count() == want
    target = collections.Counter(k for i in range(0, 500, 7) for k in quality.hashed_grams(f"text {i}".encode(), p.gram, p.bits).tolist())
    assert {k: t for k, (_, t) in want.items() if t} == target


def test_op2_weights_to_the_bit(spark, sf_dir, monkeypatch):
    """The same weights however rows are dealt, and with one language held at a time."""
    p, docs, labels = quality.QualityParams(), spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = lambda n: quality.ratio_weights(quality.gram_counts(docs.repartition(n, "doc_id"), labels, p, "doc_id", "text", "lang"), p)
    one, many = weights(1), weights(13)
    monkeypatch.setattr(quality, "HELD_LANGUAGES", 1)
    assert one.any() and np.array_equal(one, many) and np.array_equal(one, weights(5))
