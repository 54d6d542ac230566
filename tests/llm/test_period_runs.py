"""Operator 11 against stretches that are compared word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from plotgauge.llm import period_runs
from plotgauge.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """(start, length, period) for each period the stretches whose words equal the ones a period later; a stretch counts with its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def awkward(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(60))]
    if kind == 1:  # a Fibonacci word has the most runs
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(3, 8)):
            a, b = b, b + a
        return b[rng.randrange(len(b)) :]
    if kind == 2:
        w = [rng.randrange(2) for _ in range(rng.randrange(1, 20))]
        return [rng.randrange(2) for _ in range(3)] + (w * 4)[: rng.randrange(2, 5) * len(w)] + [rng.randrange(2) for _ in range(3)]
    if kind == 3:
        d, out = rng.randrange(1, 5), []
        for _ in range(rng.randrange(3, 16)):
            out += rng.choice(([0] * d + [1], [0] * (d + 1) + [1]))
        return (out + out)[rng.randrange(len(out)) :]
    x = ([rng.randrange(3) for _ in range(rng.randrange(1, 6))] * 12)[: rng.randrange(5, 40)]
    x[rng.randrange(len(x))] = rng.randrange(3)
    return x + x[: rng.randrange(len(x))]


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_against_plain(least):
    rng = random.Random(least)
    for _ in range(1500):
        x = awkward(rng)
        got = [tuple(map(int, r)) for r in zip(*period_runs.periodic_runs(np.array(x, np.int64), least))]
        assert got == plain_runs(x, least), x


def test_all_squares():
    """Every word of up to ten letters, repeated: proposals reach each period."""
    for q in range(1, 11):
        for bits in range(2**q):
            x = [bits >> k & 1 for k in range(q)] * 2
            got = [tuple(map(int, r)) for r in zip(*period_runs.periodic_runs(np.array(x, np.int64), 2))]
            assert got == plain_runs(x, 2), x


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("portion, stretch", [(1 << 20, 1 << 20), (50, 64)])
def test_tables(spark, monkeypatch, portion, stretch):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names; portions and stretches change nothing."""
    monkeypatch.setattr(period_runs, "PORTION", portion)
    monkeypatch.setattr("plotgauge.llm.common.STRETCH", stretch)
    rng = random.Random(1)
    texts = [" ".join(f"w{k}" for k in awkward(rng)) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "a " * 30_000, "x y " * 20 + "日本 " * 13, "ab\x00 " * 12, "\x1c \x1c " * 9]
    texts += [" ".join(random.Random(2).choices("abcdefgh", k=20_000)) + " t" * 14, texts[0], texts[0]]
    rows = [(i % 70 if i != 5 else None, t, 1, "r", 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string, row int").repartition(3)
    got = sorted(([r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]] for r in period_runs.find_runs(df).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = [(0, len(w), 1)] if len(w) == 30_000 else plain_runs(w) if len(w) < 20_000 else [(len(w) - 14, 14, 1)]
        want.append([i, len(w), runs, plain_collapse(w, runs)])
    assert got == sorted(want, key=repr)
    assert period_runs.find_runs(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """Every document of the smallest tables, word by word."""
    got = {r["doc_id"]: r for r in QUERIES["op11_period_runs"](spark, sf_dir).collect()}
    given = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    assert got.keys() == given.keys()
    planted = 0
    for i, text in given.items():
        words, h = WORD.findall(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        if n > 3000:
            continue
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top), i
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 5
