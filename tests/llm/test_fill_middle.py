"""Operator 13 against units joined as lists, and exact round trips."""

import hashlib
import random
import re

import pytest

from plotgauge.llm import fill_middle as fim

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
MARKS = fim.FillParams().marks()


def plain(key, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def awkward(rng):
    return "".join(rng.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "b", "ñ", "日", "😀", " ", "<", "P", ">", "\x1c", "\x85"]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_rotations(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        low, mid, high = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buf = bytearray(data)
        fim.rotate(buf, low, mid, high)
        assert bytes(buf) == data[:low] + data[mid:high] + data[low:mid] + data[high:]
        text = awkward(rng)
        raw, units = text.encode(), UNIT.findall(text)
        n, words = fim.count_units(raw)
        assert n == len(units)
        for k in range(n + 1):
            assert fim.cut_place(raw, words, n, k) == len("".join(units[:k]).encode())
        assert fim.code_points(raw, 0, len(raw)) == len(text)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_round_trip(form):
    """Any cuts of any text without a sentinel, even one that begins or ends like a sentinel."""
    rng = random.Random(4)
    for _ in range(2000):
        raw = "".join(rng.choice("<PSM>x") for _ in range(rng.randrange(12))).encode()
        if any(m in raw for m in MARKS):
            continue
        a, b = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
        buf = bytearray(raw)
        fim.take_apart(buf, a, b, form, MARKS)
        parts = [MARKS[0] + raw[:a], MARKS[1] + raw[b:], MARKS[2] + raw[a:b]]
        assert bytes(buf) == b"".join(parts if form == "psm" else [parts[1], parts[0], parts[2]])
        fim.put_together(buf, form, MARKS)
        assert bytes(buf) == raw


def test_sentinels():
    for bad in ({"prefix": ""}, {"prefix": "<S>x"}, {"prefix": "aa", "suffix": "ba"}, {"middle": "<P>"}):
        with pytest.raises(ValueError):
            fim.FillParams(**bad).marks()


def test_tables(spark, monkeypatch):
    rng = random.Random(9)
    texts = [awkward(rng) for _ in range(300)] + [None, "", "   ", "x", "a <P> b", "word " * 60_000, "z" * 300_000, "same text", "same text"]
    rows = [(i if i != 7 else None, t, "f", 3, "o") for i, t in enumerate(texts)] + [(11, texts[11], "g", 4, "p"), (11, "another text of the same id", "g", 4, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, _key string").repartition(4)
    made = fim.fill_middle(df)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((i, *plain("" if i is None else i, t or "")) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.restore_middle(made, ["doc_id", "n"])
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert fim.fill_middle(df.limit(0)).count() == 0
