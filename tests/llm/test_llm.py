"""Each operator against a plain version on small fixtures, with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plotgauge.llm import chat_format, common, fingerprint, language_id, line_dedup, mixing, near_dedup, piece_codec, pieces, quality, substring_dedup, token_count
from plotgauge.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path(piece_codec.MODEL)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, id string, version string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages and lines, plus the awkward ones."""
    rng = random.Random(seed)
    texts = [words_text(rng, rng.randrange(20, 160)) for _ in range(n)]
    passage, line = words_text(rng, 70), "\n".join(words_text(rng, 6) for _ in range(4))
    for k in range(0, n, 4):
        texts.append(texts[k])  # a copy
        w = texts[k].split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
        texts.append(" ".join(w))  # a near copy
        texts.append(words_text(rng, 15) + " " + passage + " " + words_text(rng, 25))
        texts.append(words_text(rng, 8) + "\n" + line + "\n" + words_text(rng, 8))
    base = words_text(rng, 120).split()
    for _ in range(50):  # one large group of near copies, some of them beyond the threshold
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    texts += ["", None, " \t\n ", "one", "One two", "a\x00b  c d 　e", "日本語 のテキスト 😀 ñandú", "a" * 3000, " " * 300, "x y " * 400, "<|im_end|> & &lt;| <unk>\r\n▁▁", "\n\n\n\n\n\n"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", "src17", None][i % 4] if i % 2 else "src0", len(t or ""), "x", "y", "z", "v") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    """Rows without an id, and rows that stand twice."""
    t = words_text(random.Random(8), 90)
    return spark.createDataFrame([(None, t, None, None, None, "", "", "", ""), (None, None, None, None, None, "", "", "", ""), (5, t, "en", "src1", 1, "", "", "", ""), (5, t, "en", "src1", 1, "", "", "", ""), (5, "other", "en", "src1", 1, "", "", "", "")], SCHEMA)


def collected(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# --- 1


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_expected(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("params", [near_dedup.NearParams(), near_dedup.NearParams(pairs_list=3, block=7), near_dedup.NearParams(exact=True), near_dedup.NearParams(exact=True, sketch=4, pairs_list=3, block=7, block_values=500)])
def test_near_components(docs, params):
    assert collected(near_dedup.near_components(docs, p=params), "n_shingles", "component_id", "kept") == near_expected(corpus())


def test_near_short_supersets(spark):
    """Sets of 12 to 24 shingles and their largest linked supersets, each pair without other partners."""
    rng, texts = random.Random(11), []
    for n in range(12, 25):
        for k in range(20):
            w = [f"s{n}x{k}x{rng.randrange(10**9)}" for _ in range(n * 100 // 75 + 4)]
            texts += [" ".join(w[: n + 4]), " ".join(w)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, expected = collected(near_dedup.near_components(df), "n_shingles", "component_id", "kept"), near_expected(texts)
    assert sum(not kept for _, _, kept in expected.values()) == 260
    lost = collections.Counter(expected[i][0] for i in expected if got[i] != expected[i])
    assert not lost, f"of 20 pairs each, by the superset's size: {dict(lost)}"


def test_near_awkward(empty, nulls):
    assert near_dedup.near_components(empty).count() == 0
    rows = near_dedup.near_components(nulls).collect()
    assert len(rows) == 5 and all(r["kept"] for r in rows)
    assert {r["component_id"] for r in rows} == {None, 5}


def test_components(spark):
    edges = [(k + 1, k) for k in range(1, 40)] + [(100, 101), (7, 7), (103, 101)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(2, 41)} | {101: 100, 103: 100}


def test_hot_star(spark):
    """A centre with a million edges: both sides of each join are tables, not aggregates, so that its edges can be split."""
    from plotgauge.llm import components

    plans = []
    write = components.write_table

    def watched(df, name, **more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, **more)

    components.write_table = watched
    try:
        star = spark.range(1, 1_000_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        path = spark.createDataFrame([(1_000_001, 5), (1_000_002, 1_000_001)], "a long, b long")
        found = connected_components(star.unionByName(path))
        assert found.agg(F.count("node"), F.min("component"), F.max("component")).first() == (1_000_002, 0, 0)
    finally:
        components.write_table = write
    for plan in plans:
        for part in plan.split("Join Inner")[1:]:
            assert "Aggregate" not in part
    assert any("Join Inner" in plan for plan in plans)


@pytest.mark.parametrize("memo", [common.HashMemo(), token_count.CountMemo(pieces.load(MODEL))])
def test_memos_are_bounded_by_bytes(memo):
    """20,000 texts without spaces leave nothing behind; short words are remembered."""
    long_words = ["".join(chr(0x4E00 + (k * 31 + j) % 5000) for j in range(300)) for k in range(20_000 if isinstance(memo, common.HashMemo) else 2_000)]
    for w in long_words:
        memo[w.encode() if isinstance(memo, common.HashMemo) else w]
    assert sum(map(len, memo)) == 0
    short = [f"w{k}" for k in range(1000)]
    for w in short:
        memo[w.encode() if isinstance(memo, common.HashMemo) else w]
    assert len(memo) == 1000 and max(map(len, memo)) <= common.LONGEST_WORD


# --- 2


def base_expected(text, p=quality.QualityParams()):
    w = WORD.findall(text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark, docs, empty, nulls):
    labels = spark.createDataFrame([(i, 1 if i < 40 else 0, 0) for i in range(0, 80, 2)] + [(None, 1, 0), (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels)
    assert collected(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == {i: base_expected(t) for i, t in enumerate(corpus())}
    p = quality.QualityParams()
    raw, target = collections.Counter(), collections.Counter()
    grams = {i: collections.Counter(quality.hashed_grams((t or "").encode(), p.gram, p.bits).tolist()) for i, t in enumerate(corpus())}
    for i, g in grams.items():
        raw += g
        if i < 40 and i % 2 == 0:
            target += g
    size = 1 << p.bits
    weight = lambda c: np.log((target[c] + 1) / (target.total() + size)) - np.log((raw[c] + 1) / (raw.total() + size))
    for r in got.collect():
        g = grams[r["doc_id"]]
        expected = sum(weight(c) * n for c, n in g.items()) / g.total() if g else 0.0
        assert r["ratio"] == pytest.approx(expected, abs=2e-6)
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= p.least_ratio)
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(nulls, labels.limit(0)).where("ratio <> 0").count() == 0


def test_quality_judges_no_language(spark, sf_dir):
    """A language that labels cover less keeps its clean texts; junk goes in each language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.op2_quality(spark, sf_dir).join(labels.where("quality IS NOT NULL").select("doc_id", "quality").distinct(), "doc_id").where("NOT base_failed")
    assert {(r["quality"], r["kept"]) for r in got.select("quality", "kept").distinct().collect()} == {(0, False), (1, True)}
    rng, rows = random.Random(6), []
    for lang, n in (("xx", 200), (None, 40)):
        clean, junk = [[f"{a}{lang}{k}" for k in range(50)] for a in "cj"]
        for k in range(n):
            rows.append((len(rows), " ".join(rng.choice(junk if k % 10 == 9 else clean) for _ in range(60)), lang, k % 10 != 9, 1 if k < 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, clean boolean, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, docs.select("doc_id", "quality"), lang_col="lang").collect()}
    assert kept == {i: clean for i, _, _, clean, _ in rows}


# --- 3


def test_fill(spark):
    rows = [("p", "a", 10, 1, 100), ("p", "b", 200, 1, 100), ("p", "c", 200, 2, 100), ("q", "a", 5, 3, 50), ("q", "b", 7, 0, 50)]
    df = mixing.fill(spark.createDataFrame(rows, "parent string, name string, cap long, weight long, budget long"), ["parent"], "name")
    assert {(r["parent"], r["name"]): r["given"] for r in df.collect()} == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("q", "a"): 5, ("q", "b"): 0}


def test_mixing(docs, empty, nulls):
    mix = mixing.Mix(share_num=1, share_den=2, bucket_digits=1)
    slim, plan = mixing.plan_mix(docs, mix)
    tokens = {i: len(WORD.findall(t or "")) for i, t in enumerate(corpus())}
    assert {r["doc_id"]: r["n_tokens"] for r in slim.collect()} == tokens
    taken = {r["doc_id"]: r["c"] for r in slim.join(plan, ["domain", "lang", "source"]).select("doc_id", mixing.copies(mix).alias("c")).collect()}
    by_leaf = collections.defaultdict(list)
    for r in slim.collect():
        by_leaf[r["domain"], r["lang"], r["source"]].append(r["doc_id"])
    for p in plan.collect():
        ids = by_leaf[p["domain"], p["lang"], p["source"]]
        key = lambda i, e=p["epochs"]: (hashlib.md5(f"{mix.seed}:{e}:{i}".encode()).hexdigest(), i)
        rest, upto = p["target"] - p["epochs"] * p["tokens"], 0
        assert p["target"] <= mix.max_epochs * p["tokens"]
        for i in sorted(ids, key=key):
            upto += tokens[i]
            assert taken[i] == p["epochs"] + (upto <= rest)
    assert sum(r["target"] for r in plan.collect()) <= sum(tokens.values()) // 2
    rows = mixing.mix_rows(docs, mix)
    assert rows.columns == docs.columns and collections.Counter(r["doc_id"] for r in rows.collect()) == {i: c for i, c in taken.items() if c}
    assert mixing.mix_rows(empty, mix).count() == 0
    assert mixing.mix_rows(nulls, mix).columns == nulls.columns


def test_shortage_goes_to_siblings_first(spark):
    rows = [(k, " ".join(["t"] * 10), "en", s) for k, s in enumerate(["src0"] * 40 + ["src4"] * 2 + ["src1"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = {r["source"]: r["target"] for r in mixing.plan_mix(docs, mixing.Mix(domains={"web": 50, "books": 50}, max_epochs=1, share_num=1, share_den=2))[1].collect()}
    # web (src0, src4) gets half of 510: src4 can only give 20, so its sibling src0 makes up for it and books keeps its half
    assert plan == {"src4": 20, "src0": 235, "src1": 255}


# --- 4 and 7


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward_texts():
    rng = random.Random(1)
    p = pieces.load(MODEL)
    names = list(p.ids)
    out = [t or "" for t in corpus()] + [" " * 1000, " " * 37 + "the", " " * 500 + "x" + " " * 33, "ation" * 300, "a▁b", "▁", "\x00x", "� x"]
    out += ["".join(rng.choice(names) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return out + ["".join(rng.choice("abcdeeetttiiioonns  ▁\né日本_-=<>/0123") for _ in range(rng.randint(1, 120))) for _ in range(1500)]


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_pieces_equal_the_library(monkeypatch, stretch):
    monkeypatch.setattr(pieces, "STRETCH", stretch)
    monkeypatch.setattr(piece_codec, "STRETCH", stretch)
    sp, texts = library(), awkward_texts()
    p = pieces.load(MODEL)
    memo = token_count.CountMemo(p)
    for text, ids, expected in zip(texts, piece_codec.Encoder(MODEL).encode(texts), sp.encode(texts)):
        assert ids.tolist() == expected
        assert token_count.count_text(text, memo) == len(expected)
        assert piece_codec.decode(np.array(expected, np.int64), p) == sp.decode(expected)


def test_small_memo_and_portions(monkeypatch, docs):
    """A memo that is forgotten all the time, and portions of a few texts, change nothing."""
    monkeypatch.setattr(piece_codec, "MEMO_BYTES", 3000)
    encoder, sp, texts = piece_codec.Encoder(MODEL), library(), [t or "" for t in corpus()]
    for low in range(0, len(texts), 7):
        assert [x.tolist() for x in encoder.encode(texts[low : low + 7])] == sp.encode(texts[low : low + 7])
    assert len(encoder.memo) < len(set(" ".join(texts).split()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["id", "text"])
    parts = list(piece_codec.portions(batch, 500))
    assert len(parts) > 20 and [t for _, p in parts for t in p] == texts and [i for k, _ in parts for i in k.to_pylist()] == list(range(len(texts)))


def test_decode_any_ids():
    sp, p, rng = library(), pieces.load(MODEL), random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(3, 32000) for _ in range(rng.randint(1, 12))]
        assert piece_codec.decode(np.array(ids), p) == sp.decode(ids)


def test_encode_and_count_tables(docs, empty, nulls):
    sp = library()
    coded = collected(piece_codec.encode_pieces(docs, MODEL), "n_tokens", "ids", "decoded")
    digests = collected(piece_codec.encode_pieces(docs, MODEL, with_ids=False), "n_tokens", "ids_sha256", "decoded_sha256")
    counted = collected(token_count.count_tokens(docs, MODEL, limit=50), "n_bytes", "n_tokens", "over_limit")
    for i, t in enumerate(corpus()):
        ids = sp.encode(t or "")
        assert coded[i] == (len(ids), ids, sp.decode(ids))
        assert digests[i] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert counted[i] == (len((t or "").encode()), len(ids), len(ids) > 50)
    assert piece_codec.encode_pieces(empty, MODEL).count() == token_count.count_tokens(empty, MODEL).count() == 0
    assert piece_codec.encode_pieces(nulls, MODEL).count() == token_count.count_tokens(nulls, MODEL).count() == 5


# --- 5


def substring_expected(texts, min_words=50):
    first, out = {}, {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - min_words + 1):
            if first.setdefault(tuple(w[s : s + min_words]), i) < i:
                gone[s : s + min_words] = [True] * min_words
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = len(w), sum(gone), kept
    return out


@pytest.mark.parametrize("size", [(50, 12), (12, 4), (6, 6)])
def test_substrings(docs, size):
    got = collected(substring_dedup.dedup_substrings(docs, min_words=size[0], seed_words=size[1]), "n_words", "n_removed", "kept")
    assert got == substring_expected(corpus(), size[0])


def test_substrings_awkward(empty, nulls):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert [r["n_removed"] for r in substring_dedup.dedup_substrings(nulls).collect()] == [0] * 5


# --- 6


def test_fingerprints(docs, empty, nulls):
    texts = corpus()
    got = collected(fingerprint.fingerprint_chain(docs), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(range(len(texts)), reverse=True)
    for place, i in enumerate(order):
        text, follower = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        own, changed, after = (fingerprint.chain(fingerprint.features(t.encode())) for t in (text, edited, follower))
        assert got[i] == (len(text), sha(edited), fingerprint.digest_text(own), fingerprint.digest_text(changed), fingerprint.likeness(own, changed), fingerprint.likeness(own, after))
        assert fingerprint.likeness(own, own) == 1 and 0 <= got[i][4] <= 1 and 0 <= got[i][5] <= 1
    assert fingerprint.fingerprint_chain(empty).count() == 0
    assert fingerprint.fingerprint_chain(nulls).count() == 5


def test_short_texts_have_likeness(spark):
    """Texts of 20 to 200 bytes against themselves with the last third replaced, and against others."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n)) for n in range(20, 201) for _ in range(2)]
    got = collected(fingerprint.fingerprint_chain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "near_edited", "near_next")
    edited, others = np.array([got[i][0] for i in range(len(texts))]), np.array([got[i][1] for i in range(len(texts))])
    assert (edited > 0.3).all() and np.median(edited) > 0.5, f"{(edited == 0).sum()} of {len(texts)} without likeness, median {np.median(edited)}"
    assert np.median(others) < 0.1


def test_window_entropy():
    b = np.frombuffer(corpus()[2].encode(), np.uint8)
    plain = [-sum(c / 64 * np.log2(c / 64) for c in collections.Counter(b[i : i + 64].tolist()).values()) for i in range(len(b) - 63)]
    assert np.allclose(fingerprint.window_entropy(b), plain, atol=1e-5)
    rank = np.frombuffer(b"abcaabbccab" * 30, np.uint8)
    assert fingerprint.leftmost_best(rank).tolist() == [i + int(rank[i : i + 64].argmax()) for i in range(len(rank) - 63)]


# --- 8


def test_language_id(spark):
    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "tion", "sh"], "de": ["sch", "ung", "ich", "ß"], "es": ["ción", "ado", "ll", "ñ"]}
    rows = []
    for i in range(300):
        lang = ["en", "de", "es"][i % 3]
        rows.append((i, " ".join(rng.choice(sounds[lang]) + rng.choice(sounds[lang]) for _ in range(rng.randrange(3, 30))), lang if i % 10 else None))
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 %% 34", "de"), (None, "thesh tion", "en"), (303, "the " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.labels == ["de", "en", "es"] and 0 < len(model.value_of) < 0.05 * 3 * len(model.idf)  # sparse
    got = {r["row"]["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    wrong = sum(got[i]["lang_pred"] != ["en", "de", "es"][i % 3] for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert wrong <= 2 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303]["lang_pred"] == "en"
    # held-out labels are never read
    changed = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    again = language_id.train(changed)
    assert np.array_equal(again.value_of, model.value_of) and np.array_equal(again.label_of, model.label_of)
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


# --- 9


def test_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"a <|im_end|> &lt;| b"}]}', "messages"),
        (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}', "from_value"),
        (3, '{"prompt":"p","response":"r"}', "prompt_response"),
        (4, '{"instruction":"i","input":"","output":"o"}', "instruction_input_output"),
        (5, '{"instruction":"i","input":"x","output":"o"}', "instruction_input_output"),
        (6, '{"output":"o","instruction":"i"}', "instruction_output"),
        (7, '{"unknown":1}', None),
        (8, "no json", None),
        (9, None, None),
        (10, '{"messages":[]}', "messages_empty"),
        (11, '{"messages":[{"role":null,"content":null}]}', "messages"),
    ]
    df = spark.createDataFrame(rows, "id long, record string, layout string")
    turns = {r["id"]: r for r in chat_format.canonical_turns(df, "id", "record").collect()}
    assert {i: turns[i]["layout"] for i, _, _ in rows} == {i: x for i, _, x in rows}
    said = {i: [(t["role"], t["text"]) for t in r["turns"]] for i, r in turns.items()}
    assert said[1] == [("user", "hi"), ("assistant", "a <|im_end|> &lt;| b")] and said[2] == [("user", "q"), ("assistant", "r")]
    assert said[4] == [("user", "i"), ("assistant", "o")] and said[5] == [("user", "i\nx"), ("assistant", "o")]
    assert said[7] == said[8] == said[9] == said[10] == [] and said[11] == [("", "")]


def test_long_json_records(spark, monkeypatch):
    """JSON records with a text beyond the parsers' 20,000,000 characters."""
    record = F.to_json(F.struct(F.array(F.struct(F.lit("human").alias("role"), F.lit('a "q": \\ \n').alias("content")), F.struct(F.lit("gpt").alias("role"), F.expr("repeat('ab\"\\n', 5500000)").alias("content"))).alias("messages")))
    turns = chat_format.canonical_turns(spark.range(1).select("id", record.alias("record")), "id", "record")
    got = turns.select("layout", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("n"), F.md5(t["text"]).alias("md5"))).alias("turns")).collect()
    texts = ('a "q": \\ \n', 'ab"\n' * 5500000)
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == [("messages", [(role, len(t), hashlib.md5(t.encode()).hexdigest()) for role, t in zip(("user", "assistant"), texts)])]
    # the same shapes without texts
    monkeypatch.setattr(chat_format, "LONG", 3)
    records = ['{"messages":[{"role":"us\\"er","content":"\\\\"},{"role":null,"content":"x: \\u00e9"}]}', '{"prompt" : "p", "response":"r\\n"}', '{"unknown":1}']
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    assert [r["layout"] for r in chat_format.canonical_turns(df, "id", "record").orderBy("id").collect()] == ["messages", "prompt_response", None]
    for bad in ("no json", '{"pro\\u006dpt":"p","response":"r"}'):
        with pytest.raises(Exception, match="long chat record"):
            chat_format.canonical_turns(spark.createDataFrame([(1, bad)], "id long, record string"), "id", "record").collect()


def test_template_is_reversible(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&amp;lt;| <", "", "a\nb\n", "<" * 5 + "|", "&#10;", "ñ😀", "x" * 50000]
    rows = [(i, [(r, t) for t in nasty[i:] + nasty[:i] for r in ("user", "assistant", "odd\nrole<|")]) for i in range(len(nasty))] + [(99, []), (100, None)]
    df = spark.createDataFrame(rows, "id long, turns array<struct<role:string,text:string>>")
    formatted = chat_format.format_turns(df, "id")
    back = {r["id"]: r for r in chat_format.read_back(formatted, "id").collect()}
    for i, turns in rows:
        assert [(t["role"], t["text"]) for t in back[i]["turns"]] == (turns or [])
        assert back[i]["loss_text"] == "".join(t for r, t in turns or [] if r == "assistant")
    for r in formatted.collect():
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(dict(rows)[r["id"]] or [])


# --- 10


def lines_expected(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            if first.setdefault(tuple(lines[k : k + 3]), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(docs, empty, nulls):
    got = line_dedup.dedup_lines(docs)
    assert collected(got.select("row.doc_id", "n_lines", "n_removed", "kept_text"), "n_lines", "n_removed", "kept_text") == lines_expected(corpus())
    assert got.select("row.*").columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(nulls).count() == 5


# --- very long texts


@pytest.mark.parametrize("stretch", [128, 777, 1000])
def test_stretches_change_nothing(monkeypatch, stretch):
    from plotgauge.llm import common

    rng = random.Random(1)
    raw = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(2000)).encode()

    def found():
        counts = sum(np.bincount(quality.hashed_grams(x, 4, 16), minlength=1 << 16) for x in quality.gram_stretches(raw, 4))
        features = language_id.gram_features(raw.decode(), language_id.LanguageParams())
        windows = [fingerprint.popular_windows(raw[:n]) for n in (64, 100, 127, 130, len(raw))]
        memo = common.HashMemo()
        base = quality.base_counts(raw + b"\n" + raw[:300] + b"\n" + raw[:300], quality.QualityParams(), memo)
        cut = [substring_dedup.cut_words(raw, np.array([5, 40, 700, 1990]), np.array([60, 90, 760, 2000]), x) for x in (True, False)]
        assert cut[1] == cut[0][:2] + (sha(cut[0][2]),) and cut[0][:2] == (2000, 155)
        return base, cut, counts.tolist(), features[0].tolist(), features[1].tolist(), windows, common.HashMemo().of_text(raw).tolist()

    whole = found()
    for module in (common, quality, language_id, fingerprint):  # the places that read it
        monkeypatch.setattr(module, "STRETCH", stretch)
    assert found() == whole
