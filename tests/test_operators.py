"""Operators and helpers against hand-made cases and plain versions."""

import collections
import itertools
import json
import math
import random
import struct
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgauge.functions import text as X
from plotgauge.functions.stats import average_rank
from plotgauge.operators import chains, colors, complexity, parsing, pixels, robustness, scoring, states, synthesis, text_match
from plotgauge.sources import readers, writers
from plotgauge.streaming import results


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


# --- text


def test_fences_and_json(spark):
    cases = {
        '{"a":1}': '{"a":1}',
        '```json\n{"a":1}\n```': '{"a":1}',
        'so: {"a":{"b":2}} ok': '{"a":{"b":2}}',
        "[1, 2] rest": "[1, 2]",
        "none": None,
        '{"a":': None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(values(df.select("t", X.valid_json(X.json_payload(F.col("t"))).alias("p")), "t", "p")) == cases
    block = dict(values(df.select("t", X.json_block(F.col("t")).alias("p")), "t", "p"))
    assert block["[1, 2] rest"] is None and block[""] is None and block['{"a":1}'] == '{"a":1}' and block['so: {"a":{"b":2}} ok'] == '{"a":{"b":2}}'


def test_html(spark):
    df = spark.createDataFrame([("a ```HTML\n<p>\n``` b",), ("plain",), ("```html<a>``` ```html<b>```",)], "t string")
    assert values(df.select(X.extract_html(F.col("t")).alias("h")), "h") == ["<p>", "plain", "<a>"]
    counts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",)], "t string")
    assert values(counts.select(X.line_count(F.col("t")).alias("n")), "n") == [0, 1, 1, 2, 2]
    gate = spark.createDataFrame([("<html></html>",), ("<HTML></HTML>",), ("<html>",), (None,)], "t string")
    assert values(gate.select(X.html_gate(F.col("t")).alias("g")), "g") == [True, False, False, False]


def test_normalize_text(spark):
    df = spark.createDataFrame([("  A \n b ",), (None,)], "t string")
    assert values(df.select(X.normalize_text(F.col("t")).alias("n")), "n") == ["a b", ""]


def test_judge(spark):
    raw = json.dumps({"scores": {"visual_logic_score": 3, "interaction_score": 5}, "fatal_errors": ["x"], "style_warnings": []})
    df = spark.createDataFrame([(raw,), ("nothing",), (None,)], "raw string")
    rows = parsing.flatten_judge(parsing.parse_judge(df)).collect()
    assert (rows[0]["visual_logic"], rows[0]["interaction"], rows[0]["fatal"], rows[0]["data_fidelity"]) == (3.0, 5.0, True, None)
    assert rows[1]["reject"] == "no json" and rows[2]["visual_logic"] is None


def test_validate_generation(spark):
    df = spark.createDataFrame([('{"csv_content":"a","csv_code":"b","reference_html":"c"}',), ('{"csv_content":"a"}',), ("x",)], "raw string")
    assert values(parsing.validate_generation(df, "update"), "reject") == [None, "missing csv_code", "no json"]


def test_render_prompts(spark):
    df = spark.createDataFrame([("X{}", 7)], "html string, n long")
    assert values(synthesis.render_prompts(df, "a {} b {n} {}", {"{n}": "n", "{}": "html"}), "prompt") == ["a X{} b 7 {}"]


# --- scores


def test_composite_and_gate(spark):
    rows = [("m", "data_update", "1", 1, 1.0, 1.0, 5, 5, 5), ("m", "data_update", "2", 2, 0.0, 0.0, 1, 1, 1), ("m", "data_edit", "3", 0, 0.5, 0.5, 3, 3, 3), ("m", "data_edit", "4", None, 0.0, 0.0, 1, 1, 1)]
    df = spark.createDataFrame(rows, "model string, task string, sample string, error_count long, ocr_f1 double, color_iou double, visual_logic int, data_fidelity int, style int")
    assert dict(values(scoring.composite_score(scoring.metric_means(df)), "task", "score")) == {"data_update": 0.5, "data_edit": 0.25}
    assert dict(values(scoring.composite_score(scoring.metric_means(df, "per_sample")), "task", "score")) == {"data_update": 0.5, "data_edit": 0.25}


# The published scores of one task, three of them tied at zero.
UPDATE_TIES = [0.62045, 0.5, 0.49, 0.48, 0.47, 0.46, 0.45, 0.44, 0.30922, 0.2, 0.19, 0.18, 0.17, 0.16, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("zeros,pairs", [(0, 136), (2, 135), (3, 133)])
def test_one_swap_correlations(spark, zeros, pairs):
    scores = [1 - k / 20 for k in range(17 - zeros)] + [0.0] * zeros
    base = spark.createDataFrame([("t", f"m{k:02d}", s) for k, s in enumerate(scores)], "task string, model string, score double")
    swapped = scores[:]
    swapped[3], swapped[4] = swapped[4], swapped[3]
    moved = spark.createDataFrame([(0.1, 0, "t", f"m{k:02d}", s) for k, s in enumerate(swapped)], "amplitude double, idx long, task string, model string, score double")
    assert robustness.kendall_tau_b(base, moved).first()["kendall"] == pytest.approx(1 - 2 / pairs)
    if not zeros:
        assert robustness.spearman(base, moved).first()["spearman"] == pytest.approx(1 - 12 / 4896)


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("u", k, s) for k, s in enumerate(UPDATE_TIES)], "task string, k long, score double").withColumn("r", average_rank("score", ["task"]))
    ranks = dict(values(df, "k", "r"))
    assert ranks[0] == 1 and ranks[14] == ranks[15] == ranks[16] == 16


def test_weights(spark):
    w = robustness.wide_weights(robustness.perturbed_weights(spark, 30)).collect()
    assert len(w) == 120
    for r in w:
        assert sum(r[f"w_{m}"] for m in scoring.BASE_WEIGHTS) == pytest.approx(1) and min(r[f"w_{m}"] for m in scoring.BASE_WEIGHTS) > 0


def test_pending(spark):
    everything = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    done = spark.createDataFrame([("a", 0), ("b", None)], "sample string, error_count long")
    assert sorted(values(scoring.pending(everything, done, ["sample"]), "sample")) == ["b", "c"]
    assert values(scoring.pending(everything, done, ["sample"], retry_gate_failures=False), "sample") == ["c"]


def test_color_iou(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert values(df.select(scoring.color_iou(F.col("a"), F.col("b")).alias("v")), "v") == [0.5, 1.0, 0.0]


# --- text match


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 7)):
        if n > m:
            continue
        cost = rng.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        chosen = text_match.assign(cost)
        assert len(set(chosen.tolist())) == n and cost[np.arange(n), chosen].sum() == pytest.approx(best)


def test_fuzzy_f1():
    assert text_match.fuzzy_f1([], []) == 1 and text_match.fuzzy_f1(["a"], []) == 0
    assert text_match.fuzzy_f1(["alpha", "beta"], ["beta", "alpha"]) == 1
    assert text_match.fuzzy_f1(["alpha", "alpha"], ["alpha"]) == pytest.approx(2 / 3)
    words = ["legend", "legends", "axis", "axes", "total"]
    assert 0 <= text_match.fuzzy_f1(words, words[::-1] + ["x"]) <= 1


def test_text_similarity_rounds_first(spark):
    df = spark.createDataFrame([("Sales  2020", "sales 2021"), (None, ""), ("abcd" * 60, "bcda" * 60)], "a string, b string")
    norm = lambda s: " ".join((s or "").split()).lower()
    expected = [round(SequenceMatcher(None, norm(a), norm(b)).ratio(), 4) for a, b in values(df, "a", "b")]
    assert values(text_match.text_similarity(df, "a", "b"), "similarity") == expected


# --- colours and pixels


def plain_lightness(names, labs, t):
    rows = sorted(range(len(names)), key=lambda i: -labs[i][0])
    root = {n: n for n in names}
    while True:
        best = min(((math.dist(labs[a], labs[b]), k) for k, (a, b) in enumerate(zip(rows, rows[1:]))), default=None)
        if best is None or best[0] > t:
            return root
        keep, gone = rows[best[1]], rows.pop(best[1] + 1)
        root = {n: names[keep] if r == names[gone] else r for n, r in root.items()}


def test_merges():
    assert colors._merge_similar(["a", "b", "c"], [5, 3, 2], {"b": {"c"}, "a": {"b"}}) == {"a": "a", "b": "a", "c": "a"}
    assert colors._merge_similar(["a", "b"], [5, 3], {"b": {"a"}}) == {"a": "a", "b": "b"}
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(1, 9)
        labs = [(rng.randrange(60), rng.randrange(120, 140), rng.randrange(120, 140)) for _ in range(n)]
        names = [f"n{k}" for k in range(n)]
        assert colors._merge_lightness(names, np.array(labs, float), 14) == plain_lightness(names, labs, 14)


@pytest.fixture(scope="module")
def profile(spark):
    rows = [("i", "a", 50, 200, 128, 128), ("i", "b", 30, 195, 128, 128), ("i", "c", 15, 90, 40, 40), ("i", "d", 5, 88, 42, 40), ("j", "a", 10, 20, 60, 60)]
    return spark.createDataFrame(rows, "image string, name string, n long, l0 long, l1 long, l2 long")


def test_count_named_colors(spark, profile):
    similar = spark.createDataFrame([("c", "d"), ("z", "a")], "name string, similar_name string")
    got = {r["image"]: r["names"] for r in colors.count_named_colors(profile, similar).collect()}
    assert got == {"i": ["a", "c"], "j": ["a"]}
    assert {r["image"]: r["names"] for r in colors.count_named_colors(profile, similar, background=["a"]).collect()}["i"] == ["a", "b", "c"]


def test_groupings(profile):
    lead = {r["name"]: r["leader"] for r in colors.leader_groups(profile.where("image = 'i'")).collect()}
    assert lead == {"d": "d", "c": "d", "b": "b", "a": "b"}
    parts = {r["name"]: r["component"] for r in colors.radius_components(profile.where("image = 'i'"), 6).collect()}
    assert parts == {"a": "a", "b": "a", "c": "c", "d": "c"}
    k = {r["name"]: r["cluster"] for r in colors.weighted_kmeans(profile.where("image = 'i'"), 2).collect()}
    assert k["a"] == k["b"] != k["c"] == k["d"]


def test_nearest_color_takes_the_first_of_equals(spark):
    d = spark.createDataFrame([(1, "late", 0, 0, 2), (0, "early", 0, 0, 0)], "idx long, name string, l0 long, l1 long, l2 long")
    assert values(colors.nearest_color(spark.createDataFrame([(0, 0, 1)], "c0 long, c1 long, c2 long"), d), "name") == ["early"]


def test_ssim(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 10)), rng.random((12, 10))

    def plain(x, y):
        out = []
        for i in range(x.shape[0] - 6):
            for j in range(x.shape[1] - 6):
                p, q = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
                c = np.cov(p, q)
                out.append((2 * p.mean() * q.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
        return np.mean(out)

    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), 10), (a.ravel().tolist(), a.ravel().tolist(), 10), (None, [1.0], 10)], "a array<double>, b array<double>, width int")
    got = values(pixels.image_ssim(df), "ssim")
    assert got == [pytest.approx(plain(a, b), abs=1e-4), 1.0, 0.0]


def test_suppress_points(spark):
    points = spark.createDataFrame([("i", 0, 0, 3.0), ("i", 5, 5, 2.0), ("i", 5, 30, 1.0), ("i", 11, 0, 0.5)], "image string, x long, y long, response double")
    assert values(pixels.suppress_points(points), "n_points") == [3]


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(c for p in r for c in p) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 1), (0, 0, 0)], [(1, 2, 3), (255, 0, 1)]])
    images = readers.read_images(spark, str(tmp_path))
    got = sorted(values(readers.pixels(images), "y", "x", "c0", "c1", "c2"))
    assert got == [(0, 0, 1, 0, 255), (0, 1, 0, 0, 0), (1, 0, 3, 2, 1), (1, 1, 1, 0, 255)]
    assert sorted(values(readers.color_counts(images), "c0", "c1", "c2", "n")) == [(0, 0, 0, 1), (1, 0, 255, 2), (3, 2, 1, 1)]


# --- states and chains


def test_states(spark):
    s = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "sample string, data_len long")
    got = {}
    for sample, at in values(states.state_anchors(s), "sample", "data_index"):
        got.setdefault(sample, []).append(at)
    assert got == {"b": [0, 1, 2, 3, 4], "c": [0, 1, 3, 4, 5]}


def test_fail_at_k_never_falls(spark):
    rng = random.Random(1)
    rows = [(i, p, rng.uniform(0.7, 1)) for i in range(40) for p in range(5)]
    flags = states.pass_flags(spark.createDataFrame(rows, "sample long, position long, sim double"))
    for t in states.THRESHOLDS:
        at = [r["fail_at"] for r in states.fail_at_k(flags).where(F.col("threshold") == t).orderBy("k").collect()]
        assert at == sorted(at)


def test_chain(spark):
    options = chains.chain_options(chains.base_options(spark.range(5).withColumnRenamed("id", "chart_id")))
    sig = chains.semantic_signature(options)
    rows = chains.field_fidelity(sig, sig).collect()
    assert len(rows) == 50 and all(r["field_fidelity"] == 1 and r["exact_match"] for r in rows)
    last = sig.where("step = 10 AND chart_id = 2").first()
    assert last["series_style"] == "Orders|[6,6,0,0]|22/Conversion|3|10" and last["legend_pos"] == "-|false|true|middle|vertical"
    listed = options.where("step = 3").withColumn("option", F.regexp_replace("option", r'"title":(\{[^}]*\})', '"title":[$1]'))
    a, b = chains.semantic_signature(listed), sig.where("step = 3")
    assert sorted(values(a, "title_text", "title_layout")) == sorted(values(b, "title_text", "title_layout"))


def test_collapse_carries_on(spark):
    rows = [(1, s, s != 3, 1.0, True) for s in range(1, 6)]
    steps = chains.carry_hard_collapse(spark.createDataFrame(rows, "chart_id long, step long, render_ok boolean, field_fidelity double, exact_match boolean"))
    assert [r["render_ok"] for r in steps.orderBy("step").collect()] == [True, True, False, False, False]
    assert values(chains.collapse_distribution(steps), "step", "n") == [("3", 1)]


# --- complexity


def test_complexity_ends(spark):
    m = complexity.model_table(spark)
    low = m.select(F.lit(1).alias("image"), "feature", F.col("low").alias("value"))
    high = m.select(F.lit(2).alias("image"), "feature", F.col("high").alias("value"))
    partly = low.where("feature = 'O.IE'").withColumn("image", F.lit(3))
    got = dict(values(complexity.complexity_score(low.unionByName(high).unionByName(partly), m), "image", "score"))
    total = sum(c for _, c, _, _ in complexity.MODEL)
    assert got[1] == pytest.approx(total * 0.0001 / 1.0001) and got[2] == pytest.approx(total) and got[3] == pytest.approx(got[1])


# --- files


def test_trees(spark, tmp_path):
    for parts in ("m/t/1/gen.html", "m/t/1/orig.png", "m/t/1/gen.png", "m/t/2/gen.html", "m/t/3/eval.png"):
        f = tmp_path / "eval" / parts
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = readers.pick_reference_image(readers.read_eval_tree(spark, str(tmp_path / "eval")))
    assert sorted(values(got, "sample", "reference", "reject"), key=str) == [("1", "orig.png", None), ("2", None, "no reference image"), ("3", "eval.png", "no gen.html")]
    for parts in ("s1/chart.html", "s1/code.js", "s2/code.js"):
        f = tmp_path / "src" / parts
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(parts)
    assert sorted(values(readers.read_sample_tree(spark, str(tmp_path / "src")), "sample", "html", "js"), key=str) == [("s1", "s1/chart.html", "s1/code.js"), ("s2", None, "s2/code.js")]


def test_tables_of_constants(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Feature,coefficient,p\nO.IE,-0.5,1\n")
    assert values(readers.read_model_coefficients(spark, str(tmp_path / "c.csv")), "feature", "coefficient") == [("O.IE", -0.5)]
    (tmp_path / "bad.csv").write_text("Feature,x\n")
    with pytest.raises(ValueError):
        readers.read_model_coefficients(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "d.csv").write_text("idx,Color_Name,LAB(OpenCV)\n0,red,[53 80  67]\n")
    assert values(readers.read_color_dict(spark, str(tmp_path / "d.csv")), "color_name", "lab") == [("red", [53, 80, 67])]
    (tmp_path / "s.csv").write_text("Color_name,Similar_name\nred,\"['dark red', 'rose']\"\n")
    assert values(readers.read_color_similarity(spark, str(tmp_path / "s.csv")), "similar") == [["dark red", "rose"]]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "edit.txt").write_text("do {}\n")
    assert values(readers.read_prompts(spark, str(tmp_path / "prompts")), "name", "template") == [("edit", "do {}\n")]
    (tmp_path / "order.json").write_text('[{"sample":"9"},{"sample":"2"}]')
    assert sorted(values(readers.read_sample_order(spark, str(tmp_path / "order.json")), "sample", "position")) == [("2", 1), ("9", 0)]


def test_results_round_trip(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"m": {"t": {"1": {"error_count": 0, "ocr_f1": 0.5, "color_iou": 1.0, "gpt_evaluation": None}, "2": {"ocr_f1": 0, "color_iou": 0}}}}))
    df = readers.read_results_json(spark, str(tmp_path / "r.json"))
    assert sorted(values(df, "sample", "error_count", "ocr_f1")) == [("1", 0, 0.5), ("2", None, 0.0)]
    writers.write_results(df.drop("gpt_evaluation"), str(tmp_path / "out"))
    writers.write_results(df.drop("gpt_evaluation").withColumn("task", F.lit("u")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_stream_in_two_drops(spark, tmp_path):
    schema = spark.createDataFrame([], "model string, task string, sample string, error_count long, at long").schema
    drop, out, ck = (str(tmp_path / x) for x in ("drop", "out", "ck"))
    rows = [("m", "data_edit", str(k), k % 2, 1) for k in range(6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(drop)
    results.stream_new_results(results.read_stream(spark, drop, schema), out, ck, order="at")
    spark.createDataFrame([("m", "data_edit", str(k), 0, 2) for k in range(4, 9)] * 2, schema).coalesce(1).write.mode("append").json(drop)
    for _ in range(2):  # the second run from the same checkpoint adds nothing
        results.stream_new_results(results.read_stream(spark, drop, schema), out, ck, order="at")
        got = results.stored_results(spark, out, schema)
        assert sorted(values(got, "sample", "at")) == [(str(k), 1 if k < 6 else 2) for k in range(9)]
    board = results.running_leaderboard(results.read_stream(spark, drop, schema), str(tmp_path / "board"), str(tmp_path / "ck2"), order="at")
    assert values(board, "n", "executable") == [(9, 7)]  # of sample 5 the record without errors replaces the one with an error
    # a record without an error count is evaluated anew
    spark.createDataFrame([("m", "data_edit", "9", None, 3)], schema).coalesce(1).write.mode("append").json(drop)
    results.stream_new_results(results.read_stream(spark, drop, schema), out, ck, order="at")
    spark.createDataFrame([("m", "data_edit", "9", 1, 4), ("m", "data_edit", "0", 5, 4)], schema).coalesce(1).write.mode("append").json(drop)
    results.stream_new_results(results.read_stream(spark, drop, schema), out, ck, order="at")
    got = {k: (n, at) for k, n, at in values(results.stored_results(spark, out, schema), "sample", "error_count", "at")}
    assert got["9"] == (1, 4) and got["0"] == (0, 1) and len(got) == 10


def test_transfer_pairs(spark):
    df = spark.range(50).withColumnRenamed("id", "sample")
    a = sorted(values(synthesis.sample_transfer_pairs(df), "sample", "to_sample"))
    b = sorted(values(synthesis.sample_transfer_pairs(df.repartition(7)), "sample", "to_sample"))
    assert a == b and all(x != y for x, y in a) and len(a) > 120
    per = collections.Counter(x for x, _ in a)
    assert len(set(a)) == len(a) and set(per.values()) <= {2, 3} and len(per) == 50
    assert synthesis.sample_transfer_pairs(df.limit(0)).count() == 0 == synthesis.sample_transfer_pairs(df.limit(2)).count()
    assert synthesis.sample_transfer_pairs(df.limit(3)).count() == 6  # each draws all three, itself among them


def test_fences_and_option_values(spark):
    """As upstream: stripped first, only html and json fences are known, numbers in options stay numbers."""
    import json

    from plotgauge.functions.text import strip_code_fences
    from plotgauge.operators.chains import base_options, chain_options

    given = ["\n```html\n<p>x</p>\n```\n", "```javascript\nf()\n```", "\u3000```json {} ```\xa0", "```x```", "plain ", "``` ```"]
    df = spark.createDataFrame([(x,) for x in given], "t string")
    assert [r[0] for r in df.select(strip_code_fences(F.col("t"))).collect()] == ["<p>x</p>", "javascript\nf()", "{}", "x", "plain", ""]
    options = {r["step"]: json.loads(r["option"]) for r in chain_options(base_options(spark.range(1).withColumnRenamed("id", "chart_id"))).collect()}
    assert [options[k]["title"][x] for k, x in ((0, "top"), (1, "top"), (1, "left"), (9, "left"), (9, "top"))] == [8, 10, "center", 30, 10]
    assert options[0]["legend"] == {"top": 8, "left": "center"} and options[2]["legend"] == {"left": "center", "bottom": 10, "orient": "horizontal"}
    assert options[10]["legend"] == {"top": "middle", "right": 12, "orient": "vertical"}


def test_sample_order_over_ranges(spark):
    names = [str(k * 7919 % 1000) for k in range(400)] + [f"s{k * 31 % 500}" for k in range(200)] + ["7", "7", "007"]
    key = lambda n: (0, int(n), n) if n.isdigit() else (1, 0, n)
    got = readers.sample_order(spark.createDataFrame([(n,) for n in names], "sample string"))
    assert sorted(values(got, "position", "sample")) == list(enumerate(sorted(set(names), key=key)))
    assert readers.sample_order(spark.createDataFrame([], "sample string")).count() == 0


def test_image_messages_are_one_line(spark):
    """Base64 of any length has no line breaks, as SQL gives it; no image gives none."""
    import base64

    images = [bytes(range(256)) * k for k in range(3)] + [b"x" * 57, b"x" * 58, None]
    df = spark.createDataFrame(list(enumerate(images)), "k long, image binary")
    found = df.select("k", parsing.image_message(F.lit("Look."), F.col("image"))[0]["content"][1]["value"].alias("url")).collect()
    assert {r.k: r.url for r in found} == {k: "data:image/png;base64," + base64.b64encode(v or b"").decode() for k, v in enumerate(images)}


def test_an_option_is_parsed_once(spark):
    """Every field of the signature, its series too, reads one parsed value; whether a text is JSON takes one parse."""
    options = spark.createDataFrame([("{}",)], "option string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    signature = plan(chains.semantic_signature(options))
    assert signature.count("parse_json") + signature.count("parseJson") == 1 and "from_json" not in signature and "get_json_object" not in signature
    assert plan(options.select(X.valid_json(F.col("option")).isNotNull().alias("ok"))).count("arseJson") <= 1


def test_series_of_any_form(spark):
    """A list, one object without brackets, none, and no JSON."""
    one = '{"name":"A","type":"bar","label":{"show":true,"position":"top"},"itemStyle":{"borderRadius":[6, 6,0,0]},"barWidth":22}'
    texts = ['{"series":[%s,{"type":"line","name":"B","lineStyle":{"width":3},"symbolSize":10}],"color":["#1", "#2"]}' % one, '{"series":%s,"color":"red"}' % one, "{}", "no"]
    got = values(chains.semantic_signature(spark.createDataFrame([(t,) for t in texts], "option string").coalesce(1)), "labels_signature", "series_style", "palette")
    assert got == [("bar|true|top;line|false|-", "A|[6,6,0,0]|22/B|3|10", '["#1","#2"]'), ("bar|true|top", "A|[6,6,0,0]|22/", "red"), (None, None, None), (None, None, None)]


def test_texts_with_equal_partners_are_not_compared():
    """Only what has no equal partner is compared, and the result is that of the whole assignment."""
    memo = text_match.Similarities()
    words = [f"word{k}" for k in range(12)]
    assert text_match.fuzzy_f1(words, words[::-1], memo=memo) == 1.0 and not memo.known
    assert text_match.fuzzy_f1(words, [*words[3:], "word0x"], memo=memo) == 20 / 22 and set(memo.known) == {"word0x"}
    rng = random.Random(8)
    for _ in range(500):
        ref, gen = ([rng.choice(["ab", "abc", "abcd", "bcd", "x", "xy", "q"]) for _ in range(rng.randint(1, 5))] for _ in range(2))
        few, many = sorted((ref, gen), key=len)
        ratio = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if few is ref else (lambda a, b: SequenceMatcher(None, b, a).ratio())
        sums = [[ratio(a, b) for a, b in zip(few, other)] for other in itertools.permutations(many, len(few))]
        most = max(map(sum, sums))
        hits = {sum(v >= 0.85 for v in one) for one in sums if sum(one) > most - 1e-9}
        assert round(text_match.fuzzy_f1(ref, gen) * (len(ref) + len(gen)) / 2) in hits


def test_pairing_groups_once(spark):
    """Both sides travel in one shuffle, without a join."""
    side = lambda rows: spark.createDataFrame(rows, "image long, pos long, text string")
    both = parsing.pair_ref_gen(side([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")]), side([(1, 1, "z"), (3, 1, "y")]))
    assert sorted(values(both, "image", "ref", "gen")) == [(1, ["a", "b"], ["z"]), (2, ["c"], []), (3, [], ["y"])]
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_signature_of_typed_options(spark):
    """Structs and their JSON texts have one signature, field by field; a struct isn't written as text and parsed again."""
    charts = chains.base_options(spark.range(10).withColumnRenamed("id", "chart_id"))
    kept = chains.semantic_signature(chains.chain_options(charts, text=False))
    text = chains.semantic_signature(chains.chain_options(charts))
    assert kept.columns == text.columns
    want = ["chart_id", "step", *chains.FIELDS]
    assert sorted(map(tuple, kept.select(want).collect()), key=repr) == sorted(map(tuple, text.select(want).collect()), key=repr)
    plan = kept.select("series_style")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "structstojson" not in plan and "parse" not in plan and "base chart" not in plan
    one = "struct<title:struct<text:string>,series:array<struct<name:string,type:string,barWidth:int>>,color:array<string>>"
    odd = spark.createDataFrame([(1, (("a",), [("n", "bar", 3), (None, "line", None)], ["red"])), (2, (None, None, None)), (3, None)], f"k int, option {one}")
    a, b = chains.semantic_signature(odd), chains.semantic_signature(odd.withColumn("option", F.to_json("option")))
    assert sorted(map(tuple, a.select("k", *chains.FIELDS).collect())) == sorted(map(tuple, b.select("k", *chains.FIELDS).collect()))


def test_edit_chains_never_pass_through_the_driver(spark, monkeypatch):
    """However small their files are, signatures are not broadcast; options of all steps come from one scan; all that the job returns reads the scored steps."""
    from plotgauge.plans import jobs

    reference = chains.chain_options(chains.base_options(spark.range(4).withColumnRenamed("id", "chart_id")))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Union" not in plan(reference)
    sig = chains.semantic_signature(reference)
    assert "SortMergeJoin" in plan(chains.field_fidelity(sig, sig)) and "Broadcast" not in plan(chains.field_fidelity(sig, sig))
    # chart 1 has no answer to step 3, chart 2's fifth doesn't render, chart 3's eighth holds no JSON, its second is the option of step 1
    wrong = reference.where("chart_id = 3 AND step = 1").withColumn("step", F.lit(2).cast("long"))
    given = reference.where("step > 0 AND NOT (chart_id = 1 AND step = 3) AND NOT (chart_id = 3 AND step = 2)").unionByName(wrong)
    raw = F.when(F.expr("chart_id = 3 AND step = 8"), "no").otherwise(F.col("option"))
    answers = given.select("chart_id", "step", raw.alias("raw"), F.expr("IF(chart_id = 2 AND step = 5, CAST(NULL AS BOOLEAN), true)").alias("rendered"))
    seen = []
    monkeypatch.setattr(jobs, "settle", lambda df, name: seen.append(df) or writers.settle(df, name))
    found = jobs.edit_chains(reference, answers)
    assert len(seen) == 1 and "SortMergeJoin" in plan(seen[0]) and "Broadcast" not in plan(seen[0])
    assert not any("Join" in plan(df) for df in found.values())
    ends = {1: 3, 2: 5, 3: 8}
    got = {(r.chart_id, r.step): (r.render_ok, r.exact_match, r.field_fidelity) for r in found["chain"].collect()}
    want = {(c, k): (True, True, 1.0) if k < ends.get(c, 11) else (False, False, 0.0) for c in range(4) for k in range(1, 11)}
    assert got == want | {(3, 2): (True, False, 0.5)}
    assert dict(values(found["collapse"], "step", "n")) == {"3": 1, "5": 1, "8": 1, "no_hard_crash": 1}
