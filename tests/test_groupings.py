"""Groupings of colours and points against plain versions, one item after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgauge.operators import colors, pixels


@pytest.fixture(scope="module")
def profile(spark):
    rng = random.Random(3)
    rows = [(i, f"c{k:02d}", rng.randrange(1, 500), *(rng.randrange(0, 256, 3) if i % 3 else rng.randrange(40) for _ in range(3))) for i in range(40) for k in range(rng.randrange(1, 33))]
    rows += [(50, "a", 5, 1, 1, 1), (50, "b", 5, 1, 1, 1)]  # equal colours
    return spark.createDataFrame(rows, "image long, name string, n long, l0 long, l1 long, l2 long").repartition(4)


def by_image(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], []).append(r)
    return out


def test_leader_groups(profile):
    got = {(r["image"], r["name"]): r["leader"] for r in colors.leader_groups(profile).collect()}
    for image, rows in by_image(profile).items():
        leader = None
        for r in sorted(rows, key=lambda r: (r["l0"], r["name"])):
            if leader is None or r["l0"] - leader["l0"] >= 25:
                leader = r
            assert got[image, r["name"]] == leader["name"]
    assert len(got) == profile.count()


@pytest.mark.parametrize("eps", [14, 5, 60])
def test_radius_components(profile, eps):
    got = {(r["image"], r["name"]): r["component"] for r in colors.radius_components(profile, eps).collect()}
    for image, rows in by_image(profile).items():
        label = {r["name"]: r["name"] for r in rows}
        for _ in rows:
            for a in rows:
                for b in rows:
                    if sum((a[x] - b[x]) ** 2 for x in ("l0", "l1", "l2")) <= eps * eps:
                        label[a["name"]] = min(label[a["name"]], label[b["name"]])
        assert {n: got[image, n] for n in label} == label
    assert len(got) == profile.count()


def test_components_of_a_long_chain(spark):
    """A path of 300 colours in one image: labels travel twice as far each round."""
    rows = [(1, f"n{k:03d}", float(13 * ((k * 7) % 300)), 0.0, 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "image long, name string, l0 double, l1 double, l2 double")
    got = colors.radius_components(df, 14, most_rounds=40).select("component").distinct().collect()
    assert [r[0] for r in got] == ["n000"]


def plain_kmeans(rows, k, rounds=50):
    rows = sorted(rows, key=lambda r: (-r["n"], r["name"]))
    x, w = np.array([[r["l0"], r["l1"], r["l2"]] for r in rows], float), np.log1p([float(r["n"]) for r in rows])
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).argmax()]])
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(x[own == c], axis=0, weights=w[own == c]) if (own == c).any() else centres[c] for c in range(len(centres))])
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    weight = np.bincount(own, weights=w, minlength=len(centres))
    return {r["name"]: (int(o), 100 * weight[o] / weight.sum()) for r, o in zip(rows, own)}


@pytest.mark.parametrize("k", [1, 5])
def test_weighted_kmeans(profile, k):
    got = {(r["image"], r["name"]): (r["cluster"], r["share"]) for r in colors.weighted_kmeans(profile, k).collect()}
    for image, rows in by_image(profile).items():
        for name, (cluster, share) in plain_kmeans(rows, k).items():
            assert got[image, name][0] == cluster and abs(got[image, name][1] - share) < 0.0051
    assert len(got) == profile.count()


def plain_kept(points, r):
    kept = []
    for p in sorted(set(points), key=lambda p: (-p[2], p[0], p[1])):
        if all(abs(p[0] - q[0]) > r or abs(p[1] - q[1]) > r for q in kept):
            kept.append(p)
    return sorted(kept)


def test_suppressed_points(spark):
    """Images of all densities, equal responses, one image of half of the points, a staircase in which each point hangs on the one before."""
    rng = random.Random(7)
    given = {i: [(rng.randrange(-20, 20 + 40 * i), rng.randrange(60), float(rng.randrange(1, 20))) for _ in range(60)] for i in range(8)}
    given[9] = [(rng.randrange(400), rng.randrange(300), float(rng.randrange(50))) for _ in range(900)]
    given[10] = [(6 * k, 0, float(100 - k)) for k in range(40)]
    rows = [(i, *p) for i, points in given.items() for p in points] + [(None, 1, 1, 1.0), (11, None, 1, 1.0), (12, 5, 5, None), (12, 6, 6, None), (3, *given[3][0])]
    df = spark.createDataFrame(rows, "image long, x long, y long, response double").repartition(5)
    for r in (10, 3):
        got = {}
        for p in pixels.kept_points(df, r).collect():
            got.setdefault(p["image"], []).append((p["x"], p["y"], p["response"]))
        assert {i: sorted(p) for i, p in got.items() if i != 12} == {i: plain_kept(p, r) for i, p in given.items()}
        assert [p[:2] for p in got[12]] == [(5, 5)]
    assert pixels.kept_points(df.limit(0)).count() == 0


def test_cooccurrence_is_shuffled_once(spark):
    gray = spark.range(2).select(F.col("id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select("image", (F.col("p") / 8).cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), (F.col("p") * 7 % 11).cast("long").alias("c"))
    plan = pixels.glcm_features(gray)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_text_f1_of_parts_and_a_small_memo():
    """Lists in several scripts, with repeats: the greatest sum of similarities, found part by part, with a memo that is forgotten all the time."""
    import itertools
    from difflib import SequenceMatcher

    from plotgauge.operators import text_match

    rng, memo = random.Random(4), text_match.Similarities(limit=500)
    alphabets = ["abc", "xyz", "日本語", "0123"]
    for _ in range(300):
        ref, gen = ([("".join(rng.choice(rng.choice(alphabets[: rng.randrange(1, 5)])) for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(6))] for _ in range(2))
        got = text_match.fuzzy_f1(ref, gen, memo=memo)
        if not ref or not gen:
            assert got == float(not ref and not gen)
            continue
        sim = memo.matrix(ref, gen)
        assert np.allclose(sim, [[SequenceMatcher(None, a, b).ratio() for b in gen] for a in ref])
        wide = sim if len(ref) <= len(gen) else sim.T
        best = {}
        for chosen in itertools.permutations(range(wide.shape[1]), len(wide)):
            values = [wide[i, j] for i, j in enumerate(chosen)]
            best.setdefault(round(sum(values), 9), set()).add(sum(v >= 0.85 for v in values))
        assert round(got * (len(ref) + len(gen)) / 2, 9) in best[max(best)]
        assert memo.held < 500 + 36 * 200
    parts = list(text_match.alike_parts(np.array([[1.0, 0, 0], [0, 0, 0.5], [0, 0, 0]])))
    assert [(r.tolist(), c.tolist()) for r, c in parts] == [([0], [0]), ([1], [2])]


def test_short_ratio():
    from difflib import SequenceMatcher

    from plotgauge.operators import text_match

    rng = random.Random(5)
    for _ in range(30_000):
        a, b = ("".join(rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(text_match.SHORT + 1))) for _ in range(2))
        assert text_match.short_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_cooccurrence_holds_no_pairs(spark):
    """No table of pairs in a task, and images of any form: gaps, one line, one column, one pixel, negative places."""
    rng = random.Random(4)
    images = {k: {(y - k, x - 2): rng.randrange(0, 256, 50) for y in range(h) for x in range(w) if rng.random() < full} for k, (h, w, full) in enumerate([(8, 8, 1), (5, 9, 0.6), (1, 6, 1), (6, 1, 1), (1, 1, 1), (2, 2, 1)])}
    gray = spark.createDataFrame([(k, y, x, c) for k, p in images.items() for (y, x), c in p.items()], "image long, y long, x long, c long").repartition(3)
    found = pixels.glcm_features(gray)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, p in images.items():
        sums, weights = np.zeros(2), 0
        for dy, dx, w in pixels.DIRECTIONS:
            pairs = [(c, p[y + dy, x + dx]) for (y, x), c in p.items() if (y + dy, x + dx) in p]
            pairs += [(b, a) for a, b in pairs]
            if pairs:
                share = np.unique(pairs, axis=0, return_counts=True)[1] / len(pairs)
                sums += w * np.array([np.mean([(a - b) ** 2 for a, b in pairs]), np.sqrt((share**2).sum())])
                weights += w
        if weights:
            want[k] = sums / weights
    got = {r["image"]: (r["contrast"], r["energy"]) for r in found.collect()}
    assert got.keys() == want.keys() and 4 not in got
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_few_images_are_python_objects_at_once():
    """A batch of many images: what Python holds beside the result doesn't grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    kind = pa.list_(pa.struct([("names", pa.list_(pa.string()))]))
    images = pa.array([[{"name": f"color {i} {k}", "n": k} for k in range(20)] for i in range(4000)])
    work = lambda colors: [{"names": [c["name"] for c in colors]}]
    tracemalloc.start()
    out = colors._one_by_one(images, work, kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and out[3999].as_py() == work(images[3999].as_py())
    assert len(colors._one_by_one(images.slice(0, 0), work, kind)) == 0
    assert peak < 4 << 20
