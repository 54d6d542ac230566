"""Features of pixel tables: entropies, colourfulness, co-occurrence."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.writers import settle

LEVELS = 32
#: Neighbour directions (dy, dx) with their weights: eight angles at distance 1 fall onto these four.
DIRECTIONS = ((0, 1, 3), (1, 1, 1), (1, 0, 3), (1, -1, 1))


def _log2(c):
    return F.log2(c)


def gray_entropy(gray: DataFrame, value: str = "c") -> DataFrame:
    """(image, entropy): Shannon bits of the histogram of one channel."""
    counts = gray.groupBy("image", value).agg(F.count(F.lit(1)).alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy("image"))
    return counts.withColumn("_p", p).groupBy("image").agg((-F.sum(F.col("_p") * _log2(F.col("_p")))).alias("entropy"))


def rgb_entropy(pixels: DataFrame) -> DataFrame:
    """(image, entropy): of the joint colour histogram as a density over 256 bins of 255/256 on each axis."""
    counts = pixels.groupBy("image", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("_n"))
    density = F.col("_n") / (F.sum("_n").over(Window.partitionBy("image")) * (255.0 / 256.0) ** 3)
    return counts.withColumn("_d", density).groupBy("image").agg((-F.sum(F.col("_d") * _log2(F.col("_d")))).alias("entropy"))


def colorfulness(pixels: DataFrame) -> DataFrame:
    """(image, colorfulness), with the wrap of 8-bit sums and differences."""
    rg = F.pmod(F.col("c0") - F.col("c1"), F.lit(256)).cast("double")
    yb = F.abs(F.pmod(F.col("c0") + F.col("c1"), F.lit(256)) * 0.5 - F.col("c2"))
    means = pixels.select("image", rg.alias("rg"), yb.alias("yb")).groupBy("image").agg(*[f(c).alias(n) for c in ("rg", "yb") for f, n in ((F.var_pop, f"v{c}"), (F.avg, f"m{c}"))])
    return means.select("image", (F.sqrt(F.col("vrg") + F.col("vyb")) + 0.3 * F.sqrt(F.col("mrg") * F.col("mrg") + F.col("myb") * F.col("myb"))).alias("colorfulness"))


def below_pixel(pixels: DataFrame, value: str) -> DataFrame:
    """Add `below`: the value of the next pixel in the same column; null in the last row."""
    return pixels.withColumn("below", F.lead(value).over(Window.partitionBy("image", "x").orderBy("y")))


def transition_complexity(pixels: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(image, complexity): how uncertain the colour below is, given a pixel's quantised colour."""
    step = 256 // levels
    q = lambda c: F.floor(F.col(c) / step)
    rows = below_pixel(pixels.withColumn("_q", q("c0") * levels * levels + q("c1") * levels + q("c2")), "_q")
    total = F.sum("_n").over(Window.partitionBy("image"))
    own = F.sum("_n").over(Window.partitionBy("image", "_q"))
    counts = rows.groupBy("image", "_q", "below").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_j": F.col("_n") / total, "_p": own / total})
    bits = F.when(F.col("below").isNotNull(), F.col("_j") * _log2(F.col("_j") / F.col("_p"))).otherwise(0.0)
    return counts.groupBy("image").agg((-F.sum(bits)).alias("complexity"))


_GLCM = ("contrast", "dissimilarity", "heterogeneity", "energy", "correlation")


def _glcm(image: np.ndarray, y: np.ndarray, x: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The five features of n images' pixels, and which images have any neighbours. Neighbours are found by place, counted by image and values."""
    y, x = y - y.min(), x - x.min()
    width, height = int(x.max()) + 2, int(y.max()) + 2
    place = (image * height + y) * width + x + 1  # the places left and right of a line, and below an image, stay empty
    order = np.argsort(place)
    place, image = place[order], image[order]
    known, value = np.unique(c[order], return_inverse=True)
    size = len(known)
    sums, weights = np.zeros((5, n)), np.zeros(n)
    for dy, dx, w in DIRECTIONS:
        other = place + dy * width + dx
        at = np.minimum(np.searchsorted(place, other), len(place) - 1)
        met = np.flatnonzero(place[at] == other)
        a, b, own = value[met], value[at[met]], image[met] * size * size
        pair, count = np.unique(np.concatenate([own + a * size + b, own + b * size + a]), return_counts=True)
        of, i, j = pair // (size * size), known[pair // size % size].astype(float), known[pair % size].astype(float)
        by_image = lambda v: np.bincount(of, v, n)  # noqa: E731, B023
        total = by_image(count)
        p, d = count / total[of], i - j  # noqa: E741
        mu, ii, ij = by_image(p * i), by_image(p * i * i), by_image(p * i * j)
        spread = ii - mu * mu
        alike = np.divide(ij - mu * mu, spread, out=np.ones(n), where=spread > 1e-9)
        some = total > 0
        sums += w * some * np.array([by_image(p * d * d), by_image(p * abs(d)), -by_image(p / (1 + d * d)), np.sqrt(by_image(p * p)), alike])
        weights += w * some
    return sums / np.maximum(weights, 1), weights > 0


def glcm_features(gray: DataFrame) -> DataFrame:
    """(image, contrast, dissimilarity, heterogeneity, energy, correlation) of symmetric, normed co-occurrence, averaged over eight angles; images without neighbours are left out.

    Pixels are shuffled once, by image. An image's pixels are one value then, and a batch of images is counted at once inside the task, so
    that no task holds a table of all its images' pairs.
    """
    kind = T.StructType([T.StructField(f, T.DoubleType()) for f in _GLCM])

    @F.arrow_udf(kind)
    def run(images: pa.Array) -> pa.Array:
        own, flat = np.repeat(np.arange(len(images)), pc.list_value_length(images).to_numpy(zero_copy_only=False)), images.flatten()
        if not len(flat):
            return pa.nulls(len(images), to_arrow_type(kind))
        found, some = _glcm(own, *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)), len(images))
        return pa.StructArray.from_arrays([pa.array(v) for v in found], names=list(_GLCM), mask=pa.array(~some))

    whole = F.collect_list(F.struct("y", "x", "c")).alias("_pixels")
    pixels = gray.select("image", "y", "x", "c").where("y IS NOT NULL AND x IS NOT NULL AND c IS NOT NULL")
    rows = pixels.repartition("image").groupBy("image").agg(whole)
    return rows.select("image", run("_pixels").alias("_f")).where("_f IS NOT NULL").select("image", "_f.*")


def _ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two equal-sized arrays in 0..1 over uniform windows inside the border."""

    def mean(x):
        c = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return (c[window:, window:] - c[:-window, window:] - c[window:, :-window] + c[:-window, :-window]) / window**2

    n = window * window
    ma, mb = mean(a), mean(b)
    va, vb, vab = ((mean(x * y) - m) * n / (n - 1) for x, y, m in ((a, a, ma * ma), (b, b, mb * mb), (a, b, ma * mb)))
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def image_ssim(pairs: DataFrame, a: str = "a", b: str = "b", width: str = "width") -> DataFrame:
    """Add `ssim`, four decimals, for two gray images given by row as arrays of values in 0..1. 0 for arrays of unequal size or too small."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, y, n in zip(left, right, w):
            if x is None or y is None or len(x) != len(y) or not n >= 7 or len(x) < 7 * n or len(x) % n:
                out.append(0.0)
            else:
                out.append(round(_ssim(np.asarray(x, float).reshape(-1, n), np.asarray(y, float).reshape(-1, n)), 4))
        return pd.Series(out, dtype=float)

    return pairs.withColumn("ssim", score(a, b, width))


def _around(cx: str, cy: str):
    """A cell and the eight around it."""
    return F.explode(F.array(*[F.struct((F.col(cx) + i).alias("cx"), (F.col(cy) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def kept_points(points: DataFrame, r: int = 10, most_rounds: int = 10_000) -> DataFrame:
    """(image, x, y, response) of the points that stay when the strongest goes first and drops all others within r of it in both axes.

    Points are stronger by response, then by smaller x, then by smaller y; equal points count once, points without a place or an
    image are left out, and a null response is the weakest. They lie in cells of side r, so that only points of nine
    cells can drop each other. In every round the strongest of its nine cells is kept and drops its neighbours, until no point is open: nothing
    that is stronger and near can be open then, so the points kept are those of the one-by-one rule. A cell is a group, an image or
    a part of the plane isn't; what a round sends around is a row for each cell and the points kept. Rounds are written.
    """
    rank = F.struct(F.coalesce(F.col("response").cast("double"), F.lit(float("-inf"))).alias("response"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))
    cell = lambda c: F.floor(F.col(c) / max(r, 1)).cast("long")
    points = points.where("image IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    given = points.groupBy("image", "x", "y").agg(F.max(F.coalesce(F.col("response").cast("double"), F.lit(float("-inf")))).alias("response"))
    left = settle(given.select("image", "x", "y", "response", rank.alias("rank"), cell("x").alias("cx"), cell("y").alias("cy")), "open-points")
    done = []
    for _ in range(most_rounds):
        strongest = left.groupBy("image", "cx", "cy").agg(F.max("rank").alias("rank"))
        best = strongest.select("image", "rank", _around("cx", "cy").alias("_c")).groupBy("image", "_c.cx", "_c.cy").agg(F.max("rank").alias("best"))
        keep = settle(left.join(best, ["image", "cx", "cy"]).where("rank = best").drop("best"), "kept-points")
        if keep.limit(1).count() == 0:
            break
        done.append(keep.select("image", "x", "y", "response"))
        near = keep.select("image", F.col("x").alias("kx"), F.col("y").alias("ky"), _around("cx", "cy").alias("_c")).select("image", "kx", "ky", "_c.cx", "_c.cy")
        hit = (F.abs(F.col("x") - F.col("kx")) <= r) & (F.abs(F.col("y") - F.col("ky")) <= r)
        gone = left.join(near, ["image", "cx", "cy"]).where(hit).select("image", "x", "y").distinct()
        left = settle(left.join(gone, ["image", "x", "y"], "left_anti"), "open-points")
    else:
        raise RuntimeError("points did not settle")
    return reduce(DataFrame.unionByName, done) if done else left.select("image", "x", "y", "response")


def suppress_points(points: DataFrame, r: int = 10) -> DataFrame:
    """(image, n_points): strongest first, points within r of a kept one in both axes are dropped."""
    return kept_points(points, r).groupBy("image").agg(F.count(F.lit(1)).alias("n_points"))


def compressed_size(df: DataFrame, data: str, out: str = "size") -> DataFrame:
    """Add the length of a binary column's values after compression at level 11; null for null."""

    @F.pandas_udf("long")
    def length(values: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=11)
        return pd.Series([None if v is None else len(z.compress(bytes(v))) for v in values], dtype="Int64")

    return df.withColumn(out, length(data))
