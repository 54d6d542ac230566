"""The linear model of visual complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import minmax

# Feature, coefficient, and the range of the training data.
MODEL = (
    ("O.IE", -0.01834083350272347, 0.476, 7.907),
    ("O.KC", 0.04488392108694385, 12852.0, 1347415.0),
    ("O.SE", -0.07812757866733533, 0.553, 5.018),
    ("O.IG", -0.023242033320288135, 0.125, 5.733),
    ("O.FC", 0.07676352678377832, 1.344, 15.034),
    ("O.H", -0.01635709868916849, -0.966, -0.029),
    ("O.CF", -0.017157431473661798, 14.81, 198.294),
    ("O.ERGB", 0.05797202879115276, 0.675, 17.626),
    ("O.ED", 0.3586739664156308, 0.002, 0.361),
    ("O.FP", 0.23737305932973007, 0.0, 593.0),
    ("O.TiR", -0.12420658618219266, 0.0, 0.778),
    ("O.MeC", 0.2811719690502859, 1.0, 43.0),
)
#: Value of the one feature that is a constant upstream.
CONSTANT_FEATURES = {"O.FC": 5.0}


def model_table(spark: SparkSession) -> DataFrame:
    """(i, feature, coefficient, low, high)."""
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(f).alias("feature"), F.lit(c).alias("coefficient"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for i, (f, c, lo, hi) in enumerate(MODEL)])
    return spark.range(1).select(F.explode(rows).alias("_m")).select("_m.*")


def minmax_normalize(features: DataFrame, model: DataFrame) -> DataFrame:
    """Add `norm` to rows (image, feature, value)."""
    return features.join(F.broadcast(model), "feature").withColumn("norm", minmax(F.col("value"), F.col("low"), F.col("high")))


def apply_coefficients(features: DataFrame, model: DataFrame) -> DataFrame:
    """(image, feature, value, coefficient, norm) for every feature of the model, twelve rows an image; an absent one takes its training minimum."""
    images = features.select("image").distinct().crossJoin(F.broadcast(model))
    full = images.join(features.select("image", "feature", "value"), ["image", "feature"], "left").withColumn("value", F.coalesce("value", "low"))
    return full.withColumn("norm", minmax(F.col("value"), F.col("low"), F.col("high"))).select("image", "feature", "value", "coefficient", "norm")


def complexity_score(features: DataFrame, model: DataFrame) -> DataFrame:
    return apply_coefficients(features, model).groupBy("image").agg(F.sum(F.col("coefficient") * F.col("norm")).alias("score")).withColumn("percent", F.col("score") * 100)


def attach_features(images: DataFrame, features: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Feature columns onto a list of images, whose rows all stay."""
    names = names or tuple(f for f, *_ in MODEL)
    wide = features.groupBy("image").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f.replace(".", "_")) for f in names])
    return images.join(wide, "image", "left")


def text_ink_ratio(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, ratio): text boxes' area over the image's, overlaps twice, two decimals; 0 without boxes."""
    area = boxes.groupBy("image").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("_a"))
    return sizes.join(area, "image", "left").select("image", F.bround(F.coalesce("_a", F.lit(0)) / (F.col("width") * F.col("height")), 2).alias("ratio"))
