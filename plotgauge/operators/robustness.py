"""How stable rankings are when the score's weights move."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson
from .scoring import BASE_WEIGHTS

AMPLITUDES = (0.03, 0.05, 0.1, 0.2)
FLOOR = 1e-8


def perturbed_weights(spark: SparkSession, samples: int = 1000, amplitudes: tuple[float, ...] = AMPLITUDES, seed: int = 7) -> DataFrame:
    """(amplitude, idx, metric, w): base weights moved by up to the amplitude, floored and scaled to sum 1. The draws are hashes of
    (seed, amplitude's number, idx, metric), so every run has the same."""
    levels = F.explode(F.array(*[F.struct(F.lit(str(k + 1)).alias("k"), F.lit(a).alias("amplitude")) for k, a in enumerate(amplitudes)]))
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("base")) for m, w in BASE_WEIGHTS.items()]))
    rows = spark.range(samples).withColumnRenamed("id", "idx").withColumn("_l", levels).withColumn("_m", metrics)
    key = F.concat(F.lit(f"{seed}:"), "_l.k", F.lit(":"), F.col("idx").cast("string"), F.lit(":"), "_m.metric")
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    raw = F.greatest(F.col("_m.base") + (2 * u - 1) * F.col("_l.amplitude"), F.lit(FLOOR))
    rows = rows.select(F.col("_l.amplitude").alias("amplitude"), "idx", F.col("_m.metric").alias("metric"), raw.alias("raw"))
    return rows.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("amplitude", "idx"))).drop("raw")


def wide_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("amplitude", "idx").agg(*[F.max(F.when(F.col("metric") == m, F.col("w"))).alias(f"w_{m}") for m in BASE_WEIGHTS])


def cross_weights(means: DataFrame, weights: DataFrame) -> DataFrame:
    """Every model and task under every weight vector. `means` has one row for each model and task, so the cross join
    is over aggregates, and neither side grows with the number of samples evaluated."""
    score = sum((F.col(m) * F.col(f"w_{m}") for m in BASE_WEIGHTS), F.lit(0.0))
    return means.crossJoin(wide_weights(weights)).select("amplitude", "idx", "task", "model", F.round(F.col("r_exec") * score, 9).alias("score"))


def spearman(base: DataFrame, scores: DataFrame) -> DataFrame:
    """(amplitude, idx, task, spearman): correlation of average ranks with the base ranking (task, model, score)."""
    b = base.select("task", "model", average_rank("score", ["task"]).alias("_x"))
    p = scores.withColumn("_y", average_rank("score", ["amplitude", "idx", "task"]))
    return p.join(b, ["task", "model"]).groupBy("amplitude", "idx", "task").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pearson("_x", "_y"))).alias("spearman"))


def kendall_tau_b(base: DataFrame, scores: DataFrame) -> DataFrame:
    """(amplitude, idx, task, kendall): concordant less discordant pairs over the pairs untied on either side."""
    x, y = base.select("task", F.col("model").alias("_a"), F.col("score").alias("_sa")), base.select("task", F.col("model").alias("_b"), F.col("score").alias("_sb"))
    signs = x.join(y, "task").where("_a < _b").select("task", "_a", "_b", F.signum(F.col("_sa") - F.col("_sb")).alias("_x"))
    keys = ["amplitude", "idx", "task"]
    grouped = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "score"))).alias("_s"))  # a task's models, a few dozen
    pairs = grouped.join(signs, "task").select(*keys, "_x", F.signum(F.col("_s")[F.col("_a")] - F.col("_s")[F.col("_b")]).alias("_y"))
    untied = F.sqrt(F.sum(F.abs("_x")) * F.sum(F.abs("_y")))
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), untied).alias("kendall"))


def robustness_summary(corrs: DataFrame, value: str) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum for each amplitude and task, and over all tasks (`all`)."""
    stats = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    per_task = corrs.groupBy("amplitude", "task").agg(*stats)
    return per_task.unionByName(corrs.groupBy("amplitude").agg(*stats).withColumn("task", F.lit("all")).select("amplitude", "task", "mean", "std", "min", "max"))


def worst_perturbation(rho: DataFrame, tau: DataFrame) -> DataFrame:
    """For each amplitude the weight vector of lowest mean Spearman over tasks; the first of equals."""
    both = rho.join(tau, ["amplitude", "idx", "task"]).groupBy("amplitude", "idx").agg(F.round(F.avg("spearman"), 9).alias("mean_spearman"), F.round(F.avg("kendall"), 9).alias("mean_kendall"))
    return both.groupBy("amplitude").agg(F.min_by(F.struct("idx", "mean_spearman", "mean_kendall"), F.struct("mean_spearman", "idx")).alias("_w")).select("amplitude", "_w.*")
