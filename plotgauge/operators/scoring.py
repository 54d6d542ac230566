"""From evaluation records to composite scores and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, clip_judge

# Weights of the published composite score.
BASE_WEIGHTS = {"data": 0.3, "text": 0.2, "vis": 0.2, "style": 0.15, "color": 0.15}
#: A task whose pages fetch a file that the sandbox lacks, so one error is expected.
FETCHING_TASK = "data_update"
SKIPPED_TASKS = ("chart_mimic", "high_complex")


def executability(records: DataFrame) -> DataFrame:
    """Add `errors` (expected ones taken off) and `executable`. A record without a count, as the gate leaves it, isn't executable."""
    errors = F.when(F.col("task") == FETCHING_TASK, F.col("error_count") - 1).otherwise(F.col("error_count"))
    return records.withColumn("errors", errors).withColumn("executable", F.coalesce(F.col("errors") <= 0, F.lit(False)))


def select_runs(records: DataFrame, models: list[str] | None = None, skip_tasks: tuple[str, ...] = SKIPPED_TASKS) -> DataFrame:
    kept = records.where(~F.col("task").isin(*skip_tasks))
    return kept.where(F.col("model").isin(*models)) if models else kept


def gate_fail_record(df: DataFrame, passed: str = "passed") -> DataFrame:
    """Scores of samples whose page didn't pass the gate: zeros, and no error count."""
    out = df
    for c in ("ocr_f1", "color_iou", "judge_overall"):
        out = out.withColumn(c, F.when(F.col(passed), F.col(c)).otherwise(0.0))
    return out.withColumn("error_count", F.when(F.col(passed), F.col("error_count")))


def metric_means(records: DataFrame, exec_mode: str = "rate") -> DataFrame:
    """(model, task, r_exec, data, text, vis, style, color): everything that scores need, one row for each model and task.

    `rate`: the share of executable samples, and means over them. `per_sample`: samples that fail count as zeros in the means.
    """
    r = executability(records)
    parts = {"data": clip_judge(F.col("data_fidelity")), "text": F.col("ocr_f1"), "vis": clip_judge(F.col("visual_logic")), "style": clip_judge(F.col("style")), "color": F.col("color_iou")}
    ok = F.col("executable")
    if exec_mode == "rate":
        rate = F.avg(ok.cast("double"))
        means = [F.coalesce(F.avg(F.when(ok, v)), F.lit(0.0)).alias(k) for k, v in parts.items()]
    else:
        rate = F.lit(1.0)
        means = [F.avg(F.when(ok, v).otherwise(0.0)).alias(k) for k, v in parts.items()]
    return r.groupBy("model", "task").agg(F.max(rate).alias("r_exec") if exec_mode != "rate" else rate.alias("r_exec"), *means)


def composite_score(means: DataFrame, weights: dict[str, float] = BASE_WEIGHTS) -> DataFrame:
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return means.withColumn("score", F.round(F.col("r_exec") * total, 9))


def leaderboard(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Models of each task by score; `place` breaks ties by name, `avg_rank` shares them."""
    order = Window.partitionBy("task").orderBy(F.desc("score"), "model")
    out = scores.select("task", "model", "score", F.row_number().over(order).cast("long").alias("place"), average_rank("score", ["task"]).alias("avg_rank"))
    return out.where(F.col("place") <= top) if top else out


def rank_models(scores: DataFrame) -> DataFrame:
    """Competition rank by score, per task."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("task").orderBy(F.desc("score"))).cast("long"))


def pending(all_keys: DataFrame, done: DataFrame, keys: list[str], retry_gate_failures: bool = True) -> DataFrame:
    """Samples still to be evaluated: those without a stored record, or whose record has no error count and is to be tried again."""
    stored = done.where(F.col("error_count").isNotNull()) if retry_gate_failures else done
    return all_keys.join(stored.select(*keys).distinct(), keys, "left_anti")


def color_iou(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of names; two empty ones agree fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
