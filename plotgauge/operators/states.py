"""Multi-state charts: which states are looked at, how failures pile up over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.85, 0.90)
PREFIXES = (1, 2, 3, 5)


def state_anchors(samples: DataFrame, length: str = "data_len", least: int = 5) -> DataFrame:
    """(…, position, data_index): first two, middle and last two items of each sample that has five different ones of them."""
    n = F.col(length)
    anchors = F.array_distinct(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.floor(n / 2).cast("long"), n - 2, n - 1))
    kept = samples.where(n >= least).withColumn("_a", anchors).where(F.size("_a") == 5)
    return kept.select(*samples.columns, F.posexplode("_a").alias("_p", "data_index")).withColumn("position", F.col("_p").cast("long")).drop("_p")


def align_states(wanted: DataFrame, ref: DataFrame, gen: DataFrame, text: str = "tooltip") -> DataFrame:
    """The wanted states with both sides' texts; an absent state has an empty one."""
    keys = ["sample", "data_index"]
    side = lambda df, name: df.select(*keys, F.col(text).alias(name))
    out = wanted.join(side(ref, "ref_text"), keys, "left").join(side(gen, "gen_text"), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ref_text", "gen_text")})


def align_pictures(wanted: DataFrame, ref: DataFrame, gen: DataFrame) -> DataFrame:
    """The wanted states with both sides' pictures (sample, data_index, picture, width); an absent one is null. Pictures of other states are left out before any is shuffled, where Spark can send the wanted keys around."""
    keys = ["sample", "data_index"]
    side = lambda df, name: df.join(wanted.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("picture").alias(name), F.col("width").alias(f"{name}_width"))
    return wanted.join(side(ref, "ref_picture"), keys, "left").join(side(gen, "gen_picture"), keys, "left")


def pass_flags(states: DataFrame, thresholds=THRESHOLDS, value: str = "sim") -> DataFrame:
    """Each state under each threshold: `passed`, and `all_so_far`."""
    levels = F.explode(F.array(*map(F.lit, thresholds)))
    rows = states.withColumn("threshold", levels).withColumn("passed", F.col(value) >= F.col("threshold"))
    w = Window.partitionBy("threshold", "sample").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("all_so_far", F.min("passed").over(w))


def fail_at_k(flags: DataFrame, ks=PREFIXES) -> DataFrame:
    """(threshold, k, fail_at, delta): share of samples that fail within their first k states, and how much more than at the k before."""
    wide = flags.groupBy("threshold", "sample").agg(*[F.coalesce(F.min(F.when(F.col("position") < k, F.col("all_so_far"))), F.lit(True)).alias(f"_k{k}") for k in ks])
    rates = wide.groupBy("threshold").agg(*[F.round(F.avg(F.when(F.col(f"_k{k}"), 0.0).otherwise(1.0)), 4).alias(f"_k{k}") for k in ks])
    long = rates.select("threshold", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_k{k}").alias("fail_at")) for k in ks])).alias("_r")).select("threshold", "_r.*")
    before = F.lag("fail_at").over(Window.partitionBy("threshold").orderBy("k"))
    return long.withColumn("delta", F.round(F.col("fail_at") - before, 4))


def core_predicts_later(flags: DataFrame) -> DataFrame:
    """By threshold: how many samples fail, or pass, both of the first two states, and the share of them whose later states all do the same; null if none."""
    core, later = F.col("position") < 2, F.col("position") >= 2
    one = flags.groupBy("threshold", "sample").agg(
        F.sum(F.when(core, 1).otherwise(0)).alias("_n"),
        F.bool_and(F.when(core, F.col("passed"))).alias("_cp"),
        F.bool_or(F.when(core, F.col("passed"))).alias("_cf"),
        F.coalesce(F.bool_and(F.when(later, F.col("passed"))), F.lit(True)).alias("_lp"),
        F.coalesce(F.bool_or(F.when(later, F.col("passed"))), F.lit(False)).alias("_lf"),
    )
    fail, good = (F.col("_n") == 2) & ~F.col("_cf"), (F.col("_n") == 2) & F.col("_cp")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return one.groupBy("threshold").agg(
        count(fail).alias("core_fail"),
        count(good).alias("core_pass"),
        F.round(F.try_divide(count(fail & ~F.col("_lf")), count(fail)), 4).alias("later_fail"),
        F.round(F.try_divide(count(good & F.col("_lp")), count(good)), 4).alias("later_pass"),
    )


def balanced_selection(flags: DataFrame, limit: int = 50, threshold: float = 0.85, order: str = "sample", buckets: int = 64) -> DataFrame:
    """(sample, cls, place): the first limit/2 samples that fail both first states, then as many that pass both; mixed ones are left out.

    A first cut inside buckets of samples keeps each task's rows few before the two classes meet in one task each.
    """
    core = flags.where((F.col("threshold") == threshold) & (F.col("position") < 2)).groupBy("sample").agg(F.bool_and("passed").alias("_a"), F.bool_or("passed").alias("_o"), F.count(F.lit(1)).alias("_n"))
    cls = F.when(~F.col("_o"), "fail").when(F.col("_a"), "pass")
    rows = core.where("_n = 2").withColumn("cls", cls).where(F.col("cls").isNotNull()).withColumn("_b", F.pmod(F.xxhash64("sample"), F.lit(buckets)))
    half = limit // 2
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("cls", "_b").orderBy(order))).where(F.col("_r") <= half)
    place = F.row_number().over(Window.partitionBy("cls").orderBy(order)).cast("long")
    return first.withColumn("place", place).where(F.col("place") <= half).select("sample", "cls", "place")


def tooltip_pick(nodes: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """(key, tooltip, candidates): the longest non-empty text of a page's nodes, and the longest five."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length(text)), text)
    rows = nodes.where(F.trim(text) != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return rows.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(text))).alias("tooltip"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda t: t[text]), "|").alias("candidates"))
