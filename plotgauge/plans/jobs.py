"""The end-to-end jobs, put together from operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_gate, json_block
from ..operators import chains, colors, complexity, parsing, pixels, robustness, scoring, states, synthesis, text_match
from ..sources.writers import settle

KEYS = ["model", "task", "sample"]


def evaluation(samples: DataFrame, detections: DataFrame, profiles: DataFrame, similarity: DataFrame, judged: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Evaluation records of samples (keys, html, error_count) that aren't stored yet.

    detections: (keys, side, pos, text, score); profiles: named colours (image, side, keys, ...) of both images; judged: (keys, raw).
    The sides `ref` and `gen` meet by key; texts of pages are read once, in the gate, and don't travel with the joins.
    """
    keys = KEYS
    gated = samples.select(*keys, html_gate(F.col("html")).alias("passed"), "error_count")
    if done is not None:
        gated = scoring.pending(gated, done, keys)
    key = F.struct(*keys)
    clean = parsing.clean_detections(detections).withColumn("key", key)
    text = text_match.text_f1(parsing.pair_ref_gen(clean.where("side = 'ref'"), clean.where("side = 'gen'"), key="key"), key="key").select("key.*", "ocr_f1")
    named = colors.count_named_colors(profiles.withColumn("image", F.struct(*keys, "side")), similarity).select("image.*", "names")
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("names"))), F.array().cast("array<string>"))
    color = named.groupBy(*keys).agg(side("ref").alias("_r"), side("gen").alias("_g")).select(*keys, scoring.color_iou(F.col("_r"), F.col("_g")).alias("color_iou"))
    judge = parsing.flatten_judge(parsing.parse_judge(judged)).select(*keys, "visual_logic", "data_fidelity", F.col("style_consistency").alias("style"), F.lit(0.0).alias("judge_overall"))
    out = reduce(lambda a, b: a.join(b, keys, "left"), (text, color, judge), gated)
    return scoring.gate_fail_record(out.na.fill(0.0, ["ocr_f1", "color_iou"])).drop("judge_overall")


def ranking(spark: SparkSession, records: DataFrame, samples: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaderboard, robustness summary of both correlations, worst weight vectors). Records are aggregated to one row for
    each model and task before any weight vector meets them."""
    means = scoring.metric_means(records)
    base = scoring.composite_score(means)
    moved = robustness.cross_weights(means, robustness.perturbed_weights(spark, samples))
    rho, tau = robustness.spearman(base, moved), robustness.kendall_tau_b(base, moved)
    summary = robustness.robustness_summary(rho, "spearman").withColumn("measure", F.lit("spearman")).unionByName(robustness.robustness_summary(tau, "kendall").withColumn("measure", F.lit("kendall_tau_b")))
    return scoring.leaderboard(base), summary, robustness.worst_perturbation(rho, tau)


def visual_complexity(spark: SparkSession, pixel_rows: DataFrame, gray: DataFrame, dictionary: DataFrame, similarity: DataFrame, boxes: DataFrame, sizes: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(image, score, percent) from pixels, text boxes and features computed elsewhere, given as (image, feature, value)."""
    long = lambda df, column, name: df.select("image", F.lit(name).alias("feature"), F.col(column).cast("double").alias("value"))
    profile = colors.color_profile(pixel_rows, dictionary)
    parts = [
        long(pixels.gray_entropy(gray), "entropy", "O.IE"),
        long(pixels.rgb_entropy(pixel_rows), "entropy", "O.ERGB"),
        long(pixels.colorfulness(pixel_rows), "colorfulness", "O.CF"),
        long(pixels.transition_complexity(pixel_rows), "complexity", "O.IG"),
        long(pixels.glcm_features(gray), "heterogeneity", "O.H"),
        long(colors.count_named_colors(profile, similarity), "n_colors", "O.MeC"),
        long(complexity.text_ink_ratio(boxes, sizes), "ratio", "O.TiR"),
        *[long(sizes.withColumn("value", F.lit(v)), "value", f) for f, v in complexity.CONSTANT_FEATURES.items()],
    ]
    features = reduce(DataFrame.unionByName, parts + ([given] if given is not None else []))
    return complexity.complexity_score(features, complexity.model_table(spark))


def multi_state(ref: DataFrame, gen: DataFrame, ref_pictures: DataFrame | None = None, gen_pictures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Multi-state charts from both sides' states (sample, data_index, data_len, tooltip): anchors, alignment, similarity of
    tooltips in four decimals, and only then thresholds. An absent state has an empty tooltip.

    With gray pictures of both sides (sample, data_index, picture, width), values by row in 0..1, `states` has their structural similarity `ssim` too: 0
    where a side has no picture, or one of another size.
    """
    wanted = states.state_anchors(ref.groupBy("sample").agg(F.max("data_len").alias("data_len")))
    compared = text_match.text_similarity(states.align_states(wanted, ref, gen), "ref_text", "gen_text", "sim")
    flags = states.pass_flags(compared.select("sample", "position", "sim"))
    if ref_pictures is not None and gen_pictures is not None:
        pairs = states.align_pictures(wanted.select("sample", "data_index"), ref_pictures, gen_pictures)
        same = F.when(F.col("ref_picture_width") == F.col("gen_picture_width"), F.col("gen_picture"))
        seen = pixels.image_ssim(pairs.withColumn("gen_picture", same), "ref_picture", "gen_picture", "ref_picture_width")
        compared = compared.join(seen.select("sample", "data_index", "ssim"), ["sample", "data_index"])
    return {"states": compared, "fail_at": states.fail_at_k(flags), "core": states.core_predicts_later(flags), "selection": states.balanced_selection(flags)}


def edit_chains(reference: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """Edit chains from reference options (chart_id, step, option) and a model's raw answers (chart_id, step, raw, rendered).

    An answer without a JSON block, or that didn't render, ends its chain: this step and all later ones count as failed.
    """
    keys = ["chart_id", "step"]
    read = answers.select(*keys, json_block(F.col("raw")).alias("option"), "rendered")
    ok = F.coalesce(F.col("rendered"), F.lit(False)) & F.col("option").isNotNull()
    read = chains.semantic_signature(read).select(*keys, ok.alias("render_ok"), *chains.FIELDS)
    rows = chains.field_fidelity(chains.semantic_signature(reference), read, how="left", more=("render_ok",)).na.fill({"render_ok": False})
    ok = F.col("render_ok")
    rows = rows.select(*keys, ok, F.when(ok, F.col("field_fidelity")).otherwise(0.0).alias("field_fidelity"), (ok & F.col("exact_match")).alias("exact_match"))
    # options and answers are parsed once: what follows needs the scored steps only
    steps = settle(chains.carry_hard_collapse(rows), "chain")
    return {"chain": steps, "steps": chains.step_summary(steps), "collapse": chains.collapse_distribution(steps), "drift": chains.drift_distribution(steps)}


def synthesis_prompts(samples: DataFrame, done: DataFrame, template: str, slots: dict[str, str], text: str = "html", max_lines: int = 200, first: int = 0) -> DataFrame:
    """(sample, prompt) still to be sent to a model; what comes back goes through ``parsing.validate_generation``."""
    rows = synthesis.take_first_samples(synthesis.line_count_filter(samples, text, max_lines), first)
    rows = rows.join(done.select("sample").distinct(), "sample", "left_anti")
    return synthesis.render_prompts(rows, template, slots).select("sample", "prompt")
