"""Queries that run whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import adapter, table
from ..operators.chains import base_options, chain_options
from ..operators.colors import color_profile
from ..sources.readers import read_model_coefficients, read_prompts
from ..sources.writers import WAVES, write_results
from ..streaming.results import scratch
from . import jobs
from .behaviour_queries import _FAIL, _FIDELITY, ANCHORS
from .registry import query
from .scoring_queries import MEANS, RHO, TAU, USES, WEIGHTS, _summary_sql


@query("job_ranking", MEANS + "," + WEIGHTS.format(n=1000) + "," + RHO + "," + TAU + " SELECT *, 'spearman' AS measure FROM (" + _summary_sql("spearman", "rho") + ") UNION ALL SELECT *, 'kendall_tau_b' FROM (" + _summary_sql("kendall", "tau") + ")", USES)
def job_ranking(spark, d):
    _, summary, _ = jobs.ranking(spark, adapter(spark, d, "eval_records"))
    return summary.select("amplitude", "task", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "measure")


@query("job_complexity")
def job_complexity(spark, d):
    px = adapter(spark, d, "pixels")
    boxes = adapter(spark, d, "detections").select(F.floor(F.col("image") / 1000000000).alias("image"), "x1", "y1", "x2", "y2")  # a document's words on one image
    sizes = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.lit(1200).alias("width"), F.lit(800).alias("height"))
    return jobs.visual_complexity(spark, px, adapter(spark, d, "gray"), adapter(spark, d, "color_dict"), adapter(spark, d, "color_similarity"), boxes, sizes)


@query("job_evaluation")
def job_evaluation(spark, d):
    """Pages as generated files of three models, each with all images of its document's words; embeddings as colours and events as judges' answers of a page's first image."""
    keys = [F.concat(F.lit("m"), (F.col("n") % 3).cast("string")).alias("model"), F.lit("data_edit").alias("task"), F.col("n").cast("string").alias("sample")]
    det = adapter(spark, d, "detections").withColumn("n", F.col("image"))
    images = det.select("n", F.floor(F.col("n") / 1000000000).alias("page_id")).distinct()
    samples = table(spark, d, "pages").join(images, "page_id").select(*keys, "html", (F.col("n") % 4).alias("error_count"))
    sides = [det.select(*keys, F.lit(s).alias("side"), "pos", F.col(f"{s}_text").alias("text"), "score") for s in ("ref", "gen")]
    profile = color_profile(adapter(spark, d, "pixels"), adapter(spark, d, "color_dict")).withColumn("n", F.floor(F.col("image") / 2) * 1000000000)
    named = profile.select(*keys, F.when(F.col("image") % 2 == 0, "ref").otherwise("gen").alias("side"), "name", F.col("share").alias("n"), "l0", "l1", "l2")
    judged = adapter(spark, d, "raw_judge").select((F.col("event_id") * 1000000000).alias("n"), "raw").select(*keys, "raw")
    return jobs.evaluation(samples, sides[0].unionByName(sides[1]), named, adapter(spark, d, "color_similarity"), judged)


@query("job_synthesis_prompts", """
SELECT page_id AS sample, md5(concat('Make: ', html)) AS prompt_md5 FROM pages WHERE page_id % 5 <> 0
  AND length(replace(html, '><', concat('>', chr(10), '<'))) - length(replace(replace(html, '><', concat('>', chr(10), '<')), chr(10), '')) + CASE WHEN suffix(replace(html, '><', concat('>', chr(10), '<')), chr(10)) THEN 0 ELSE 1 END <= 45""")  # fmt: skip
def job_synthesis(spark, d):
    s = adapter(spark, d, "source_samples")
    out = jobs.synthesis_prompts(s, s.where("sample % 5 = 0"), "Make: {}", {"{}": "html"}, text="html_lines", max_lines=45)
    return out.select("sample", F.md5("prompt").alias("prompt_md5"))


def _state_sides(spark, d):
    """Every fourth state is absent on the generated side, every third has the same tooltip in capitals, the others a longer one."""
    ref = adapter(spark, d, "states").select("sample", "data_index", "data_len", "tooltip")
    text = F.when(F.col("data_index") % 3 == 0, F.upper("tooltip")).otherwise(F.concat("tooltip", F.lit("  ZZ ")))
    return ref, ref.where("data_index % 4 <> 3").withColumn("tooltip", text)


# the ratio of a text and itself with three more characters is 2 n / (2 n + 3)
_SIM = ANCHORS + """,
flags AS (SELECT a.sample, a.position, t.threshold, s.sim >= t.threshold AS passed FROM (
  SELECT a.sample, a.position, CASE WHEN a.data_index % 4 = 3 THEN 0.0 WHEN a.data_index % 3 = 0 THEN 1.0 ELSE round(2.0 * length(tooltip) / (2 * length(tooltip) + 3), 4) END::DOUBLE AS sim
  FROM anch a JOIN states s ON s.sample = a.sample AND s.data_index = a.data_index) s JOIN anch a ON a.sample = s.sample AND a.position = s.position, (VALUES (CAST(0.85 AS DOUBLE)), (CAST(0.90 AS DOUBLE))) t(threshold))
"""


@query("job_behaviour", _SIM + _FAIL + "SELECT threshold, CAST(k AS BIGINT) AS k, fail_at, round(fail_at - lag(fail_at) OVER (PARTITION BY threshold ORDER BY k), 4) AS delta FROM fk", ("states",))
def job_behaviour(spark, d):
    return jobs.multi_state(*_state_sides(spark, d))["fail_at"]


#: Structural similarity of the 8 x 8 gray images `a` and `b` of each row (sample, position, a, b): four windows of 7 x 7.
SSIM = """
win AS (SELECT sample, position, oy, ox, avg(p.c / 255e0) AS ma, avg(q.c / 255e0) AS mb, var_samp(p.c / 255e0) AS va, var_samp(q.c / 255e0) AS vb, covar_samp(p.c / 255e0, q.c / 255e0) AS vab
  FROM pics JOIN gray p ON p.image = a JOIN gray q ON q.image = b AND q.y = p.y AND q.x = p.x, range(2) t(oy), range(2) u(ox)
  WHERE p.y BETWEEN oy AND oy + 6 AND p.x BETWEEN ox AND ox + 6 GROUP BY ALL),
ssim AS (SELECT sample, position, round(avg((2 * ma * mb + 1e-4) * (2 * vab + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))), 4) AS ssim FROM win GROUP BY sample, position)
"""


@query("job_behaviour_pictures", _SIM + """, pics AS (SELECT sample, position, (sample * 7 + data_index) % 500 AS a, (sample * 7 + data_index + CASE WHEN data_index % 3 = 0 THEN 0 ELSE 1 END) % 500 AS b FROM anch WHERE data_index % 4 <> 3),""" + SSIM + """
SELECT a.sample, CAST(a.position AS BIGINT) AS position, CASE WHEN a.data_index % 4 = 3 THEN 0.0 WHEN a.data_index % 3 = 0 THEN 1.0 ELSE round(2.0 * length(tooltip) / (2 * length(tooltip) + 3), 4) END::DOUBLE AS sim, coalesce(ssim, 0) AS ssim
FROM anch a JOIN states s ON s.sample = a.sample AND s.data_index = a.data_index LEFT JOIN ssim m ON m.sample = a.sample AND m.position = a.position""", ("states", "gray"))  # fmt: skip
def job_behaviour_pictures(spark, d):
    """Tooltips and pictures of the wanted states. A state's picture is an embedding, another one on the generated side of two states in three; every fourth is absent there."""
    ref, gen = _state_sides(spark, d)
    images = adapter(spark, d, "gray").groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "c"))), lambda t: t["c"] / 255.0).alias("picture"))

    def pictures(rows, other):
        image = (F.col("sample") * 7 + F.col("data_index") + other) % 500
        return rows.select("sample", "data_index", image.alias("image")).join(images, "image").select("sample", "data_index", "picture", F.lit(8).alias("width"))

    found = jobs.multi_state(ref, gen, pictures(ref, F.lit(0)), pictures(gen, F.when(F.col("data_index") % 3 == 0, 0).otherwise(1)))
    return found["states"].select("sample", "position", "sim", "ssim")


@query("job_edit_chains", _FIDELITY + """,
raw AS (SELECT chart_id, step, NOT (chart_id % 7 = 1 AND step = 6) AND NOT (chart_id % 11 = 2 AND step = 4) AS ok, round(same / n, 4) AS f, same = n AS em FROM m),
dead AS (SELECT chart_id, min(step) FILTER (WHERE NOT ok) AS c FROM raw GROUP BY chart_id)
SELECT r.chart_id, r.step, coalesce(r.step < c, true) AS render_ok, em AND coalesce(r.step < c, true) AS exact_match, CASE WHEN r.step >= c THEN 0.0 ELSE f END AS field_fidelity FROM raw r JOIN dead d ON d.chart_id = r.chart_id""")
def job_edit_chains(spark, d):
    """Every third chart's model is one edit behind; some answers hold no JSON, some pages don't render."""
    # ids make small files, so few tasks; each becomes eleven options
    charts = table(spark, d, "customer").select(F.col("c_custkey").alias("chart_id")).repartition(WAVES * spark.sparkContext.defaultParallelism, "chart_id")
    ref = chain_options(base_options(charts))
    late = ref.where("chart_id % 3 = 0 AND step < 10").withColumn("step", F.col("step") + 1)
    gen = late.unionByName(ref.where("chart_id % 3 <> 0 AND step > 0"))
    raw = F.when((F.col("chart_id") % 7 == 1) & (F.col("step") == 6), "no answer").otherwise(F.concat(F.lit("Here:\n```json\n"), "option", F.lit("\n```")))
    answers = gen.select("chart_id", "step", raw.alias("raw"), (~((F.col("chart_id") % 11 == 2) & (F.col("step") == 4))).alias("rendered"))
    return jobs.edit_chains(ref, answers)["chain"].select("chart_id", "step", "render_ok", "exact_match", "field_fidelity")


@query("s4_write_results", "SELECT model, task, count(*) AS n, CAST(sum(CAST(round(CASE WHEN task = 'data_edit' THEN ocr_f1 * 2 ELSE ocr_f1 END * 1e6) AS BIGINT)) AS BIGINT) AS ocr_f1 FROM eval_records GROUP BY model, task", ("eval_records",))
def s4(spark, d):
    """Records written by model and task; then one task is written again, which replaces its part only."""
    at, records = scratch(spark, "records"), adapter(spark, d, "eval_records").select("model", "task", "sample", "ocr_f1")
    write_results(records, at)
    write_results(records.where("task = 'data_edit'").withColumn("ocr_f1", F.col("ocr_f1") * 2), at)
    return spark.read.parquet(at).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("ocr_f1") * 1e6).cast("long")).alias("ocr_f1"))


@query("s5_model_coefficients", "SELECT concat('O.', p_partkey) AS feature, p_retailprice / 1000 AS coefficient FROM part")
def s5(spark, d):
    at = scratch(spark, "coefficients")
    rows = table(spark, d, "part").select(F.concat(F.lit("O."), F.col("p_partkey").cast("string")).alias("Feature"), (F.col("p_retailprice") / 1000).alias("coefficient"), F.col("p_size").alias("p-value"))
    rows.write.csv(at, header=True)
    return read_model_coefficients(spark, at)


@query("s8_prompts", "SELECT concat('Draw {} for ', n_name, '.', chr(10)) AS template FROM nation")
def s8(spark, d):
    """One template a file, each read as a whole."""
    at = scratch(spark, "prompts")
    table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Draw {} for "), "n_name", F.lit(".")).alias("value")).write.partitionBy("n_nationkey").text(at)
    return read_prompts(spark, at).select("template")
