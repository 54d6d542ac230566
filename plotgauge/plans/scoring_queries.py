"""Queries on evaluation records: gates, scores, leaderboards, robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import adapter
from ..functions.stats import clip_judge
from ..operators import robustness as R
from ..operators import scoring as S
from ..sources.readers import read_results_json
from ..sources.writers import scratch, write_json_parts
from .registry import query

_ERR = "CASE WHEN task = 'data_update' THEN error_count - 1 ELSE error_count END"
_CLIP = "least(greatest(({} - 1) / 4.0, 0.0), 1.0)"
#: CTEs: means and scores of the base weights
MEANS = f""",
rec AS (SELECT *, {_ERR} <= 0 AS ok FROM eval_records),
means AS (
  SELECT model, task, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS r_exec,
         coalesce(avg(CASE WHEN ok THEN {_CLIP.format("data_fidelity")} END), 0) AS data, coalesce(avg(CASE WHEN ok THEN ocr_f1 END), 0) AS text,
         coalesce(avg(CASE WHEN ok THEN {_CLIP.format("visual_logic")} END), 0) AS vis, coalesce(avg(CASE WHEN ok THEN {_CLIP.format("style")} END), 0) AS style,
         coalesce(avg(CASE WHEN ok THEN color_iou END), 0) AS color
  FROM rec GROUP BY model, task),
scores AS (SELECT *, round(r_exec * (data * 0.3 + text * 0.2 + vis * 0.2 + style * 0.15 + color * 0.15), 9) AS score FROM means)
"""
USES = ("eval_records",)


def records(spark, d):
    return adapter(spark, d, "eval_records")


def base_scores(spark, d):
    return S.composite_score(S.metric_means(records(spark, d)))


@query("s3_results_json", "SELECT model, task, sample, CAST(error_count AS BIGINT) AS error_count, round(ocr_f1, 6) AS ocr_f1, round(color_iou, 6) AS color_iou FROM eval_records", USES)
def s3(spark, d):
    """Result files of a model, a task and an eighth of the samples each, written line by line and read back."""
    root = scratch(spark, "results-json")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    record = F.concat(quoted("sample"), F.lit(":"), F.to_json(F.struct("error_count", "ocr_f1", "color_iou")))
    part = F.concat_ws("-", "model", "task", F.pmod(F.xxhash64("sample"), F.lit(8)).cast("string"))
    rows = records(spark, d).select("model", "task", "sample", part.alias("part"), record.alias("record"))
    write_json_parts(rows, root, "part", ["sample"], "record", F.concat(F.lit("{"), quoted("model"), F.lit(":{"), quoted("task"), F.lit(":{")), F.lit("}}}"))
    out = read_results_json(spark, root)
    return out.select("model", "task", "sample", "error_count", F.round("ocr_f1", 6).alias("ocr_f1"), F.round("color_iou", 6).alias("color_iou"))


@query("p02_gate_fail_record", """
SELECT sample, CASE WHEN ok THEN n END AS error_count, CASE WHEN ok THEN f ELSE 0.0 END AS ocr_f1, CASE WHEN ok THEN f / 2 ELSE 0.0 END AS color_iou, CASE WHEN ok THEN f / 4 ELSE 0.0 END AS judge_overall
FROM (SELECT sample, sample % 3 AS n, (sample % 10) / 10.0 AS f, contains(html, 'html>') AND contains(html, '</html>') AS ok FROM source_samples)""", ("source_samples",))  # fmt: skip
def p02(spark, d):
    from ..functions.text import html_gate

    f = (F.col("sample") % 10) / 10.0
    rows = adapter(spark, d, "source_samples").select("sample", html_gate(F.col("html")).alias("passed"), (F.col("sample") % 3).alias("error_count"), f.alias("ocr_f1"), (f / 2).alias("color_iou"), (f / 4).alias("judge_overall"))
    return S.gate_fail_record(rows).select("sample", "error_count", "ocr_f1", "color_iou", "judge_overall")


@query("p03_executability", f"SELECT model, task, count(*) AS n, CAST(sum(CASE WHEN {_ERR} <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS executable, CAST(sum({_ERR}) AS BIGINT) AS errors FROM eval_records GROUP BY model, task", USES)
def p03(spark, d):
    return S.executability(records(spark, d)).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("executable").cast("long")).alias("executable"), F.sum("errors").cast("long").alias("errors"))


@query("p05_select_runs", "SELECT model, task, count(*) AS n FROM eval_records WHERE model IN ('m01', 'm05') AND task NOT IN ('chart_mimic', 'high_complex', 'data_edit') GROUP BY model, task", USES)
def p05(spark, d):
    return S.select_runs(records(spark, d), ["m01", "m05"], (*S.SKIPPED_TASKS, "data_edit")).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"))


@query("p19_clip_judge", f"SELECT sample, model, task, {_CLIP.format('visual_logic')} AS vis, {_CLIP.format('data_fidelity')} AS data FROM eval_records", USES)
def p19(spark, d):
    return records(spark, d).select("sample", "model", "task", clip_judge(F.col("visual_logic")).alias("vis"), clip_judge(F.col("data_fidelity")).alias("data"))


@query("a04_composite_score", MEANS + "SELECT model, task, round(r_exec, 6) AS r_exec, round(score, 6) AS score FROM scores", USES)
def a04(spark, d):
    return base_scores(spark, d).select("model", "task", F.round("r_exec", 6).alias("r_exec"), F.round("score", 6).alias("score"))


@query("a04_composite_per_sample", f"""
, rec AS (SELECT *, {_ERR} <= 0 AS ok FROM eval_records)
SELECT model, task, round(round(avg(CASE WHEN ok THEN {_CLIP.format("data_fidelity")} * 0.3 + ocr_f1 * 0.2 + {_CLIP.format("visual_logic")} * 0.2 + {_CLIP.format("style")} * 0.15 + color_iou * 0.15 ELSE 0 END), 9), 6) AS score
FROM rec GROUP BY model, task""", USES)  # fmt: skip
def a04b(spark, d):
    return S.composite_score(S.metric_means(records(spark, d), "per_sample")).select("model", "task", F.round("score", 6).alias("score"))


_BOARD = """
SELECT task, model, round(score, 6) AS score, row_number() OVER (PARTITION BY task ORDER BY score DESC, model) AS place,
       rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS avg_rank FROM scores"""


@query("a05_leaderboard", MEANS + _BOARD, USES)
def a05(spark, d):
    return S.leaderboard(base_scores(spark, d)).withColumn("score", F.round("score", 6))


@query("w01_rank_models", MEANS + "SELECT task, model, rank() OVER (PARTITION BY task ORDER BY score DESC) AS rank FROM scores", USES)
def w01(spark, d):
    return S.rank_models(base_scores(spark, d)).select("task", "model", "rank")


@query("w01_top3", MEANS + f"SELECT task, model, place FROM ({_BOARD}) WHERE place <= 3", USES)
def w01b(spark, d):
    return S.leaderboard(base_scores(spark, d), top=3).select("task", "model", "place")


@query("w02_average_rank", MEANS + f"SELECT task, model, avg_rank FROM ({_BOARD})", USES)
def w02(spark, d):
    return S.leaderboard(base_scores(spark, d)).select("task", "model", "avg_rank")


_DONE = "done AS (SELECT model, task, sample, CASE WHEN CAST(sample AS BIGINT) % 3 = 0 THEN NULL ELSE error_count END AS error_count FROM eval_records WHERE CAST(sample AS BIGINT) % 2 = 0)"


@query("j01_pending_samples", f", {_DONE} SELECT r.model, r.task, r.sample FROM eval_records r ANTI JOIN (SELECT * FROM done WHERE error_count IS NOT NULL) d ON r.model = d.model AND r.task = d.task AND r.sample = d.sample", USES)
def j01(spark, d):
    r = records(spark, d)
    number = F.col("sample").cast("long")
    done = r.where(number % 2 == 0).select("model", "task", "sample", F.when(number % 3 == 0, None).otherwise(F.col("error_count")).alias("error_count"))
    return S.pending(r.select("model", "task", "sample"), done, ["model", "task", "sample"])


WEIGHTS = """
draws AS (
  SELECT a.amplitude, i.id AS idx, m.metric,
         greatest(m.base + (2 * (CAST(concat('0x', substr(md5(concat('7:', a.k, ':', CAST(i.id AS VARCHAR), ':', m.metric)), 1, 8)) AS BIGINT) / 4294967296e0) - 1) * a.amplitude, 1e-8) AS raw
  FROM range({n}) i(id), (VALUES ('1', 3e-2), ('2', 5e-2), ('3', 1e-1), ('4', 2e-1)) a(k, amplitude),
       (VALUES ('data', 3e-1), ('text', 2e-1), ('vis', 2e-1), ('style', 15e-2), ('color', 15e-2)) m(metric, base)),
weights AS (SELECT amplitude, idx, metric, raw / sum(raw) OVER (PARTITION BY amplitude, idx) AS w FROM draws),
wide AS (SELECT amplitude, idx, max(w) FILTER (WHERE metric = 'data') AS wd, max(w) FILTER (WHERE metric = 'text') AS wt, max(w) FILTER (WHERE metric = 'vis') AS wv,
                max(w) FILTER (WHERE metric = 'style') AS ws, max(w) FILTER (WHERE metric = 'color') AS wc FROM weights GROUP BY amplitude, idx),
pert AS (SELECT amplitude, idx, task, model, round(r_exec * (data * wd + text * wt + vis * wv + style * ws + color * wc), 9) AS score FROM means, wide)"""
RHO = """
ranked AS (SELECT amplitude, idx, task, model, score, rank() OVER (PARTITION BY amplitude, idx, task ORDER BY score DESC) + (count(*) OVER (PARTITION BY amplitude, idx, task, score) - 1) / 2.0 AS y FROM pert),
base AS (SELECT task, model, score, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS x FROM scores),
rho AS (SELECT amplitude, idx, task, greatest(-1, least(1, (sum(x * y) - sum(x) * sum(y) / count(*)) / nullif(sqrt((sum(x * x) - sum(x) * sum(x) / count(*)) * (sum(y * y) - sum(y) * sum(y) / count(*))), 0))) AS spearman
        FROM ranked JOIN base USING (task, model) GROUP BY amplitude, idx, task)"""
TAU = """
sgn AS (SELECT a.task, a.model AS ma, b.model AS mb, sign(a.score - b.score) AS x FROM scores a JOIN scores b ON a.task = b.task AND a.model < b.model),
tau AS (SELECT p.amplitude, p.idx, p.task, sum(x * sign(p.score - q.score)) / nullif(sqrt(sum(abs(x)) * sum(abs(sign(p.score - q.score)))), 0) AS kendall
        FROM sgn JOIN pert p ON p.task = sgn.task AND p.model = ma JOIN pert q ON q.task = sgn.task AND q.model = mb AND q.amplitude = p.amplitude AND q.idx = p.idx
        GROUP BY p.amplitude, p.idx, p.task)"""


@query("j10_cross_weights", MEANS + "," + WEIGHTS.format(n=1000) + " SELECT amplitude, idx, task, model, round(score, 6) AS score FROM pert", USES)
def j10(spark, d):
    return R.cross_weights(S.metric_means(records(spark, d)), R.perturbed_weights(spark)).withColumn("score", F.round("score", 6))


def _correlations(spark, d):
    means = S.metric_means(records(spark, d))
    base = S.composite_score(means)
    scores = R.cross_weights(means, R.perturbed_weights(spark))
    return base, scores


@query("a11_spearman", MEANS + "," + WEIGHTS.format(n=1000) + "," + RHO + " SELECT amplitude, idx, task, round(spearman, 6) AS spearman FROM rho", USES)
def a11(spark, d):
    return R.spearman(*_correlations(spark, d)).withColumn("spearman", F.round("spearman", 6))


@query("a12_kendall_tau_b", MEANS + "," + WEIGHTS.format(n=1000) + "," + TAU + " SELECT amplitude, idx, task, round(kendall, 6) AS kendall FROM tau", USES)
def a12(spark, d):
    return R.kendall_tau_b(*_correlations(spark, d)).withColumn("kendall", F.round("kendall", 6))


def _summary_sql(value: str, source: str) -> str:
    stats = f"round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std, round(min({value}), 6) AS min, round(max({value}), 6) AS max"
    return f" SELECT amplitude, task, {stats} FROM {source} GROUP BY amplitude, task UNION ALL SELECT amplitude, 'all', {stats} FROM {source} GROUP BY amplitude"


def _rounded(df):
    return df.select("amplitude", "task", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query("a10_robustness_spearman", MEANS + "," + WEIGHTS.format(n=1000) + "," + RHO + _summary_sql("spearman", "rho"), USES)
def a10(spark, d):
    return _rounded(R.robustness_summary(R.spearman(*_correlations(spark, d)), "spearman"))


@query("a10_robustness_kendall", MEANS + "," + WEIGHTS.format(n=1000) + "," + TAU + _summary_sql("kendall", "tau"), USES)
def a10b(spark, d):
    return _rounded(R.robustness_summary(R.kendall_tau_b(*_correlations(spark, d)), "kendall"))


@query("a13_worst_perturbation", MEANS + "," + WEIGHTS.format(n=1000) + "," + RHO + "," + TAU + """
SELECT amplitude, idx, mean_spearman, mean_kendall FROM (
  SELECT *, row_number() OVER (PARTITION BY amplitude ORDER BY mean_spearman, idx) AS r FROM (
    SELECT amplitude, idx, round(avg(spearman), 9) AS mean_spearman, round(avg(kendall), 9) AS mean_kendall FROM rho JOIN tau USING (amplitude, idx, task) GROUP BY amplitude, idx)) WHERE r = 1""", USES)  # fmt: skip
def a13(spark, d):
    base, scores = _correlations(spark, d)
    return R.worst_perturbation(R.spearman(base, scores), R.kendall_tau_b(base, scores))
