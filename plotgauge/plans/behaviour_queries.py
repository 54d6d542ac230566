"""Queries on multi-state charts and edit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import adapter, table
from ..operators import chains as C
from ..operators import states as A
from ..sources.writers import settle
from .registry import query

STATES = ("states",)
ANCHORS = """,
lens AS (SELECT sample, max(data_len) AS n FROM states GROUP BY sample),
anch AS (SELECT sample, n, unnest([0, 1, n // 2, n - 2, n - 1]) AS data_index, unnest([0, 1, 2, 3, 4]) AS position FROM lens WHERE n >= 5 AND len(list_distinct([0, 1, n // 2, n - 2, n - 1])) = 5)
"""
FLAGS = ANCHORS + """,
flags AS (SELECT a.sample, a.position, t.threshold, s.sim >= t.threshold AS passed FROM anch a JOIN states s ON s.sample = a.sample AND s.data_index = a.data_index, (VALUES (CAST(0.85 AS DOUBLE)), (CAST(0.90 AS DOUBLE))) t(threshold)),
pref AS (SELECT *, bool_and(passed) OVER (PARTITION BY threshold, sample ORDER BY position) AS all_so_far FROM flags)
"""


def _anchors(spark, d):
    s = adapter(spark, d, "states")
    return s, A.state_anchors(s.groupBy("sample").agg(F.max("data_len").alias("data_len")))


def _flags(spark, d):
    s, anchors = _anchors(spark, d)
    return A.pass_flags(anchors.join(s.select("sample", "data_index", "sim"), ["sample", "data_index"]))


@query("p21_state_anchors", ANCHORS + "SELECT sample, CAST(position AS BIGINT) AS position, CAST(data_index AS BIGINT) AS data_index FROM anch", STATES)
def p21(spark, d):
    return _anchors(spark, d)[1].select("sample", "position", "data_index")


@query("j03_align_states", ANCHORS + """
SELECT a.sample, CAST(a.data_index AS BIGINT) AS data_index, coalesce(s.tooltip, '') AS ref_text, CASE WHEN s.data_index % 4 = 3 THEN '' ELSE coalesce(upper(s.tooltip), '') END AS gen_text
FROM anch a LEFT JOIN states s ON s.sample = a.sample AND s.data_index = a.data_index""", STATES)  # fmt: skip
def j03(spark, d):
    s, anchors = _anchors(spark, d)
    gen = s.where("data_index % 4 <> 3").withColumn("tooltip", F.upper("tooltip"))
    return A.align_states(anchors, s, gen).select("sample", "data_index", "ref_text", "gen_text")


@query("w03_prefix_pass", FLAGS + "SELECT sample, threshold, CAST(position AS BIGINT) AS position, all_so_far FROM pref", STATES)
def w03(spark, d):
    return _flags(spark, d).select("sample", "threshold", "position", "all_so_far")


_FAIL = """, fk AS (
  SELECT threshold, k, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 4) AS fail_at FROM (
    SELECT threshold, sample, k, bool_and(passed) AS ok FROM flags, (VALUES (1), (2), (3), (5)) v(k) WHERE position < k GROUP BY threshold, sample, k) GROUP BY threshold, k)
"""


@query("a06_fail_at_k", FLAGS + _FAIL + "SELECT threshold, CAST(k AS BIGINT) AS k, fail_at FROM fk", STATES)
def a06(spark, d):
    return A.fail_at_k(_flags(spark, d)).select("threshold", "k", "fail_at")


@query("w09_delta_at_k", FLAGS + _FAIL + "SELECT threshold, CAST(k AS BIGINT) AS k, round(fail_at - lag(fail_at) OVER (PARTITION BY threshold ORDER BY k), 4) AS delta FROM fk", STATES)
def w09(spark, d):
    return A.fail_at_k(_flags(spark, d)).select("threshold", "k", "delta")


@query("a07_core_predicts_later", FLAGS + """, one AS (
  SELECT threshold, sample, NOT bool_or(passed) FILTER (WHERE position < 2) AS cf, bool_and(passed) FILTER (WHERE position < 2) AS cp, bool_or(passed) FILTER (WHERE position >= 2) AS lf, bool_and(passed) FILTER (WHERE position >= 2) AS lp FROM flags GROUP BY threshold, sample)
SELECT threshold, count(*) FILTER (WHERE cf) AS core_fail, count(*) FILTER (WHERE cp) AS core_pass, round(count(*) FILTER (WHERE cf AND NOT lf) / nullif(count(*) FILTER (WHERE cf), 0), 4) AS later_fail,
       round(count(*) FILTER (WHERE cp AND lp) / nullif(count(*) FILTER (WHERE cp), 0), 4) AS later_pass FROM one GROUP BY threshold""", STATES)  # fmt: skip
def a07(spark, d):
    return A.core_predicts_later(_flags(spark, d))


@query("w07_balanced_selection", FLAGS + """, cls AS (
  SELECT sample, CASE WHEN NOT bool_or(passed) THEN 'fail' WHEN bool_and(passed) THEN 'pass' END AS cls FROM flags WHERE threshold = 0.85 AND position < 2 GROUP BY sample)
SELECT * FROM (SELECT sample, cls, row_number() OVER (PARTITION BY cls ORDER BY sample) AS place FROM cls WHERE cls IS NOT NULL) WHERE place <= 25""", STATES)  # fmt: skip
def w07(spark, d):
    return A.balanced_selection(_flags(spark, d))


@query("t02_union_of_classes", FLAGS + """, cls AS (
  SELECT sample, CASE WHEN NOT bool_or(passed) THEN 'fail' WHEN bool_and(passed) THEN 'pass' END AS cls FROM flags WHERE threshold = 0.85 AND position < 2 GROUP BY sample)
SELECT cls, count(*) AS n FROM (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY sample) AS place FROM cls WHERE cls IS NOT NULL) WHERE place <= 10 GROUP BY cls""", STATES)  # fmt: skip
def t02(spark, d):
    s = A.balanced_selection(_flags(spark, d), limit=20)
    return s.where("cls = 'fail'").unionByName(s.where("cls = 'pass'")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


CHAIN = ("chain_steps",)
CARRIED = """,
scored AS (SELECT *, round(matched / n_active, 4) AS f, matched = n_active AS em, min(CASE WHEN NOT render_ok THEN step END) OVER (PARTITION BY chart_id) AS c FROM chain_steps),
steps AS (SELECT chart_id, step, c, render_ok AND coalesce(step < c, true) AS render_ok, em AND coalesce(step < c, true) AS exact_match, CASE WHEN step >= c THEN 0.0 ELSE f END AS field_fidelity FROM scored),
alive AS (SELECT *, bool_and(render_ok AND exact_match) OVER (PARTITION BY chart_id ORDER BY step) AS alive FROM steps)
"""


def _steps(spark, d):
    return C.carry_hard_collapse(C.scored_steps(adapter(spark, d, "chain_steps")))


@query("w05_carry_hard_collapse", CARRIED + "SELECT chart_id, step, render_ok, exact_match, field_fidelity FROM steps", CHAIN)
def w05(spark, d):
    return _steps(spark, d).select("chart_id", "step", "render_ok", "exact_match", "field_fidelity")


@query("w04_workflow_alive", CARRIED + "SELECT chart_id, step, alive FROM alive", CHAIN)
def w04(spark, d):
    return C.workflow_alive(_steps(spark, d)).select("chart_id", "step", "alive")


@query("a08_step_summary", CARRIED + """
SELECT step, round(avg(CAST(render_ok AS INT)), 4) AS render_survival, round(avg(CAST(exact_match AS INT)), 4) AS exact_match_rate, round(avg(field_fidelity), 4) AS average_field_fidelity, round(avg(CAST(alive AS INT)), 4) AS workflow_survival
FROM alive WHERE step IN (1, 3, 5, 8, 10) GROUP BY step""", CHAIN)  # fmt: skip
def a08(spark, d):
    return C.step_summary(_steps(spark, d))


@query("a09_collapse_distribution", CARRIED + "SELECT coalesce(CAST(s AS VARCHAR), 'no_hard_crash') AS step, count(*) AS n FROM (SELECT min(step) FILTER (WHERE NOT render_ok) AS s FROM steps GROUP BY chart_id) GROUP BY 1", CHAIN)
def a09(spark, d):
    return C.collapse_distribution(_steps(spark, d))


@query("a09_drift_distribution", CARRIED + "SELECT coalesce(CAST(s AS VARCHAR), 'no_drift') AS step, count(*) AS n FROM (SELECT min(step) FILTER (WHERE NOT (render_ok AND exact_match)) AS s FROM steps GROUP BY chart_id) GROUP BY 1", CHAIN)
def a09b(spark, d):
    return C.drift_distribution(_steps(spark, d))


def _charts(spark, d):
    return C.base_options(table(spark, d, "customer").select(F.col("c_custkey").alias("chart_id")))


_V = "(VALUES (0, 2, 'Revenue'), (1, 2, 'North'), (2, 2, 'Orders'), (3, 3, 'Desktop'), (4, 3, 'Visits')) v(k, n, name)"


@query("p23_base_options", f"SELECT c_custkey AS chart_id, concat('Base Chart ', c_custkey + 1) AS title, CAST(n AS BIGINT) AS n_series, name AS first_series FROM customer JOIN {_V} ON k = c_custkey % 5")
def p23(spark, d):
    o = _charts(spark, d)
    return o.select("chart_id", F.col("option.title.text").alias("title"), F.size("option.series").cast("long").alias("n_series"), F.col("option.series")[0]["name"].alias("first_series"))


_STEPS_SQL = """
WITH s AS (SELECT c_custkey AS chart_id, step FROM customer, range(0, 11) r(step))
SELECT chart_id, step, CASE WHEN step >= 1 THEN 'Quarterly Review Dashboard' ELSE concat('Base Chart ', chart_id + 1) END AS title_text,
       CASE WHEN step >= 9 THEN '30|10|#16324f' WHEN step >= 1 THEN 'center|10|-' ELSE 'center|8|-' END AS title_layout,
       CASE WHEN step >= 10 THEN '-|false|true|middle|vertical' WHEN step >= 2 THEN 'center|true|false|-|horizontal' ELSE 'center|false|false|8|-' END AS legend_pos,
       CASE WHEN step >= 3 THEN '#f7f7fb' END AS background, CASE WHEN step >= 5 THEN '["#2456A6","#2F8F6B","#D9822B"]' END AS palette,
       CASE WHEN step >= 6 THEN 'true|dashed|#d0d7e2' ELSE 'false|-|-' END AS splitline, CASE WHEN step >= 7 THEN '70|50|80|70' ELSE '50|30|55|40' END AS grid
FROM s"""


@query("p24_p25_edit_chain_signature", _STEPS_SQL)
def p24(spark, d):
    return C.semantic_signature(C.chain_options(_charts(spark, d), text=False)).select("chart_id", "step", "title_text", "title_layout", "legend_pos", "background", "palette", "splitline", "grid")


@query("p25_series_signature", """
WITH v(k, i, name, kind) AS (VALUES (0, 0, 'Revenue', 'bar'), (0, 1, 'Target', 'bar'), (1, 0, 'North', 'line'), (1, 1, 'South', 'line'), (2, 0, 'Orders', 'bar'), (2, 1, 'Conversion', 'line'),
  (3, 0, 'Desktop', 'bar'), (3, 1, 'Mobile', 'bar'), (3, 2, 'Tablet', 'bar'), (4, 0, 'Visits', 'line'), (4, 1, 'Qualified', 'line'), (4, 2, 'Won', 'line')),
s AS (SELECT c_custkey AS chart_id, step, i, name, kind FROM customer JOIN v ON k = c_custkey % 5, range(0, 11) r(step))
SELECT chart_id, step, string_agg(concat(kind, '|', CASE WHEN step >= 4 THEN 'true' ELSE 'false' END, '|top'), ';' ORDER BY i) AS labels_signature,
       concat(coalesce(string_agg(concat(name, '|', CASE WHEN step >= 8 THEN '[6,6,0,0]' ELSE '[0,0,0,0]' END, '|22'), ';' ORDER BY i) FILTER (WHERE kind = 'bar'), ''), '/',
              coalesce(string_agg(concat(name, '|', CASE WHEN step >= 8 THEN '3|10' ELSE '2|6' END), ';' ORDER BY i) FILTER (WHERE kind = 'line'), '')) AS series_style
FROM s GROUP BY chart_id, step""")  # fmt: skip
def p25(spark, d):
    return C.semantic_signature(C.chain_options(_charts(spark, d), text=False)).select("chart_id", "step", "labels_signature", "series_style")


_LENGTHS = "[c_custkey % 7, c_nationkey % 6, c_custkey % 5]"


@query("p22_usable_series", f"""
SELECT c_custkey AS chart_id, CAST(list_position(n, list_max(n)) - 1 AS BIGINT) AS usable_series,
       CAST(CASE WHEN n[1] > c_custkey % 9 THEN 0 WHEN n[2] > c_custkey % 9 THEN 1 WHEN n[3] > c_custkey % 9 THEN 2 ELSE -1 END AS BIGINT) AS for_state
FROM (SELECT c_custkey, {_LENGTHS} AS n FROM customer)""")  # fmt: skip
def p22(spark, d):
    """Three series whose lengths differ by customer, ties and empty ones among them."""
    series = F.array(*[F.struct(F.array_repeat(F.lit(1), (F.col(c) % k).cast("int")).alias("data")) for c, k in (("c_custkey", 7), ("c_nationkey", 6), ("c_custkey", 5))])
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("chart_id"), F.to_json(F.struct(series.alias("series"))).alias("option"))
    first = C.usable_series(o)
    state = C.usable_series(o, state=(F.col("chart_id") % 9).cast("int")).select("chart_id", F.col("usable_series").alias("for_state"))
    return first.select("chart_id", "usable_series").join(state, "chart_id")


_HEAD, _TAIL = "<!DOCTYPE html>\n<html><body><script>const option = ", ";</script></body></html>"


@query("p26_option_page", f"SELECT c_custkey AS chart_id, concat('{_HEAD}', json_object('title', c_name, 'series', [c_nationkey, c_custkey % 100]), '{_TAIL}') AS page FROM customer")
def p26(spark, d):
    """The whole page of a customer's option, every character of it."""
    option = F.to_json(F.struct(F.col("c_name").alias("title"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 100).alias("series")))
    pages = C.option_page(table(spark, d, "customer").select(F.col("c_custkey").alias("chart_id"), option.alias("option")), _HEAD, _TAIL)
    return pages.select("chart_id", "page")


_FIDELITY = """
WITH s AS (SELECT c_custkey AS chart_id, step, least(step, 9) AS n, CASE WHEN c_custkey % 3 = 0 THEN greatest(step - 1, 0) ELSE step END AS g FROM customer, range(1, 11) r(step)),
m AS (SELECT chart_id, step, n, 1 + CASE WHEN n < 2 THEN 0 WHEN (step >= 10) = (g >= 10) AND (g >= 2) THEN 1 ELSE 0 END + CASE WHEN n >= 3 AND g >= 3 THEN 1 ELSE 0 END + CASE WHEN n >= 4 AND g >= 4 THEN 1 ELSE 0 END
        + CASE WHEN n >= 5 AND g >= 5 THEN 1 ELSE 0 END + CASE WHEN n >= 6 AND g >= 6 THEN 1 ELSE 0 END + CASE WHEN n >= 7 AND g >= 7 THEN 1 ELSE 0 END + CASE WHEN n >= 8 AND g >= 8 THEN 1 ELSE 0 END + CASE WHEN n >= 9 AND g >= 9 THEN 1 ELSE 0 END
        - CASE WHEN g = 0 THEN 1 ELSE 0 END AS same FROM s)"""


@query("j11_field_fidelity", _FIDELITY + """
SELECT chart_id, step, round(same / n, 4) AS field_fidelity, same = n AS exact_match FROM m""")  # fmt: skip
def j11(spark, d):
    ref = settle(C.semantic_signature(C.chain_options(_charts(spark, d), text=False)).select("chart_id", "step", *C.FIELDS), "signatures")
    # every third chart's model is one edit behind
    late = ref.where("chart_id % 3 = 0 AND step < 10").withColumn("step", F.col("step") + 1)
    gen = late.unionByName(ref.where("chart_id % 3 <> 0 AND step > 0"))
    return C.field_fidelity(ref, gen)
