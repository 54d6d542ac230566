"""Queries on generated files, judge answers, prompts and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import adapter, table
from ..functions import text as X
from ..operators import parsing as P
from ..operators import synthesis as Y
from ..sources import readers as IO
from ..sources.writers import scratch, write_json_parts, write_tree
from .registry import query

SAMPLES = ("source_samples",)
JUDGE = ("raw_judge",)


@query("p01_html_gate", "SELECT sample, contains(html, 'html>') AND contains(html, '</html>') AS passed FROM source_samples", SAMPLES)
def p01(spark, d):
    return adapter(spark, d, "source_samples").select("sample", X.html_gate(F.col("html")).alias("passed"))


def _tree(spark, d):
    s = adapter(spark, d, "source_samples")
    return s.select("sample", F.col("has_html").alias("has_gen_html"), F.col("has_orig").alias("has_orig_png"), F.col("has_eval").alias("has_eval_png"), F.col("has_gen").alias("has_gen_png"))


_PICK = """
SELECT sample, CASE WHEN has_eval THEN 'eval.png' WHEN has_gen AND has_orig THEN 'orig.png' END AS reference,
       CASE WHEN NOT has_html THEN 'no gen.html' WHEN NOT (has_eval OR (has_gen AND has_orig)) THEN 'no reference image' WHEN NOT has_gen THEN 'no gen.png' END AS reject
FROM source_samples"""


@query("p04_pick_reference_image", _PICK, SAMPLES)
def p04(spark, d):
    return IO.pick_reference_image(_tree(spark, d)).select("sample", "reference", "reject")


@query("a26_reject_report", f"SELECT reject AS cause, count(*) AS n FROM ({_PICK}) WHERE reject IS NOT NULL GROUP BY 1", SAMPLES)
def a26(spark, d):
    return P.reject_report(IO.pick_reference_image(_tree(spark, d)))


@query("s1_listing", """
SELECT CAST(sample % 3 AS VARCHAR) AS model, CAST(sample % 5 AS VARCHAR) AS task, CAST(sample AS VARCHAR) AS sample, has_html AS has_gen_html, has_orig AS has_orig_png, has_eval AS has_eval_png, has_gen AS has_gen_png
FROM source_samples WHERE has_html OR has_orig OR has_eval OR has_gen""", SAMPLES)  # fmt: skip
def s1(spark, d):
    t = _tree(spark, d)
    names = {"has_gen_html": "gen.html", "has_orig_png": "orig.png", "has_eval_png": "eval.png", "has_gen_png": "gen.png"}
    files = F.filter(F.array(*[F.when(F.col(c), F.lit(f)) for c, f in names.items()]), lambda x: x.isNotNull())
    rows = t.select((F.col("sample") % 3).cast("string").alias("model"), (F.col("sample") % 5).cast("string").alias("task"), F.col("sample").cast("string").alias("sample"), F.explode(files).alias("file"))
    return IO.listing(rows)


#: Names that a path can hold only with escapes.
_MODEL, _TASK, _SAMPLE = "concat('m %2B+', sample % 3)", "concat('täsk=', sample % 5)", "concat(sample, ' a:b?c#d')"


@query("s1_eval_tree", f"SELECT {_MODEL} AS model, {_TASK} AS task, {_SAMPLE} AS sample, has_html AS has_gen_html, has_orig AS has_orig_png, has_eval AS has_eval_png, has_gen AS has_gen_png FROM source_samples WHERE has_html OR has_orig OR has_eval OR has_gen", SAMPLES)
def s1_tree(spark, d):
    """Folders of samples written as files and found again by their paths; no file is opened."""
    root = scratch(spark, "eval-tree")
    names = {"gen.html": "has_html", "orig.png": "has_orig", "eval.png": "has_eval", "gen.png": "has_gen"}
    kinds = F.filter(F.array(*[F.when(F.col(flag), F.lit(f)) for f, flag in names.items()]), lambda x: x.isNotNull())
    files = adapter(spark, d, "source_samples").select(F.expr(_MODEL).alias("model"), F.expr(_TASK).alias("task"), F.expr(_SAMPLE).alias("sample"), F.explode(kinds).alias("file"), F.coalesce("html", F.lit("")).alias("value"))
    partitioned = write_tree(files, root, ("model", "task", "sample", "file"), plain=True)
    return IO.read_eval_tree(spark, root, partitioned)


@query("s2_sample_tree", f"SELECT {_SAMPLE} AS sample, CASE WHEN has_html THEN coalesce(html, '') || chr(10) END AS html, CASE WHEN has_gen THEN concat('// ', sample, chr(10), 'draw();', chr(10)) END AS js FROM source_samples", SAMPLES)
def s2(spark, d):
    """Source samples written as files and read back: two kinds of files with their texts, pictures by name only."""
    root = scratch(spark, "sample-tree")
    s = adapter(spark, d, "source_samples")
    kinds = F.array(
        F.when(F.col("has_html"), F.struct(F.lit("chart.html").alias("file"), F.coalesce("html", F.lit("")).alias("value"))),
        F.when(F.col("has_gen"), F.struct(F.lit("code.js").alias("file"), F.concat(F.lit("// "), F.col("sample").cast("string"), F.lit("\ndraw();")).alias("value"))),
        F.struct(F.lit("chart.png").alias("file"), F.lit("a picture").alias("value")),
    )
    files = s.select(F.expr(_SAMPLE).alias("sample"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f")).select("sample", "f.*")
    partitioned = write_tree(files, root, ("sample", "file"), plain=True)
    return IO.read_sample_tree(spark, root, partitioned)


@query("s9_summary_order", "SELECT concat('s', page_id) AS sample, row_number() OVER (PARTITION BY page_id % 7 ORDER BY md5(CAST(page_id AS VARCHAR))) - 1 AS position FROM pages")
def s9_summary(spark, d):
    """Seven summary files, lists of records in an order of their own, read back by place."""
    root = scratch(spark, "summaries")
    name = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("part"), F.md5(F.col("page_id").cast("string").cast("binary")).alias("at"), F.to_json(F.struct(name.alias("sample"), F.lit("a, [b]").alias("content"))).alias("record"))
    write_json_parts(rows, root, "part", ["at"], "record", F.lit("["), F.lit("]"))
    return IO.read_sample_order(spark, root)


@query("p06_line_count_filter", r"""
SELECT sample, CAST(n AS BIGINT) AS lines FROM (
  SELECT sample, CASE WHEN html_lines = '' THEN 0 ELSE length(html_lines) - length(replace(html_lines, chr(10), '')) + CASE WHEN suffix(html_lines, chr(10)) THEN 0 ELSE 1 END END AS n FROM source_samples) WHERE n <= 45""", SAMPLES)  # fmt: skip
def p06(spark, d):
    return Y.line_count_filter(adapter(spark, d, "source_samples"), "html_lines", 45).select("sample", X.line_count(F.col("html_lines")).cast("long").alias("lines"))


@query("p07_take_first_samples", "SELECT sample FROM source_samples ORDER BY CAST(sample AS VARCHAR) LIMIT 20", SAMPLES)
def p07(spark, d):
    return Y.take_first_samples(adapter(spark, d, "source_samples").select("sample"), 20)


@query("s9_sample_order", "SELECT sample, row_number() OVER (ORDER BY TRY_CAST(sample AS BIGINT) NULLS LAST, sample) - 1 AS position FROM (SELECT DISTINCT CASE WHEN sample % 10 = 0 THEN concat('s', sample) ELSE CAST(sample AS VARCHAR) END AS sample FROM source_samples)", SAMPLES)
def s9(spark, d):
    rows = adapter(spark, d, "source_samples").select(F.when(F.col("sample") % 10 == 0, F.concat(F.lit("s"), F.col("sample").cast("string"))).otherwise(F.col("sample").cast("string")).alias("sample"))
    return IO.sample_order(rows)


_ANSWER = "CASE sample % 3 WHEN 0 THEN concat('Sure:', chr(10), '```HTML', chr(10), html, chr(10), '```', chr(10), 'done') WHEN 1 THEN concat('```html', html, '``` and ```html<p>```') ELSE html END"


def _answers(spark, d):
    nl = F.lit("\n")
    html = F.col("html")
    three = F.when(F.col("sample") % 3 == 0, F.concat(F.lit("Sure:"), nl, F.lit("```HTML"), nl, html, nl, F.lit("```"), nl, F.lit("done"))).when(F.col("sample") % 3 == 1, F.concat(F.lit("```html"), html, F.lit("``` and ```html<p>```"))).otherwise(html)
    return adapter(spark, d, "source_samples").select("sample", three.alias("answer"))


@query("p08_extract_html", f"SELECT sample, md5(CASE WHEN regexp_matches(a, '(?is)```html(.*?)```') THEN trim(regexp_extract(a, '(?is)```html(.*?)```', 1), concat(' ', chr(10), chr(9), chr(13))) ELSE a END) AS html_md5 FROM (SELECT sample, {_ANSWER} AS a FROM source_samples)", SAMPLES)
def p08(spark, d):
    return _answers(spark, d).select("sample", F.md5(X.extract_html(F.col("answer"))).alias("html_md5"))


#: white space that stripping takes off
_BLANKS = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), ' ', chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))"
_FENCED = "CASE sample % 5 WHEN 0 THEN concat(chr(10), '```html', chr(10), html, chr(10), '```', chr(10)) WHEN 1 THEN concat('```json ', html, chr(12288), '```') WHEN 2 THEN concat(chr(9), '```', html, '```', chr(160)) WHEN 3 THEN concat('```javascript', chr(10), html, chr(10), '```') ELSE concat(html, ' ') END"


@query("p11_strip_code_fences", f"""
, a AS (SELECT sample, trim({_FENCED}, {_BLANKS}) AS t FROM source_samples),
b AS (SELECT sample, trim(CASE WHEN starts_with(t, '```html') OR starts_with(t, '```json') THEN substr(t, 8) WHEN starts_with(t, '```') THEN substr(t, 4) ELSE t END, {_BLANKS}) AS t FROM a)
SELECT sample, md5(trim(CASE WHEN suffix(t, '```') THEN substr(t, 1, length(t) - 3) ELSE t END, {_BLANKS})) AS text_md5 FROM b""", SAMPLES)  # fmt: skip
def p11(spark, d):
    html, nl, fence = F.col("html"), F.lit("\n"), F.lit("```")
    kinds = [F.concat(F.lit("\n```html\n"), html, nl, fence, nl), F.concat(F.lit("```json "), html, F.lit("\u3000"), fence), F.concat(F.lit("\t"), fence, html, fence, F.lit("\xa0")), F.concat(F.lit("```javascript\n"), html, nl, fence), F.concat(html, F.lit(" "))]
    answer = F.get(F.array(*kinds), (F.col("sample") % 5).cast("int"))
    return adapter(spark, d, "source_samples").select("sample", F.md5(X.strip_code_fences(answer)).alias("text_md5"))


@query("p13_wrap_html", "SELECT sample, length(CASE WHEN contains(lower(t), '<html') THEN t ELSE concat('<html><body>', t, '</body></html>') END) AS n FROM (SELECT sample, CASE WHEN sample % 2 = 0 THEN html ELSE replace(replace(html, '<html', '<div'), '<HTML', '<div') END AS t FROM source_samples)", SAMPLES)
def p13(spark, d):
    s = adapter(spark, d, "source_samples")
    t = F.when(F.col("sample") % 2 == 0, F.col("html")).otherwise(F.replace(F.replace("html", F.lit("<html"), F.lit("<div")), F.lit("<HTML"), F.lit("<div")))
    return s.select("sample", F.length(X.wrap_html(t, "<html><body>", "</body></html>")).cast("long").alias("n"))


@query("p14_render_prompts", "SELECT sample, md5(concat('Rebuild this page: ', html, ' -- sample ', CAST(sample AS VARCHAR), '. {} stays.')) AS prompt_md5 FROM source_samples", SAMPLES)
def p14(spark, d):
    s = adapter(spark, d, "source_samples").withColumn("mark", F.lit("{}"))
    out = Y.render_prompts(s, "Rebuild this page: {} -- sample {name}. {} stays.", {"{name}": "sample", "{}": "html"})
    return out.select("sample", F.md5("prompt").alias("prompt_md5"))


# the JSON part of an answer, and whether it is JSON
_PART = r"""
, part AS (
  SELECT event_id, raw, CASE WHEN regexp_extract(raw, '(?s)```(?:json|markdown)?\s*(.*?)\s*```', 1) <> '' THEN regexp_extract(raw, '(?s)```(?:json|markdown)?\s*(.*?)\s*```', 1)
              WHEN contains(raw, '{') AND contains(raw, '}') AND length(raw) + 1 - strpos(reverse(raw), '}') > strpos(raw, '{') THEN substr(raw, strpos(raw, '{'), length(raw) + 2 - strpos(reverse(raw), '}') - strpos(raw, '{'))
              WHEN contains(raw, '[') AND contains(raw, ']') AND length(raw) + 1 - strpos(reverse(raw), ']') > strpos(raw, '[') THEN substr(raw, strpos(raw, '['), length(raw) + 2 - strpos(reverse(raw), ']') - strpos(raw, '[')) END AS p FROM raw_judge),
good AS (SELECT event_id, p, CASE WHEN json_valid(p) THEN p END AS payload FROM part)
"""


@query("p09_extract_json", _PART + "SELECT event_id, payload FROM good", JUDGE)
def p09(spark, d):
    return P.parse_judge(adapter(spark, d, "raw_judge")).select("event_id", "payload")


@query("p10_extract_json_block", r"""
SELECT event_id, CASE WHEN json_valid(raw) THEN raw WHEN f <> '' THEN CASE WHEN json_valid(f) THEN f END WHEN json_valid(b) THEN b END AS block FROM (
  SELECT event_id, raw, regexp_extract(raw, '(?s)```(?:json)?\s*(\{.*\})\s*```', 1) AS f,
         CASE WHEN contains(raw, '{') AND contains(raw, '}') AND length(raw) + 1 - strpos(reverse(raw), '}') > strpos(raw, '{') THEN substr(raw, strpos(raw, '{'), length(raw) + 2 - strpos(reverse(raw), '}') - strpos(raw, '{')) END AS b FROM raw_judge)""", JUDGE)  # fmt: skip
def p10(spark, d):
    return adapter(spark, d, "raw_judge").select("event_id", X.json_block(F.col("raw")).alias("block"))


@query("p12_flatten_judge", _PART + """
SELECT event_id, CAST(json_extract(payload, '$.scores.visual_logic_score') AS DOUBLE) AS visual_logic, CAST(json_extract(payload, '$.scores.data_fidelity_score') AS DOUBLE) AS data_fidelity,
       CAST(json_extract(payload, '$.scores.style_consistency_score') AS DOUBLE) AS style_consistency, CAST(coalesce(json_array_length(payload, '$.fatal_errors'), 0) AS BIGINT) AS fatal_errors,
       coalesce(json_array_length(payload, '$.fatal_errors'), 0) > 0 AS fatal FROM good""", JUDGE)  # fmt: skip
def p12(spark, d):
    return P.flatten_judge(P.parse_judge(adapter(spark, d, "raw_judge"))).select("event_id", "visual_logic", "data_fidelity", "style_consistency", "fatal_errors", "fatal")


_MADE = """
made AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{"edit_dimension":"d', event_id, '","edit_content":"c","reference_html":"<p>"}') WHEN 1 THEN '```json{"edit_content":"c","reference_html":"<p>"}```'
                WHEN 2 THEN '{"edit_content":' ELSE 'nothing' END AS raw FROM events)"""


@query("p16_validate_generation", f"WITH {_MADE} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('d', event_id) END AS edit_dimension, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'missing edit_dimension' ELSE 'no json' END AS reject FROM made")
def p16(spark, d):
    e = table(spark, d, "events").select("event_id")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"edit_dimension":"d'), F.col("event_id").cast("string"), F.lit('","edit_content":"c","reference_html":"<p>"}'))).when(F.col("event_id") % 4 == 1, F.lit('```json{"edit_content":"c","reference_html":"<p>"}```')).when(F.col("event_id") % 4 == 2, F.lit('{"edit_content":')).otherwise("nothing")
    return P.validate_generation(e.withColumn("raw", raw), "edit").select("event_id", "edit_dimension", "reject")


@query("p15_build_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(concat(role, ':', text), '|' ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY conv_id")
def p15(spark, d):
    m = P.build_messages(table(spark, d, "conversations"), "conv_id", "turn")
    said = F.array_join(F.transform("messages", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(said).alias("messages_md5"))


@query("p15_image_message", "SELECT page_id, concat('data:image/png;base64,', to_base64(encode(url))) AS image FROM pages")
def p15b(spark, d):
    message = P.image_message(F.lit("Look."), F.col("url").cast("binary"))
    return table(spark, d, "pages").select("page_id", message[0]["content"][1]["value"].alias("image"))


@query("p17_normalize_text", "SELECT doc_id, md5(lower(trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g')))) AS text_md5 FROM documents")
def p17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("text_md5"))


_CLEAN = "SELECT image, pos, lower(trim({t}, " + _BLANKS + ")) AS text FROM detections WHERE score > 0.5 AND trim({t}, " + _BLANKS + ") <> ''"


def detections(spark, d, side):
    rows = adapter(spark, d, "detections").select("image", "pos", "score", F.col(f"{side}_text").alias("text"))
    return P.clean_detections(rows)


@query("p18_clean_detections", _CLEAN.format(t="ref_text"), ("detections",))
def p18(spark, d):
    return detections(spark, d, "ref").select("image", "pos", "text")


@query("j02_pair_ref_gen", f", r AS ({_CLEAN.format(t='ref_text')}), g AS ({_CLEAN.format(t='gen_text')}), ra AS (SELECT image, string_agg(text, '|' ORDER BY pos, text) AS ref FROM r GROUP BY image), ga AS (SELECT image, string_agg(text, '|' ORDER BY pos, text) AS gen FROM g GROUP BY image) SELECT coalesce(ra.image, ga.image) AS image, coalesce(ref, '') AS ref, coalesce(gen, '') AS gen FROM ra FULL JOIN ga ON ra.image = ga.image", ("detections",))
def j02(spark, d):
    both = P.pair_ref_gen(detections(spark, d, "ref"), detections(spark, d, "gen"))
    return both.select("image", F.array_join("ref", "|").alias("ref"), F.array_join("gen", "|").alias("gen"))


@query("j08_transfer_pairs", """
WITH h AS (SELECT page_id AS sample, md5(concat('11:', page_id)) AS h FROM pages),
placed AS (SELECT sample, row_number() OVER (ORDER BY h, sample) - 1 AS pos, count(*) OVER () AS n FROM h),
drawn AS (SELECT sample, pos, n, i, CAST(concat('0x', substr(md5(concat('11:', sample, ':', i)), 1, 8)) AS BIGINT) % (n + 1 - i) AS u FROM placed, (VALUES (1), (2), (3)) v(i) WHERE n >= 3),
wide AS (SELECT sample, any_value(pos) AS pos, any_value(n) AS n, max(u) FILTER (WHERE i = 1) AS a, max(u) FILTER (WHERE i = 2) AS u2, max(u) FILTER (WHERE i = 3) AS u3 FROM drawn GROUP BY sample),
two AS (SELECT *, CASE WHEN u2 >= a THEN u2 + 1 ELSE u2 END AS b FROM wide),
three AS (SELECT *, CASE WHEN u3 < least(a, b) THEN u3 WHEN u3 + 1 < greatest(a, b) THEN u3 + 1 ELSE u3 + 2 END AS c FROM two),
asked AS (SELECT sample, (pos + unnest([a, b, c])) % n AS t FROM three)
SELECT a.sample, p.sample AS to_sample FROM asked a JOIN placed p ON p.pos = a.t WHERE a.sample <> p.sample""")  # fmt: skip
def j08(spark, d):
    return Y.sample_transfer_pairs(table(spark, d, "pages").select(F.col("page_id").alias("sample")))


@query("a27_tooltip_pick", """
WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, text) AS r FROM conversations WHERE trim(text) <> '')
SELECT conv_id, max(text) FILTER (WHERE r = 1) AS tooltip, string_agg(text, '|' ORDER BY r) AS candidates FROM t WHERE r <= 5 GROUP BY conv_id""")  # fmt: skip
def a27(spark, d):
    from ..operators.states import tooltip_pick

    return tooltip_pick(table(spark, d, "conversations"), "conv_id", "text")
