"""Evaluation-shaped tables over the star-schema test tables, as SQL for both engines.

``@name`` stands for a table. Spark reads it from Parquet, DuckDB has a view of that name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

EVAL_RECORDS = """
SELECT model, task, sample, MAX(error_count) AS error_count, MAX(ocr_f1) AS ocr_f1, MAX(color_iou) AS color_iou,
       MAX(visual_logic) AS visual_logic, MAX(data_fidelity) AS data_fidelity, MAX(style) AS style
FROM (SELECT CONCAT('m', LPAD(CAST(l_suppkey % 17 AS VARCHAR(10)), 2, '0')) AS model,
             CASE l_partkey % 6 WHEN 0 THEN 'before_complex' WHEN 1 THEN 'after_complex' WHEN 2 THEN 'data_edit'
                  WHEN 3 THEN 'data_interaction' WHEN 4 THEN 'data_newStyle' ELSE 'data_update' END AS task,
             CAST(l_orderkey * 8 + l_linenumber AS VARCHAR(20)) AS sample,
             CASE WHEN l_partkey % 6 = 5 AND l_suppkey % 17 >= 14 THEN 2
                  WHEN l_returnflag = 'R' AND l_suppkey % 5 < 3 THEN 2
                  WHEN l_partkey % 6 = 5 THEN 1 ELSE 0 END AS error_count,
             l_discount * 1e1 * (1e0 - (l_suppkey % 17) / 4e1) AS ocr_f1,
             l_tax * 12.5e0 * (1e0 - (l_suppkey % 17) / 5e1) AS color_iou,
             1 + (l_orderkey + l_suppkey) % 5 AS visual_logic,
             CAST(l_quantity AS INT) % 6 AS data_fidelity,
             1 + (l_partkey + l_linenumber) % 5 AS style
      FROM @lineitem) t
GROUP BY model, task, sample"""

RAW_JUDGE = """
SELECT event_id, CASE event_id % 5
         WHEN 0 THEN j
         WHEN 1 THEN CONCAT('```json', CHR(10), j, CHR(10), '```')
         WHEN 2 THEN CONCAT('Here it is: ', j, ' done.')
         WHEN 3 THEN SUBSTR(j, 1, LENGTH(j) - 2)
         ELSE 'no answer' END AS raw
FROM (SELECT event_id, CONCAT('{"scores":{"visual_logic_score":', CAST(event_id % 6 AS VARCHAR(10)),
             ',"data_fidelity_score":', CAST(user_id % 6 AS VARCHAR(10)),
             ',"style_consistency_score":', CAST((event_id + user_id) % 6 AS VARCHAR(10)),
             '},"fatal_errors":[', CASE WHEN event_type = 'error' THEN '"type"' ELSE '' END, '],"style_warnings":[]}') AS j
      FROM @events) t"""

SOURCE_SAMPLES = """
SELECT page_id AS sample, html, REPLACE(html, '><', CONCAT('>', CHR(10), '<')) AS html_lines,
       page_id % 3 = 0 AS has_eval, page_id % 7 <> 0 AS has_gen, page_id % 11 <> 0 AS has_orig, page_id % 13 <> 0 AS has_html
FROM @pages"""

STATES = """
SELECT user_id AS sample, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS data_index,
       CAST(COUNT(*) OVER (PARTITION BY user_id) AS BIGINT) AS data_len,
       CONCAT(event_type, ' ', CAST(event_id % 100 AS VARCHAR(10))) AS tooltip,
       1e0 - ((event_id * 7919) % 1000) / 4e3 AS sim
FROM @events"""

CHAIN_STEPS = """
SELECT c_custkey AS chart_id, CAST(s.step AS BIGINT) AS step, CAST(s.n_active AS BIGINT) AS n_active,
       (c_custkey * 31 + s.step * 17) % 53 <> 0 AS render_ok,
       CAST(s.n_active - CASE WHEN (c_custkey * 13 + s.step * 7) % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS matched
FROM @customer CROSS JOIN (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 9)) AS s(step, n_active)"""

_CHANNEL = "CAST(GREATEST(0, LEAST(255, FLOOR((CAST({v} AS DOUBLE) + 5e-1) * 255e0))) AS BIGINT)"
CHANNELS = {
    "spark": f"SELECT vec_id AS image, CAST(pos AS BIGINT) AS pos, {_CHANNEL.format(v='val')} AS c FROM @embeddings LATERAL VIEW POSEXPLODE(embedding) t AS pos, val",
    "duckdb": f"SELECT vec_id AS image, i - 1 AS pos, {_CHANNEL.format(v='embedding[i]')} AS c FROM @embeddings CROSS JOIN RANGE(1, 65) r(i)",
}

_PIXELS = """
SELECT image, (pos {div} 3) {div} 7 AS y, (pos {div} 3) % 7 AS x, MAX(CASE WHEN pos % 3 = 0 THEN c END) AS c0,
       MAX(CASE WHEN pos % 3 = 1 THEN c END) AS c1, MAX(CASE WHEN pos % 3 = 2 THEN c END) AS c2
FROM (@@channels) t WHERE pos < 63 GROUP BY image, pos {div} 3"""
PIXELS = {"spark": _PIXELS.format(div="DIV"), "duckdb": _PIXELS.format(div="//")}
GRAY = {"spark": "SELECT image, pos DIV 8 AS y, pos % 8 AS x, c FROM (@@channels) t", "duckdb": "SELECT image, pos // 8 AS y, pos % 8 AS x, c FROM (@@channels) t"}
COLOR_DICT = "SELECT image AS idx, CONCAT('c', LPAD(CAST(image AS VARCHAR(10)), 2, '0')) AS name, c0 AS l0, c1 AS l1, c2 AS l2 FROM (@@pixels) t WHERE y = 0 AND x = 0 AND image < 32"
SIMILAR = """
SELECT a.name, b.name AS similar_name FROM (@@color_dict) a JOIN (@@color_dict) b ON b.idx = (a.idx + 1) % 32 OR b.idx = (a.idx + 7) % 32"""

# every word of every text; twelve words in a row are one image
_DETECTIONS = """
SELECT doc_id * 1000000000 + {chunk} AS image, pos, word AS ref_text,
       CASE WHEN (pos + doc_id) % 4 = 0 THEN NULL WHEN (pos + doc_id) % 6 = 1 THEN CONCAT(word, 'x') ELSE word END AS gen_text,
       ((doc_id * 37 + pos * 11) % 100) / 1e2 AS score,
       pos * 10 AS x1, (pos % 3) * 20 AS y1, CAST(pos * 10 + 6 * LENGTH(word) AS BIGINT) AS x2, (pos % 3) * 20 + 18 AS y2
FROM (SELECT doc_id, k, CAST(k % 12 + 1 AS BIGINT) AS pos, word FROM ({words}) w) v"""
DETECTIONS = {
    "spark": _DETECTIONS.format(chunk="k DIV 12", words="SELECT doc_id, CAST(k AS BIGINT) AS k, word FROM @documents LATERAL VIEW POSEXPLODE(SPLIT(text, ' ')) t AS k, word"),
    "duckdb": _DETECTIONS.format(chunk="k // 12", words="SELECT doc_id, UNNEST(RANGE(LEN(ws))) AS k, UNNEST(ws) AS word FROM (SELECT doc_id, STRING_SPLIT(text, ' ') AS ws FROM @documents) s"),
}

FEATURE_POSITIONS = """
SELECT p_partkey AS image, CAST(f.i AS BIGINT) AS i, ((p_partkey * 97 + f.i * 31) % 1000) / 1e3 AS position
FROM @part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS f(i)
WHERE (p_partkey + f.i) % 13 <> 0"""

ADAPTERS: dict[str, str | dict[str, str]] = {
    "eval_records": EVAL_RECORDS,
    "raw_judge": RAW_JUDGE,
    "source_samples": SOURCE_SAMPLES,
    "states": STATES,
    "chain_steps": CHAIN_STEPS,
    "channels": CHANNELS,
    "pixels": PIXELS,
    "gray": GRAY,
    "color_dict": COLOR_DICT,
    "color_similarity": SIMILAR,
    "detections": DETECTIONS,
    "feature_positions": FEATURE_POSITIONS,
}


def text_of(name: str, dialect: str) -> str:
    """An adapter's SQL with the adapters that it builds on put in."""
    found = ADAPTERS[name]
    sql = found if isinstance(found, str) else found[dialect]
    return re.sub(r"@@(\w+)", lambda m: text_of(m[1], dialect), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter as a DataFrame."""
    sql = text_of(name, "spark")
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for t in set(re.findall(r"@(\w+)", sql)):
        table(spark, sf_dir, t).createOrReplaceTempView(f"plotgauge_{t}_{mark}")
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"plotgauge_{m[1]}_{mark}", sql))


def with_ctes(names: list[str], sql: str) -> str:
    """DuckDB SQL over adapters as common table expressions; `sql` may go on with CTEs of its own after a leading comma."""
    ctes = ",\n".join(f"{n} AS ({text_of(n, 'duckdb').replace('@', '')})" for n in names)
    own, body = ("", sql) if not sql.lstrip().startswith(",") else (sql, "")
    return f"WITH RECURSIVE {ctes}\n{own or body}"
