"""Operator 1: near-duplicate documents from bottom-k sketches of one hash function."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashMemo, bytes_of, documents, give_back, map_texts, mix, window_hashes, write_table
from .components import connected_components


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    percent: int = 75  # Jaccard similarity of a link, at least
    sketch: int = 64  # values retained for estimates
    listed: int = 32  # of these, the values whose inverted lists are made
    need: int = 11  # of these, those that linked sets have in common: fewer with a chance of about 2 * 10^-7 right at the threshold
    pairs_list: int = 16  # longest inverted list whose pairs are all made
    block: int = 512  # documents of a block where a longer list is compared, at most,
    block_values: int = 1 << 20  # and about so many values of theirs
    slack: float = 5.0  # standard deviations by which an estimate may fall short
    exact: bool = False  # list so many values of each set that every linked pair meets, and let no estimate drop any


def shingle_set(raw: bytes, memo: HashMemo, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as lower case, fewer words make one shingle."""
    h = memo.of_text(raw.lower())
    if not len(h):
        return np.empty(0, np.int64)
    out = window_hashes(h, min(words, len(h)))
    with np.errstate(over="ignore"):  # a short text's one shingle is no other text's full one
        out = mix(out + np.uint64(min(words, len(h))))
    return np.unique(out.view(np.int64))


def signature(values: np.ndarray) -> tuple[int, int]:
    """Two sums by which equal sets are known."""
    u = values.view(np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(u).sum(dtype=np.uint64).view(np.int64)), int(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def least_shown(n: int, p: NearParams) -> int:
    """Of a set of n <= `listed` values, the fewest that also stand in the list of a linked partner: one of m values shares
    percent * (n + m) / (100 + percent) or more, of which it may leave out m - `listed`."""
    sizes = range(-(-n * p.percent // 100), n * 100 // p.percent + 1)
    return max(1, min(-(-p.percent * (n + m) // (100 + p.percent)) - max(0, m - p.listed) for m in sizes))


def prefix(n: int, percent: int) -> int:
    """How many of a set's n values, the lowest ones, must be listed so that every linked set has one of them: all but the least overlap, and one."""
    return n - -(-n * percent // 100) + 1


def sketches(rows: DataFrame, p: NearParams) -> DataFrame:
    """(id, n, s1, s2, sketch) of rows (id, text as bytes)."""

    def run(batches):
        memo = HashMemo()
        for batch in batches:
            n, s1, s2, parts = [], [], [], []
            for raw in batch.column(1):
                values = shingle_set(raw.as_py(), memo, p.words)
                memo.trim()
                a, b = signature(values)
                n.append(len(values))
                s1.append(a)
                s2.append(b)
                parts.append(values[: max(p.sketch, prefix(len(values), p.percent) if p.exact else 0)].copy())
            ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["id", "n", "s1", "s2", "sketch"])

    return map_texts(rows, run, "id long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(rows: DataFrame, wanted: DataFrame, p: NearParams) -> DataFrame:
    """(id, values): the whole shingle sets of the wanted (id, s1, s2)."""
    joined = rows.join(wanted, "id").select("id", "text", "s1", "s2")

    def run(batches):
        memo = HashMemo()
        for batch in batches:
            keep, parts, size = [], [], 0

            def made():
                ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], names=["id", "values"])

            for i, raw in enumerate(batch.column(1)):
                values = shingle_set(raw.as_py(), memo, p.words)
                memo.trim()
                if signature(values) == (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()):
                    keep.append(i)
                    parts.append(values)
                    size += len(values)
                if size > p.block_values:
                    yield made()
                    keep, parts, size = [], [], 0
            if keep:
                yield made()

    return map_texts(joined, run, "id long, values array<long>")


def least_estimate(p: NearParams) -> float:
    """The least estimate of a pair that may be linked."""
    t = p.percent / 100
    return -1.0 if p.exact else t - p.slack * math.sqrt(t * (1 - t) / p.sketch)


def _estimated(pairs: DataFrame, known: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated on the lowest `sketch` values of both sketches together, may reach the threshold."""
    a = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, p.sketch)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.where(shared >= F.size(union) * F.lit(least_estimate(p))).select("a", "b").distinct()


def _common(values: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one side with each of the other; the sets of a side come one after another."""
    owners = [np.repeat(np.arange(len(s)), s) for s in sizes]
    shared = np.intersect1d(*values)
    out = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    codes = [np.searchsorted(shared, v) for v in values]
    for part in (0, 1):
        c = np.minimum(codes[part], max(len(shared) - 1, 0))
        ok = shared[c] == values[part] if len(shared) else np.zeros(len(c), bool)
        codes[part], owners[part] = c[ok], owners[part][ok]
    for low in range(0, len(shared), 4096):  # a slice of the values at a time keeps the matrices small
        width, m = min(4096, len(shared) - low), []
        for part in (0, 1):
            d = np.zeros((len(sizes[part]), width), np.float32)
            ok = (codes[part] >= low) & (codes[part] < low + width)
            d[owners[part][ok], codes[part][ok] - low] = 1
            m.append(d)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def _sides(pdf: pd.DataFrame, column: str):
    """Stragglers and members of a pair of blocks, with their sets one after another; None if a side is empty."""
    x, y = pdf[pdf["straggler"]], pdf[~pdf["straggler"]]
    if x.empty or y.empty:
        return None
    return x, y, [np.concatenate(part[column].to_numpy()) for part in (x, y)], [np.array([len(v) for v in part[column]]) for part in (x, y)]


def _block_candidates(p: NearParams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Documents of one pair of blocks whose sketch may make them linked with one of the other side and another component. What leaves a task are documents, never pairs."""
        keys = ["hub", "x", "y", "id", "component", "straggler"]
        sides = _sides(pdf, "sketch")
        if sides is None:
            return pdf.loc[[], keys]
        x, y, values, sizes = sides
        inter = _common(values, sizes)
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None]
        least = least_estimate(p)
        # values common to both sketches are no fewer than those in the union's sketch
        may = (inter >= least * np.minimum(p.sketch, np.maximum(n, m))) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * p.percent) & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None])
        wanted = [np.zeros(len(x), bool), np.zeros(len(y), bool)]
        sx, sy = x["sketch"].to_numpy(), y["sketch"].to_numpy()
        for i, j in zip(*np.nonzero(may)):
            if wanted[0][i] and wanted[1][j]:
                continue
            union = np.union1d(sx[i], sy[j])[: p.sketch]
            if len(np.intersect1d(np.intersect1d(sx[i], sy[j]), union)) >= least * len(union):
                wanted[0][i] = wanted[1][j] = True
        give_back()
        return pd.concat([x.loc[wanted[0], keys], y.loc[wanted[1], keys]])

    return run


def _block_links(p: NearParams):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the stragglers and the members of one pair of blocks, on full sets: one for each straggler and component."""
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        sides = _sides(pdf, "values")
        if sides is None:
            return none
        x, y, values, sizes = sides
        inter = _common(values, sizes)
        union = sizes[0][:, None] + sizes[1][None] - inter
        cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
        i, j = np.nonzero((100 * inter >= p.percent * union) & (cx[:, None] != cy[None]))
        found = pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j], "c": cy[j]})
        give_back()
        return found.groupby(["a", "c"], as_index=False)["b"].min()[["a", "b"]] if len(found) else none

    return run


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearParams = NearParams()) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Documents are linked if their shingle sets' Jaccard similarity reaches the threshold; `component_id` is the smallest id
    reachable, `kept` marks it. A null or wordless text has no shingles and no links. A row of null id is linked with
    nothing, has a null component and is kept. Rows of the same id are one document: links of any of them are its links.
    Other columns are left out, whatever their names.

    1. Equal sets are one class, known by its smallest id. 2. The lowest values of bottom-k sketches make inverted lists of classes;
    a class that shares too few of its values to be linked is dropped, and of a class's shared values only the rarest are
    listed: two classes with `need` values in common still meet in one when each leaves out its need - 1 most frequent. 3. Lists up to
    `pairs_list` long give all their pairs, longer ones pair each class with the list's first. 4. The sketches' union
    estimates each pair; full sets decide. 5. In longer lists, classes that are not in the component of the first are
    compared with all the others block by block: first on sketches, which leaves documents that may have a link there, then those
    on full sets, which leaves links that join components. No pairs of a group ever leave a task.

    With ``exact=True`` nothing rests on chance: as many of the lowest values are listed as any linked pair must meet in
    (a quarter of a set), and no estimate drops a pair.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), bytes_of(text_col).alias("text"))
    known = write_table(sketches(rows, p), "sketches")
    usable = known.where("n > 0 AND id IS NOT NULL")
    # equal sets have equal sketches, so any one of them will do
    classes = usable.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = write_table(classes, "classes")

    n = F.col("n").cast("int")
    if p.exact:
        listed, need = n - F.ceil(n * p.percent / 100).cast("int") + 1, F.lit(1)
    else:
        shown = F.array(*[F.lit(min(p.need, least_shown(k, p))) for k in range(1, p.listed + 1)])
        listed, need = F.lit(p.listed), F.when(n <= p.listed, F.get(shown, n - 1)).otherwise(p.need)
    # tables that are joined by value are written, so that Spark can split the rows of a hot value
    keys = classes.select("id", need.alias("need"), F.explode(F.slice("sketch", F.lit(1), listed)).alias("value"))
    often = write_table(keys.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    shared = keys.join(often, "value").groupBy("id").agg(F.min("need").alias("need"), F.array_sort(F.collect_list(F.struct("f", "value"))).alias("low"))
    rare = F.slice("low", F.lit(1), F.size("low") - F.col("need") + 1)
    alive = write_table(shared.where(F.size("low") >= F.col("need")).select("id", F.transform(rare, lambda x: x["value"]).alias("low")), "alive")
    keys = alive.select("id", F.explode("low").alias("value"))
    lists = write_table(keys.groupBy("value").agg(F.count(F.lit(1)).alias("f"), F.min("id").alias("hub")).where("f > 1"), "list-sizes")
    keys = write_table(keys.join(lists, "value"), "lists")
    short = keys.where(F.col("f") <= p.pairs_list).select("value", "id")
    pairs = short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "value").where("a < b").select("a", "b")
    groups = write_table(keys.where(F.col("f") > p.pairs_list).select("hub", "id").distinct(), "groups")
    pairs = pairs.unionByName(groups.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))).distinct()
    lasting = classes.join(alive.select("id"), "id", "left_semi").select("id", "n", "sketch")
    pairs = write_table(_estimated(pairs, lasting, p), "pairs")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(groups.select("id")).distinct()
    sets = write_table(full_sets(rows, classes.select("id", "s1", "s2").join(ids, "id", "left_semi"), p), "sets")
    a, b = sets.select(F.col("id").alias("a"), F.col("values").alias("va")), sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
    inter = F.size(F.array_intersect("va", "vb"))
    verified = pairs.join(a, "a").join(b, "b").where(inter * 100 >= (F.size("va") + F.size("vb") - inter) * p.percent).select("a", "b")
    links = write_table(verified, "links")
    parts = connected_components(links)

    # the stragglers of long lists against all of their lists
    member = groups.unionByName(groups.select("hub", F.col("hub").alias("id"))).distinct()
    member = member.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    member = member.join(hub, "hub", "left").withColumn("straggler", F.col("component") != F.coalesce("hub_component", "hub")).drop("hub_component")
    member = member.join(lasting, "id")
    late = lambda c: F.when(F.col("straggler"), c).otherwise(0)
    many = lambda count, values: F.ceil(F.greatest(F.sum(count) / p.block, F.sum(values) / p.block_values))
    blocks = member.groupBy("hub").agg(many(F.lit(1), F.col("n")).alias("mb"), many(late(F.lit(1)), late(F.col("n"))).alias("sb")).where("sb > 0")
    blocks = write_table(blocks, "blocks")  # a plain table, so that Spark can split a large group's rows in the join
    member = write_table(member.join(blocks, "hub"), "members")
    own = F.xxhash64("id")
    row = ["hub", "id", "component", "n", "sketch"]
    as_member = member.select(*row, F.lit(False).alias("straggler"), F.pmod(own, "mb").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sb") - 1)).alias("x"))
    as_straggler = member.where("straggler").select(*row, "straggler", F.pmod(own, "sb").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("y"))
    tasks = as_member.unionByName(as_straggler).groupBy("hub", "x", "y")
    found = write_table(tasks.applyInPandas(_block_candidates(p), "hub long, x long, y long, id long, component long, straggler boolean"), "candidates")
    more = found.join(sets, "id").groupBy("hub", "x", "y").applyInPandas(_block_links(p), "a long, b long")
    more = write_table(more, "more-links")
    if more.limit(1).count():
        parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    rep = classes.where("size > 1").select("s1", "s2", F.col("id").alias("rep"))
    out = known.select("id", "n", "s1", "s2").join(rep, ["s1", "s2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = out.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
