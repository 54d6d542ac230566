"""Operator 3: mixing sources to target weights by hierarchical budgeting. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, write_table

#: Leaf plans up to this many rows are broadcast; beyond it Spark joins them by shuffle.
BROADCAST_LEAVES = 10_000


@dataclass(frozen=True)
class Mix:
    """Parameters of a mixture. Weights are whole numbers of one scale for each level; their sum stays below 10^4."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "books": 25, "code": 20, "wiki": 15})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other_weight: int = 1
    share_num: int = 4  # tokens to give out: this share of all tokens
    share_den: int = 5
    max_epochs: int = 2
    seed: int = 17
    bucket_digits: int = 3  # hex digits of the hash by which a leaf is cut into ranges


#: Names of the domains by the number at the end of a source's name, modulo their count; `other` where there is none.
DOMAIN_NAMES = ("web", "books", "code", "wiki")


def domain_of(source: Column) -> Column:
    number = F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAIN_NAMES)), number % len(DOMAIN_NAMES)), F.lit("other"))


def _weight(col: str, given: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in given.items():
        out = F.when(F.col(col) == name, w).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's `budget` among its children by weight, none above its `cap`; what a child can't take goes to its siblings.

    In order of cap by weight, a child is full if its share of what its forerunners leave reaches its cap; the others share the
    rest by weight, rounded down. Adds `given`. All windows run over nodes of the tree, never over documents.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("_cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)))
    order = w.orderBy(F.when(F.col("weight") > 0, F.col("_cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(0.0)), name)
    nodes = nodes.withColumn("_pre", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("_suf", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("_full", F.col("_cap") * F.col("_suf") <= F.col("weight") * (F.col("budget") - F.col("_pre")))
    nodes = nodes.withColumn("_pre1", F.min(F.when(~F.col("_full"), F.col("_pre"))).over(w)).withColumn("_suf1", F.max(F.when(~F.col("_full"), F.col("_suf"))).over(w))
    given = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("greatest(0L, (weight * (budget - _pre1)) div _suf1)"))
    return nodes.withColumn("given", given).drop("_cap", "_pre", "_suf", "_full", "_pre1", "_suf1")


def leaf_budgets(slim: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, target): tokens that each leaf of the tree has and is to give.

    A node's capacity is what its leaves have times `max_epochs`. Budgets go down the tree level by level, so a
    shortage is made up by siblings first and reaches an ancestor's siblings only where a whole subtree is short.
    """
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * mix.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    domains = domains.withColumn("_all", total).withColumn("budget", F.expr(f"(_all * {mix.share_num}) div {mix.share_den}")).withColumn("weight", _weight("domain", mix.domains, mix.other_weight))
    domains = fill(domains, [], "domain").select("domain", F.col("given").alias("budget"))
    langs = langs.join(domains, "domain").withColumn("weight", _weight("lang", mix.languages, mix.other_weight))
    langs = fill(langs, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    leaves = leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", mix.sources, mix.other_weight))
    return fill(leaves, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("given").alias("target"))


def _leaf(df: DataFrame) -> DataFrame:
    """Add the leaf's names; null language and source count as `und` and `none`."""
    return df.withColumn("lang_", F.coalesce("lang", F.lit("und"))).withColumn("source_", F.coalesce("source", F.lit("none"))).withColumn("domain", domain_of(F.col("source")))


def _draw(epoch: Column, id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit(""))))


def plan_mix(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(slim, plan): documents without their text, and what each leaf gives.

    slim: (doc_id, domain, lang, source, n_tokens); tokens are words. plan, by leaf: `epochs` whole passes, and of the
    next pass, in the order of its seeded hash, the longest prefix that doesn't exceed what remains: all of the ranges below
    `cut_range` and, in that range, what doesn't come after (`cut_key`, `cut_id`).
    """
    named = _leaf(docs.select("doc_id", "text", "lang", "source"))
    n_tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    slim = named.select("doc_id", "domain", F.col("lang_").alias("lang"), F.col("source_").alias("source"), n_tokens.alias("n_tokens"))
    slim = write_table(slim, "mix-slim")
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(slim, mix)
    budgets = budgets.withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN target div tokens ELSE 0L END"))
    budgets = write_table(budgets.withColumn("rest", F.expr("target - epochs * tokens")), "mix-leaves")
    keyed = slim.join(small(budgets), leaf).withColumn("_key", _draw(F.col("epochs"), F.col("doc_id"), mix.seed)).withColumn("_range", F.substring("_key", 1, mix.bucket_digits))
    # running totals over ranges of the hash, then row by row inside the one range that the cut falls into
    ranges = keyed.groupBy(*leaf, "_range").agg(F.sum("n_tokens").alias("_sum"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("_range")
    ranges = ranges.withColumn("_end", F.sum("_sum").over(run))
    cut = ranges.where("_end > rest").groupBy(*leaf).agg(F.min_by(F.struct("_range", (F.col("_end") - F.col("_sum")).alias("_before")), "_range").alias("_cut"))
    cut = write_table(cut.select(*leaf, F.col("_cut._range").alias("cut_range"), F.col("_cut._before").alias("_before")), "mix-cuts")
    inside = keyed.join(small(cut.withColumnRenamed("cut_range", "_range")), [*leaf, "_range"])
    id_ = F.coalesce("doc_id", F.lit(-(2**63)))
    inside = inside.withColumn("_id", id_).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(Window.partitionBy(*leaf, "_range").orderBy("_key", "_id")))
    last = inside.where("_upto <= rest").groupBy(*leaf).agg(F.max(F.struct("_key", "_id")).alias("_last"))
    plan = budgets.join(cut.drop("_before"), leaf, "left").join(last, leaf, "left").select(*leaf, "tokens", "target", "epochs", "cut_range", F.col("_last._key").alias("cut_key"), F.col("_last._id").alias("cut_id"))
    return slim, write_table(plan, "mix-plan")


def small(table: DataFrame, limit: int = BROADCAST_LEAVES) -> DataFrame:
    """Broadcast a written table that has been counted to be small; leave a larger one to a shuffled join."""
    return F.broadcast(table) if table.count() <= limit else table


def copies(mix: Mix) -> Column:
    """How often a row joined with its leaf's plan is taken."""
    key = _draw(F.col("epochs"), F.col("doc_id"), mix.seed)
    part = F.substring(key, 1, mix.bucket_digits)
    within = F.struct(key.alias("k"), F.coalesce("doc_id", F.lit(-(2**63))).alias("i")) <= F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("i"))
    taken = F.when(F.col("cut_range").isNull(), False).when(part < F.col("cut_range"), True).otherwise((part == F.col("cut_range")) & F.col("cut_key").isNotNull() & within)
    return (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("long")


def mix_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture: rows of `docs`, all columns, each as often as its leaf's epochs take it.

    Texts aren't shuffled: a row meets its leaf's plan, which is broadcast while it is small. Null texts have no
    tokens and go along with their leaf's prefix. Repeated rows are taken together or not at all.
    """
    _, plan = plan_mix(docs, mix)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "lang", "source")
    named = _leaf(row).select("_row", "doc_id", "domain", F.col("lang_").alias("lang"), F.col("source_").alias("source"))
    taken = named.join(small(plan), ["domain", "lang", "source"]).withColumn("_copies", copies(mix)).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    slim, plan = plan_mix(documents(spark, sf_dir), mix)
    return slim.join(small(plan), ["domain", "lang", "source"]).select("doc_id", "domain", "lang", "source", "n_tokens", copies(mix).alias("copies"))


def mix_sql(table: str, mix: Mix = Mix()) -> str:
    """DuckDB CTEs: mix_taken(doc_id, domain, lang, source, n_tokens, copies) of a table like documents."""

    def weight(col: str, given: dict[str, int]) -> str:
        return f"CASE {col} " + "".join(f"WHEN '{k}' THEN {v} " for k, v in given.items()) + f"ELSE {mix.other_weight} END" if given else str(mix.other_weight)

    def filled(name: str, nodes: str, parent: str, child: str, keep: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        order = f"{over} ORDER BY CASE WHEN weight > 0 THEN CAST(c AS DOUBLE) / weight ELSE 0 END, {child}"
        return f"""
{name}_a AS (SELECT *, CASE WHEN weight > 0 THEN cap ELSE 0 END AS c FROM {nodes}),
{name}_b AS (SELECT *, coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
                    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suf FROM {name}_a),
{name}_c AS (SELECT *, c * suf <= weight * (budget - pre) AS is_full FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN NOT is_full THEN pre END) OVER ({over}) AS pre1, max(CASE WHEN NOT is_full THEN suf END) OVER ({over}) AS suf1 FROM {name}_c),
{name} AS (SELECT {keep}, CASE WHEN is_full THEN c ELSE greatest(0, (weight * (budget - pre1)) // suf1) END AS given FROM {name}_d)"""

    names = ", ".join(f"'{x}'" for x in DOMAIN_NAMES)
    return rf"""
mix_slim AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
         coalesce(([{names}])[TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % {len(DOMAIN_NAMES)} + 1], 'other') AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS n_tokens
  FROM {table}),
mix_leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {mix.max_epochs} AS HUGEINT) AS cap FROM mix_slim GROUP BY ALL),
mix_n1 AS (SELECT domain, sum(cap) AS cap, (sum(sum(tokens)) OVER () * {mix.share_num}) // {mix.share_den} AS budget, {weight("domain", mix.domains)} AS weight FROM mix_leaf GROUP BY domain),
{filled("mix_f1", "mix_n1", "", "domain", "domain")},
mix_n2 AS (SELECT l.domain, lang, sum(cap) AS cap, any_value(f.given) AS budget, {weight("lang", mix.languages)} AS weight FROM mix_leaf l JOIN mix_f1 f ON f.domain = l.domain GROUP BY l.domain, lang),
{filled("mix_f2", "mix_n2", "domain", "lang", "domain, lang")},
mix_n3 AS (SELECT l.domain, l.lang, source, tokens, cap, f.given AS budget, {weight("source", mix.sources)} AS weight FROM mix_leaf l JOIN mix_f2 f ON f.domain = l.domain AND f.lang = l.lang),
{filled("mix_f3", "mix_n3", "domain, lang", "source", "domain, lang, source, tokens")},
mix_plan AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs FROM mix_f3),
mix_keyed AS (
  SELECT s.doc_id, s.domain, s.lang, s.source, s.n_tokens, p.epochs, p.given - p.epochs * p.tokens AS rest,
         md5(concat('{mix.seed}:', CAST(p.epochs AS VARCHAR), ':', coalesce(CAST(s.doc_id AS VARCHAR), ''))) AS k
  FROM mix_slim s JOIN mix_plan p ON p.domain = s.domain AND p.lang = s.lang AND p.source = s.source),
mix_run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id) AS upto FROM mix_keyed),
mix_taken AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM mix_run)"""


OP3_SQL = f"WITH {mix_sql('documents')} SELECT * FROM mix_taken"
