"""The corpus pipeline: five stages over `documents`, each one of the operators in plotgauge.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns they were given, extra ones included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotgauge.llm import language_id, line_dedup, mixing, near_dedup, piece_codec
from plotgauge.llm.common import WORD, write_table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty ones too) and those whose best language stays below 0.3; fill in a null lang.

    Without any labelled document no language is known, and only the letters count.
    """
    model = language_id.train(docs)
    if not model.labels:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= model.p.least_score))
    return _unpacked(found, docs, lang=F.coalesce("row.lang", "lang_pred"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines out of the texts; drop documents of which no word is left."""
    done = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _unpacked(done, docs, **new)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of smallest id; of rows with the same id, the one of least text. Rows of null id stay."""
    found = write_table(near_dedup.near_components(docs).select("doc_id", "kept"), "near")
    # written by itself, so that Spark knows its size: while it is small it goes to the texts, not the texts through a shuffle
    gone = write_table(found.where("NOT kept").select("doc_id").distinct(), "near-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")
    left = rows.join(gone, "doc_id", "left_anti")
    again = write_table(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-again")
    if again.limit(1).count() == 0:
        return _unpacked(left, docs)
    # only rows whose id repeats are ranked; those of null id aren't among them
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    ranked = left.join(again, "doc_id", "left_semi").withColumn("place", first).where("place = 1").drop("place")
    return _unpacked(left.join(again, "doc_id", "left_anti").unionByName(ranked), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mixture's target weights say: not at all, once or, where its leaf is short, again."""
    return mixing.mix_rows(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    return piece_codec.encode_pieces(docs, public_tokenizers.path(piece_codec.MODEL))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("encode", encode_stage),
]

#: A trained classifier and a tokenizer can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` from the struct `row`, some of them replaced. Helper columns stand beside the struct, so that no name of `docs` clashes with theirs."""
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
