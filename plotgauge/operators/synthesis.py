"""Datasets to be synthesised: which samples, which prompts, which pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_count


def line_count_filter(df: DataFrame, text: str, max_lines: int = 200) -> DataFrame:
    return df.where(line_count(F.col(text)) <= max_lines)


def take_first_samples(df: DataFrame, n: int, name: str = "sample") -> DataFrame:
    """The first n samples by name, as text; 0 takes all."""
    return df.orderBy(F.col(name).cast("string")).limit(n) if n else df


def render_prompts(df: DataFrame, template: str, columns: dict[str, str], out: str = "prompt") -> DataFrame:
    """Fill a template's slots: `{}` or `{name}` by the columns in their order, each slot once."""
    text: Column = F.lit(template)
    for slot, column in columns.items():
        found = F.instr(text, slot)
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        filled = F.concat(F.substring(text, F.lit(1), found - 1), value, F.substring(text, found + len(slot), F.length(text)))
        text = F.when(found > 0, filled).otherwise(text)
    return df.withColumn(out, text)


def sample_transfer_pairs(df: DataFrame, k: int = 3, seed: int = 11, name: str = "sample", digits: int = 2) -> DataFrame:
    """(sample, to_sample): k different partners drawn for each sample from all, of which itself is then dropped, so k or k - 1; none if there are fewer than k samples.

    Samples get a dense order by the hash of their name: ranks inside 16^digits hash ranges, plus the sizes of the ranges before. Partners
    are found at different hashed offsets from there, by equi-join, never by pairing all with all.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))
    rows = df.select(name).distinct().withColumn("_h", digest).withColumn("_s", F.substring("_h", 1, digits))
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.select("_s", ahead.alias("_before"), total.alias("_total"))  # a row for each range
    placed = rows.join(sizes, "_s").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy("_h", name)) - 1)
    offsets: list[Column] = []
    for i in range(1, k + 1):
        hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"), F.lit(f":{i}"))), 1, 8), 16, 10).cast("long")
        place = F.pmod(hashed, F.col("_total") + 1 - i)  # among those not drawn yet
        if offsets:
            place = F.aggregate(F.array_sort(F.array(*offsets)), place, lambda at, drawn: F.when(at >= drawn, at + 1).otherwise(at))
        offsets.append(place)
    asked = placed.where(F.col("_total") >= k).select(name, "_total", "_at", F.explode(F.array(*offsets)).alias("_offset"))
    asked = asked.select(name, F.pmod(F.col("_at") + F.col("_offset"), F.col("_total")).alias("_to"))
    return asked.join(placed.select(F.col("_at").alias("_to"), F.col(name).alias("to_sample")), "_to").where(F.col(name) != F.col("to_sample")).select(name, "to_sample")
