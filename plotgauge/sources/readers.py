"""Readers: evaluation trees, result files, tables of constants, images, prompts."""

from __future__ import annotations

import os
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import WAVES, scratch, shared_folder

RECORD = T.StructType(
    [
        T.StructField("error_count", T.LongType()),
        T.StructField("ocr_f1", T.DoubleType()),
        T.StructField("color_iou", T.DoubleType()),
        T.StructField("gpt_evaluation", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: Files of one evaluated sample.
FILES = ("gen.html", "orig.png", "eval.png", "gen.png")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of text files, each as one row with every character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("value"))


#: Columns of Spark's binary files.
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def in_few_tasks(files: DataFrame) -> DataFrame:
    """Files read by a few tasks for each core: Spark counts a small file as 4 MB, so that a tree of them would become a task for every few files. Rows are streamed, so a task's size doesn't matter."""
    return files.coalesce(WAVES * files.sparkSession.sparkContext.defaultParallelism)


def tree_paths(spark: SparkSession, root: str, names: tuple[str, ...], partitioned: bool = False) -> DataFrame:
    """(names..., content) of the files of a tree with one folder level for each name, the last one being the file itself.

    A tree that Spark has written by these names as partition columns is read by its partitions: a filter on a name then leaves out
    folders before any of their files is opened. Otherwise names come out of the paths. A file is opened only if its content is selected.
    Spark leaves out files of no bytes, so an empty file counts as absent.
    """
    reader = spark.read.format("binaryFile")
    if partitioned:
        return in_few_tasks(reader.schema(_BINARY + "".join(f", `{n}` string" for n in names)).load(root)).select(*names, "content")
    # Spark gives the paths of binary files as they are, without escapes
    parts = F.slice(F.split("path", "/"), -len(names), len(names))
    files = in_few_tasks(reader.option("recursiveFileLookup", "true").load(root))
    return files.select(*[parts[k].alias(n) for k, n in enumerate(names)], "content")


def _visible(name: bytes) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_"))


def _value(name: bytes) -> str | None:
    """What stands behind `=` in a partition's folder, without escapes."""
    value = unquote(name.partition(b"=")[2].decode("utf-8", "replace"))
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def list_tree(spark: SparkSession, folder: str, names: tuple[str, ...], partitioned: bool = False) -> DataFrame:
    """(names..., _path) of the files of a tree in a folder that all tasks see. Each level is listed by tasks that share its folders, so that
    neither the driver nor one task holds the list. Files of no bytes are left out, as by Spark's readers."""
    files = spark.range(1).select(F.lit(folder).cast("binary").alias("_path"))

    def level(at: list[str], named: bool, last: bool):
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "_path" else pa.string()) for n, c in zip(at, zip(*rows))], names=at)

        def run(batches):
            rows = []
            for batch in batches:
                for *above, path in zip(*(c.to_pylist() for c in batch.columns)):
                    with os.scandir(path) as found:
                        for e in found:
                            if _visible(e.name) and (e.is_file() and e.stat().st_size > 0 if last else e.is_dir()):
                                own = [_value(e.name) if partitioned else e.name.decode("utf-8", "replace")] if named else []
                                rows.append((*above, *own, e.path))
                                if len(rows) == 1000:
                                    yield table(rows)
                                    rows = []
            if rows:
                yield table(rows)

        return run

    for k in range(len(names) + partitioned):
        named, last = k < len(names), k == len(names) - (not partitioned)
        at = [*names[: k + named], "_path"]
        dealt = files.repartition(WAVES * spark.sparkContext.defaultParallelism, "_path") if k else files
        files = dealt.mapInArrow(level(at, named, last), "".join(f"`{n}` string, " for n in at[:-1]) + "_path binary")
    return files


#: Bytes of contents that go from Python to Spark at once, if it is more than one file.
_CONTENTS = 4 << 20


def tree_files(spark: SparkSession, root: str, names: tuple[str, ...], partitioned: bool = False, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(names..., content) like `tree_paths`, for large trees: where the root is a folder that all tasks see, they list and read it themselves, and
    nothing is kept for each file on the driver. With `wanted`, only files of these names (the last one) are opened, content is null for others."""
    folder = shared_folder(spark, root)
    if folder is None or not os.path.isdir(folder):
        files = tree_paths(spark, root, names, partitioned)
        if wanted is None:
            return files
        named = F.col(names[-1]).isin(*wanted)
        if partitioned:
            rows = files.where(named)
        else:  # the same folder twice: names from paths, contents from the wanted kinds of files only
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(wanted) + "}").load(root)
            parts = F.slice(F.split("path", "/"), -len(names), len(names))
            rows = in_few_tasks(found).select(*[parts[k].alias(n) for k, n in enumerate(names)], "content")
        return rows.unionByName(files.where(~named).select(*names, F.lit(None).cast("binary").alias("content")))

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for *values, path in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if wanted is None or values[-1] in wanted:
                    with open(path, "rb") as f:
                        content = f.read()
                rows.append((*values, content))
                size += len(content or b"")
                if size >= _CONTENTS:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*[pa.string()] * len(names), pa.binary()])], names=[*names, "content"])

    return list_tree(spark, folder, names, partitioned).mapInArrow(run, "".join(f"`{n}` string, " for n in names) + "content binary")


def read_eval_tree(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """(model, task, sample, has_<file>...) of a tree root/model/task/sample/file. Only paths are read, not contents."""
    names, folder = ("model", "task", "sample", "file"), shared_folder(spark, root)
    if folder is None or not os.path.isdir(folder):
        return listing(tree_paths(spark, root, names, partitioned).drop("content"))
    return listing(list_tree(spark, folder, names, partitioned))


def listing(files: DataFrame) -> DataFrame:
    """Which of a sample's files exist, from rows (model, task, sample, file)."""
    flags = [F.bool_or(F.col("file") == f).alias("has_" + f.replace(".", "_")) for f in FILES]
    return files.groupBy("model", "task", "sample").agg(*flags)


def pick_reference_image(samples: DataFrame) -> DataFrame:
    """Add `reference`: eval.png, else orig.png if there is a gen.png, and `reject`, the reason why a sample can't be evaluated, or null."""
    reference = F.when(F.col("has_eval_png"), "eval.png").when(F.col("has_gen_png") & F.col("has_orig_png"), "orig.png")
    reject = F.when(~F.col("has_gen_html"), "no gen.html").when(reference.isNull(), "no reference image").when(~F.col("has_gen_png"), "no gen.png")
    return samples.withColumn("reference", reference).withColumn("reject", reject)


def read_sample_tree(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """(sample, html, js) of a tree root/sample/{chart.html, code.js, ...}; null for an absent file. Of other files, such as pictures, nothing but the path is read."""
    files = tree_files(spark, root, ("sample", "file"), partitioned, ("chart.html", "code.js"))
    rows = files.select("sample", "file", F.decode("content", "UTF-8").alias("value"))
    return rows.groupBy("sample").agg(F.max(F.when(F.col("file") == "chart.html", F.col("value"))).alias("html"), F.max(F.when(F.col("file") == "code.js", F.col("value"))).alias("js"))


def flatten_results(files: DataFrame, column: str = "value") -> DataFrame:
    """Rows of whole result files {model: {task: {sample: record}}} as flat records; a file that is no JSON raises.

    A file is parsed once and opened level by level, so that no row holds a map of a whole model beside it. Fields that a record lacks,
    or that are of another kind, are null.
    """
    tvf = files.sparkSession.tvf
    rows = files.select(F.parse_json(column).alias("_f"))
    for level, name in (("_f", "model"), ("_t", "task"), ("_s", "sample")):
        inner = {"model": "_t", "task": "_s", "sample": "_r"}[name]
        opened = tvf.variant_explode(F.col(level).outer()).select(F.col("key").alias(name), F.col("value").alias(inner))
        rows = rows.lateralJoin(opened).select(*[c for c in rows.columns if c != level], name, inner)
    fields = [F.try_variant_get("_r", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in RECORD.fields]
    return rows.where("sample IS NOT NULL").select("model", "task", "sample", *fields)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    return flatten_results(whole_texts(spark, path))


def read_model_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(feature, coefficient) of a CSV file; fails if a column is absent."""
    table = spark.read.csv(path, header=True)
    missing = {"Feature", "coefficient"} - set(table.columns)
    if missing:
        raise ValueError(f"the coefficient file lacks {sorted(missing)}")
    return table.select(F.col("Feature").alias("feature"), F.col("coefficient").cast("double").alias("coefficient"))


def lab_array(text: Column) -> Column:
    """`[53 80 67]` as an array of whole numbers."""
    return F.split(F.trim(F.translate(text, "[],", "   ")), r"\s+").cast("array<int>")


def name_list(text: Column) -> Column:
    """A printed list of quoted names as an array."""
    return F.regexp_extract_all(text, F.lit(r"'([^']*)'"), 1)


def read_color_dict(spark: SparkSession, path: str) -> DataFrame:
    """(idx, color_name, lab) of a CSV file; parsed once, so every use sees the same values. Without a column `idx`, the line's place in the file counts."""
    columns = spark.read.csv(path, header=True).columns
    lines = whole_texts(spark, path).select(F.posexplode(F.split("value", r"\r?\n")).alias("_at", "_line")).where("_at > 0 AND _line <> ''")
    rows = lines.select("_at", F.from_csv("_line", ", ".join(f"`{c}` string" for c in columns)).alias("_r"))
    idx = F.col("_r.idx").cast("long") if "idx" in columns else (F.col("_at") - 1).cast("long")
    return rows.select(idx.alias("idx"), F.col("_r.Color_Name").alias("color_name"), lab_array(F.col("_r.`LAB(OpenCV)`")).alias("lab"))


def read_color_similarity(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(F.col("Color_name").alias("color_name"), name_list(F.col("Similar_name")).alias("similar"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, height, width, channels, data): decoded images of a folder and those below it; three channels are blue, green, red by row."""
    return in_few_tasks(spark.read.format("image").option("recursiveFileLookup", "true").load(path)).select(F.col("image.origin").alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _bitmap(name: str | None, content: bytes) -> tuple[int, int, bytes]:
    """Height, width and pixels by row (blue, green, red) of a bitmap of 24 bits without compression."""
    number = lambda at, size=4: int.from_bytes(content[at : at + size], "little", signed=True)
    w, h = number(18), number(22)
    line = (w * 3 + 3) // 4 * 4
    if content[:2] != b"BM" or number(14) < 40 or number(28, 2) != 24 or number(30) != 0 or w < 1 or len(content) < number(10) + abs(h) * line:
        raise ValueError(f"{name!r} is no whole 24-bit bitmap; read_images reads other kinds")
    rows = np.frombuffer(content, np.uint8, abs(h) * line, number(10)).reshape(abs(h), line)[:, : w * 3]
    return abs(h), w, (rows if h < 0 else rows[::-1]).tobytes()  # lines go from bottom to top, unless the height is negative


def read_bitmaps(files: DataFrame, name: str = "image") -> DataFrame:
    """(image, height, width, channels, data) as from `read_images`, of the files that ``writers.bitmaps`` makes, given as (image, content). Spark's image source
    makes a serializer for each file anew, some milliseconds of each. Any other kind of file raises."""

    def run(batches):
        for batch in batches:
            names, found = batch.column(0), [_bitmap(n, c) for n, c in zip(*(batch.column(k).to_pylist() for k in range(2)))]
            if found:
                h, w, data = zip(*found)
                yield pa.RecordBatch.from_arrays([names, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array([3] * len(h), pa.int32()), pa.array(data, pa.binary())], names=["image", "height", "width", "channels", "data"])

    return files.select(F.col(name).cast("string").alias("image"), "content").mapInArrow(run, "image string, height int, width int, channels int, data binary")


def pixels(images: DataFrame) -> DataFrame:
    """(image, y, x, c0, c1, c2) of three-channel images, unpacked in batches."""

    def run(batches):
        for batch in batches:
            for name, h, w, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a = np.frombuffer(data, np.uint8).reshape(h * w, 3).astype(np.int64)
                y, x = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (h * w)), *(pa.array(v) for v in (y, x, a[:, 0], a[:, 1], a[:, 2]))], names=["image", "y", "x", "c0", "c1", "c2"])

    rows = images.where("channels = 3").select("image", "height", "width", "data")
    return rows.mapInArrow(run, "image string, y long, x long, c0 long, c1 long, c2 long")


def color_counts(images: DataFrame) -> DataFrame:
    """(image, c0, c1, c2, n): pixels of each colour, counted inside the batch before anything is shuffled."""

    def run(batches):
        for batch in batches:
            found, size = [], 0
            for at, data in enumerate(batch.column(1).to_pylist()):
                a = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
                found.append((at, *np.unique(a[:, 0] << 16 | a[:, 1] << 8 | a[:, 2], return_counts=True)))
                size += len(found[-1][1])
                if size >= 100_000:  # many small images go back to Spark at once
                    yield table(batch.column(0), found)
                    found, size = [], 0
            if found:
                yield table(batch.column(0), found)

    def table(names, found):
        at, code, n = zip(*found)
        where = np.repeat(at, [len(c) for c in code])
        code, n = np.concatenate(code), np.concatenate(n)
        return pa.RecordBatch.from_arrays([names.take(pa.array(where, pa.int64())), *(pa.array(v) for v in (code >> 16, code >> 8 & 255, code & 255, n))], names=["image", "c0", "c1", "c2", "n"])

    return images.where("channels = 3").select("image", "data").mapInArrow(run, "image string, c0 long, c1 long, c2 long, n long")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, template) of a folder of text files."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return whole_texts(spark, path).select(name.alias("name"), F.col("value").alias("template"))


def sample_order(samples: DataFrame, name: str = "sample") -> DataFrame:
    """(sample, position): folders in the order of their numbers. Names that are no number come last, by name.

    Names are dealt by ranges of that order; a position is the place inside its range plus the sizes of the ranges before. The ranges are
    written, so that both see the same ones.
    """
    order = [F.expr(f"try_cast(`{name}` AS BIGINT)").asc_nulls_last(), F.col(name).asc()]
    dealt = samples.select(name).distinct().repartitionByRange(*order).select(name, F.spark_partition_id().alias("_range"))
    at = scratch(samples.sparkSession, "sample-ranges")
    dealt.write.parquet(at)
    rows = samples.sparkSession.read.schema(dealt.schema).parquet(at)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    ahead = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(ahead, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(sizes, "_range").select(name, (F.col("_before") + place - 1).cast("long").alias("position"))


def read_sample_order(spark: SparkSession, path: str) -> DataFrame:
    """(sample, position) as a summary file (a JSON list of records) lists them."""
    rows = whole_texts(spark, path).select(F.parse_json("value").alias("_l"))
    listed = rows.lateralJoin(spark.tvf.variant_explode(F.col("_l").outer()))
    return listed.select(F.try_variant_get("value", "$.sample", "string").alias("sample"), F.col("pos").cast("long").alias("position"))
