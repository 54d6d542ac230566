"""Writers of evaluation records, and folders for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: dict[str, list[str]] = {}


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Persist records by model and task. Only the partitions that `df` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "task").format(kind).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary as JSON lines."""
    df.write.mode("overwrite").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can both write. ``drop_scratch`` deletes it, at the session's end at the latest."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/plotgauge-shared"
    path = f"{root.rstrip('/')}/plotgauge-tables/{uuid.uuid4().hex}-{name}"
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(drop_scratch, spark)
    _MADE[app].append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the folders of ``scratch`` that this session has made; call it when no result that reads them is still wanted."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for path in _MADE.pop(sc.applicationId, []):
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the gateway may already be gone when the interpreter ends
            return


#: Characters that a folder named after a value holds as an escape; Spark reads them back.
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def shared_folder(spark: SparkSession, root: str) -> str | None:
    """The path of a root that is a folder to all tasks; null on any other file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


#: Tasks for each core that write or read a tree of small files.
WAVES = 8


def write_tree(files: DataFrame, root: str, names: tuple[str, ...], plain: bool = False) -> bool:
    """Write rows (names..., value) as files below a folder for each name, as Spark's text writer does: names are escaped, and a value ends with a line feed.

    Where the root is a folder that all tasks see, they write the files themselves: Spark's writer starts processes for the permissions of each
    file there, and its commit moves files one by one. On any other file system Spark's writer is used. A file appears with all of its content or not at all, and
    a task that runs again writes the same ones. Rows of equal names are lines of one file.

    `plain`: folders have the names as they are, and the last name is the file itself, which saves a folder for each file; a name that can't be one
    raises. Spark's writer can't do that. Returns whether the folders are partitions, as the readers want to know.
    """
    spark, folder, count = files.sparkSession, shared_folder(files.sparkSession, root), len(names)
    if folder is None:
        files.write.partitionBy(*names).text(root)
        return True

    def write(batches):
        written, made = set(), set()
        for batch in batches:
            for *values, content in zip(*(c.to_pylist() for c in batch.columns)):
                if plain:
                    own, path = "/".join([folder, *map(_plain, values[:-1])]), _plain(values[-1])
                else:
                    own, path = "/".join([folder, *(f"{n}={_folder(v)}" for n, v in zip(names, values))]), "part-0.txt"
                path, content = f"{own}/{path}", (content or b"") + b"\n"
                if path in written:
                    with open(path, "rb") as f:
                        content = f.read() + content
                if own not in made:
                    os.makedirs(own, exist_ok=True)
                    made.add(own)
                part = f"{own}/.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                written.add(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(written)], pa.int64())], names=["n"])

    os.makedirs(folder, exist_ok=True)
    rows = files.select(*[F.col(n).cast("string").alias(f"_{k}") for k, n in enumerate(names)], F.col("value").cast("binary").alias("_value"))
    # with a number, or Spark would join small texts into one task, however many files they are
    dealt = rows.repartition(WAVES * spark.sparkContext.defaultParallelism, *[f"_{k}" for k in range(count)])
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number
    return not plain


def _plain(value: str | None) -> str:
    """A value as the name of a folder or file that readers don't pass over."""
    if not value or value[0] in "._" or "/" in value or "\0" in value or value.endswith("._COPYING_"):
        raise ValueError(f"no name for a file: {value!r}")
    return value


def _folder(value: str | None) -> str:
    """A value as part of a folder's name; null and the empty text share one, as in Spark."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def write_json_parts(rows: DataFrame, root: str, part: str, order: list[str], value: str, head, tail) -> None:
    """Write one JSON text for each `part`: `head`, the values of its rows in order with commas between, `tail` (columns that are equal in a part). Rows stay rows: a line of the file each."""
    place = Window.partitionBy(part).orderBy(*order)
    first, last = F.row_number().over(place) == 1, F.lead(F.lit(1)).over(place).isNull()
    line = F.concat(F.when(first, head).otherwise(F.lit("")), F.col(value), F.when(last, tail).otherwise(F.lit(",")))
    lines = rows.select(part, F.row_number().over(place).alias("_place"), line.alias("value"))
    lines.sortWithinPartitions(part, "_place").select(part, "value").write.partitionBy(part).text(root)


def bitmaps(pixels: DataFrame) -> DataFrame:
    """(image, value): rows (image, y, x, c0, c1, c2) as 24-bit BMP files, blue first, with null pixels black. The bytes stand in a string, as the text writer takes them."""
    whole = lambda c, size: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])  # noqa: E731  lowest byte first
    pixel = F.concat(*[whole(F.coalesce(F.col(c), F.lit(0)).cast("int"), 1) for c in ("c0", "c1", "c2")])
    # lines go from bottom to top, each filled up to a multiple of four bytes
    line = pixels.groupBy("image", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", pixel.alias("p")))), lambda t: t["p"]), "").alias("line"), F.count(F.lit(1)).cast("int").alias("w"))
    size = lambda n: F.ceil(n / 4).cast("int") * 4
    line = line.select("image", "y", "w", F.rpad("line", size(F.col("w") * 3) * 2, "0").alias("line"))
    body = line.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "line"))), lambda t: t["line"]), "").alias("body"), F.max("w").alias("w"), F.count(F.lit(1)).cast("int").alias("h"))
    length = (F.length("body") / 2).cast("int")
    head = F.concat(F.lit("424D"), whole(length + 54, 4), F.lit("00000000" "36000000" "28000000"), whole(F.col("w"), 4), whole(F.col("h"), 4), F.lit("0100" "1800" "00000000"), whole(length, 4), F.lit("00000000" * 4))
    return body.select("image", F.unhex(F.concat(head, F.col("body"))).cast("string").alias("value"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into a scratch folder and read it back, so that Spark knows its size and a lost executor costs running tasks only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
