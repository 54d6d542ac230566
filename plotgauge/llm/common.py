"""What the operators share: word and hash helpers, and tables written in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space. ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"

#: Used where ``spark.checkpoint.dir`` is unset, as in local tests.
LOCAL_SHARED = "/tmp/plotgauge-shared"

#: Bytes of a very long text that are worked on at a time.
STRETCH = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")

_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SHARED


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``drop_tables`` deletes."""
    path = f"{shared_dir(spark)}/plotgauge/{uuid.uuid4().hex}-{name}"
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(drop_tables, spark)
    _MADE[app].append(path)
    return path


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    A lost executor then costs the running tasks only. The reread table also gives Spark a true size, so that
    it broadcasts a join side only below its own threshold. ``drop_tables`` deletes what a session has written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it when no result that reads them is still wanted."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for path in _MADE.pop(sc.applicationId, []):
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the gateway may already be gone when the interpreter ends
            return


def stretches(raw: bytes):
    """A text in stretches of about `STRETCH` bytes that end at white space, so that no word is cut; at least one."""
    low = 0
    while True:
        gap = _BLANK.search(raw, low + STRETCH) if len(raw) - low > STRETCH else None
        high = gap.start() if gap else len(raw)
        yield raw[low:high]
        low = high
        if low >= len(raw):
            return


#: Rows of a batch that goes to Python, where the session has Spark's default of 10,000: texts are long, and a worker holds a whole batch.
BATCH_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes after which a batch ends, where the session has Spark's default: a batch is held by the executor and by the worker.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Let batches be of `BATCH_ROWS` rows and about `BATCH_BYTES` bytes, or one row, in this session, unless it has sizes of its own."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BATCH_BYTES) == f"{64 << 20}b":
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that was freed back to the system: idle workers stay beside the ones of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def map_texts(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` on rows with whole texts, in short batches; a task's memory is handed back at its end."""
    short_batches(rows.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


#: Bytes of texts whose results are handed on together.
PORTION = 4 << 20


def portions(batches, size: int = PORTION):
    """Record batches cut, without copying, so that their last column holds about `size` bytes each, or one value."""
    for batch in batches:
        begin, held = 0, 0
        for at, length in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
            if held and held + (length or 0) > size:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += length or 0
        yield batch.slice(begin)


#: Longer words aren't remembered by memos, so that a memo's bytes are bounded by the number of its entries.
LONGEST_WORD = 64


class HashMemo(dict):
    """64-bit hash of a bytes key, remembered if the key is short; ``trim`` keeps the number of entries bounded between stretches of a text. Some 150 bytes an entry at most."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, key: bytes) -> int:
        value = xxhash.xxh64_intdigest(key)
        if len(key) <= LONGEST_WORD:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def of_text(self, raw: bytes) -> np.ndarray:
        """Hashes of a text's words in order. A very long text is split a stretch at a time, so its words never all stand in memory."""
        parts = []
        for part in stretches(raw):
            parts.append(self.of(part.split()))
            self.trim()
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and minima of the results behave like random numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive entries of `h`, order-sensitive; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[k : k + n])
    return mix(out)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bytes_of(col: str):
    """A string column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
