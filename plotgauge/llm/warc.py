"""Operator 12: WARC archives whose records are compressed one by one with a dictionary that stands in the archive's first frame."""

from __future__ import annotations

import base64
import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, map_texts, portions, shared_path, write_table

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Bytes of records, before compression, in one archive: what a worker holds at a time, unless one record is larger.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 32 << 10
#: A dictionary is built from so many bytes of an archive's records, spread evenly over it, and so many of each record.
SAMPLE_BYTES = 4 << 20
RECORD_SAMPLE = 64 << 10
LEVEL = 9

# Fixed values of the WARC 1.1 and Zstandard formats.
DICT_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
RECORDS = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def warc_record(kind: str, fields: dict[str, str | None], block: bytes = b"") -> bytes:
    """One WARC record; fields of None are left out."""
    head = {"WARC-Type": kind, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"])


def page_record(page: str | None, first: str | None, url: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """The response of a page, or its revisit of page `first`, whose block ends after the HTTP head. Digests stand in the headers in base 32, as usual there."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<urn:page:{page or ''}>",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if first is None:
        return warc_record("response", fields, block + payload)
    return warc_record("revisit", {**fields, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{first}>"}, block)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the records of an archive; None if they are too few or too short for one."""
    step = max(1, sum(min(len(r), RECORD_SAMPLE) for r in records) // SAMPLE_BYTES)
    samples = [r[:RECORD_SAMPLE] for r in records[::step]]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then one frame for each record, the description of the archive first."""
    info = warc_record("warcinfo", {"WARC-Record-ID": "<urn:archive>", "Content-Type": "application/warc-fields"}, b"software: plotgauge\r\nformat: WARC File Format 1.1\r\n")
    made, parts = build_dictionary(records), []
    options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    if made is not None:
        made.precompute_compress(level=LEVEL)
        raw = made.as_bytes()
        parts.append(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
        options["dict_data"] = made
    packer = zstandard.ZstdCompressor(**options)
    parts += [packer.compress(r) for r in (info, *records)]
    return b"".join(parts)


def archive_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of an archive, from its first frame."""
    if len(raw) >= 8:
        kind, size = struct.unpack_from("<II", raw)
        if kind == DICT_FRAME:
            return zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    return None


def read_archive(raw: bytes):
    """(headers, block) of each record, in order; the frames are read one after the other, never all at once."""
    unpacker = zstandard.ZstdDecompressor(dict_data=archive_dictionary(raw))
    with io.BufferedReader(unpacker.stream_reader(raw, read_across_frames=True), 1 << 16) as stream:
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := stream.readline()) != b"\r\n":
                if not line:
                    raise ValueError("the archive ends within a record's head")
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise ValueError("the archive ends within a record")
            yield head, block


def parse_record(head: dict[str, str], block: bytes) -> tuple:
    """A record as a row of `RECORDS`. A revisit's payload is null; its size is the one that its HTTP head gives."""
    kind = head["warc-type"]
    page, first = (None if k not in head else head[k].removeprefix("<urn:page:").removesuffix(">") or None for k in ("warc-record-id", "warc-refers-to"))
    payload = size = None
    http, _, rest = block.partition(b"\r\n\r\n")
    if kind == "response":
        payload, size = rest, len(rest)
    elif kind == "revisit":
        size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    digest = head.get("warc-payload-digest")
    digest = digest and base64.b32decode(digest.removeprefix("sha1:")).hex()
    return kind, page, first, head.get("warc-target-uri"), digest, size, payload


def plan_revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(_id, _digest, _size, _first): the pages that revisit page `_first`, each once. Payloads are read once and never shuffled; counting combines before its shuffle, so a payload that a third of all pages share stays small."""
    payload = bytes_of(payload_col)
    keys = df.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_size"))
    keys = write_table(keys.where(F.col("_size") >= least_bytes), "payload-keys")
    first = keys.groupBy("_digest", "_size").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    first = write_table(first, "payload-firsts")
    later = keys.join(first, ["_digest", "_size"]).where("_id IS NULL OR _id < _first").distinct()
    return write_table(later.select("_id", "_digest", "_size", "_first"), "revisits")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row into WARC archives below `path`, each file one archive.

    Of rows with equal payloads of at least `least_bytes` bytes the one of largest id is a response, the others are revisits
    of it; smaller payloads are responses all. Rows that share that largest id are responses all, too. A row of null id comes
    before all others; where all equal payloads have null ids, all are responses. A null payload is empty, a null URL is left
    out, line ends of a URL are written as %0D and %0A, other control characters and spaces as %20. Other columns are left out, whatever their names. An
    empty table makes no archive.

    An archive takes records of up to `archive_bytes` bytes, or one larger record; the worker that fills it holds no more. Its dictionary
    is built from its own records; where they are too few, it has none, as the format allows. Spark's text writer puts one
    archive into each file and an empty skippable frame behind it, so a lost executor's files are never seen half done.
    """
    later = plan_revisits(df, id_col, payload_col, least_bytes).withColumnsRenamed({"_id": "_rid", "_digest": "_rdigest", "_size": "_rsize"})
    payload = bytes_of(payload_col)
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_size"), payload.alias("_payload"))
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rdigest")) & (F.col("_size") == F.col("_rsize"))
    # a URL must not break the lines of the head
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("_url", r"\r", "%0D"), r"\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    name = lambda c: F.url_encode(F.col(c).cast("string"))
    rows = rows.join(later, same, "left").select(name("_id").alias("id"), name("_first").alias("first"), url.alias("url"), "_digest", "_size", F.when(F.col("_first").isNull(), F.col("_payload")).otherwise(F.lit(b"")).alias("payload"))

    def run(batches):
        held, total = [], 0
        for batch in portions(batches):
            for row in zip(*batch.columns):
                record = page_record(*(x.as_py() for x in row))
                if held and total + len(record) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], names=["archive"])
                    held, total = [], 0
                held.append(record)
                total += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], names=["archive"])

    archives = map_texts(rows, run, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`, descriptions of archives left out: (record_type, record_id, refers_to, target_uri, payload_digest, payload_bytes, payload).

    `record_id` and `refers_to` are the ids as text, `payload_digest` is the lowercase hex SHA-1 that the record states. A revisit has a
    null `payload`. An archive that ends early or holds something else raises.
    """

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for head, block in read_archive(raw.as_py()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    rows.append(parse_record(head, block))
                    held += len(block)
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    found = map_texts(spark.read.format("binaryFile").load(path).select("content"), run, RECORDS)
    return found.withColumns({c: F.url_decode(c) for c in ("record_id", "refers_to")})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return read_archives(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP12_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f > page_id THEN f END AS refers_to
FROM g
"""
