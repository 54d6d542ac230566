"""Operator 13: fill-in-the-middle by rotating blocks of a text in place."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, documents, map_texts, portions

#: Bytes scanned or exchanged at a time.
BLOCK = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class FillParams:
    """`percent` of the texts are taken apart, `spm_percent` of those with the suffix first; the draw is fixed by `seed` and id."""

    seed: str = "42"
    percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """The three sentinels; they must be told apart wherever they meet each other or a text without them."""
        marks = (self.prefix.encode(), self.suffix.encode(), self.middle.encode())
        for a in marks:
            for b in marks:
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError("sentinels must not be empty, lie within or overlap one another")
        return marks


def _unit_ends(raw: bytes, low: int, high: int) -> np.ndarray:
    """Places just behind the words that end in raw[low:high]."""
    word = ~_BLANK[np.frombuffer(raw, np.uint8, min(high + 1, len(raw)) - low, low)]
    if high >= len(raw):
        word = np.append(word, False)
    return np.flatnonzero(word[:-1] & ~word[1:]) + (low + 1)


def count_units(raw: bytes) -> tuple[int, list[int]]:
    """Units of a text (a word with the white space before it, or white space at the end), and how many words end in each block of it."""
    words = [len(_unit_ends(raw, low, min(low + BLOCK, len(raw)))) for low in range(0, len(raw), BLOCK)]
    return sum(words) + bool(raw and _BLANK[raw[-1]]), words


def cut_place(raw: bytes, words: list[int], n: int, units: int) -> int:
    """The place behind the first `units` of `n` units."""
    if units in (0, n):
        return len(raw) if units else 0
    for block, count in enumerate(words):
        if units <= count:
            return int(_unit_ends(raw, block * BLOCK, min((block + 1) * BLOCK, len(raw)))[units - 1])
        units -= count
    raise IndexError(units)


def code_points(raw: bytes, low: int, high: int) -> int:
    return sum(int(np.count_nonzero((np.frombuffer(raw, np.uint8, min(BLOCK, high - at), at) & 0xC0) != 0x80)) for at in range(low, high, BLOCK))


def reverse(buf: bytearray, low: int, high: int) -> None:
    """Reverse buf[low:high] in place, by exchanging blocks from both ends."""
    view = np.frombuffer(buf, np.uint8)
    while high - low > 1:
        k = min(BLOCK, (high - low) // 2)
        head = view[low : low + k][::-1].copy()
        view[low : low + k] = view[high - k : high][::-1]
        view[high - k : high] = head
        low, high = low + k, high - k


def rotate(buf: bytearray, low: int, mid: int, high: int) -> None:
    """Exchange buf[low:mid] and buf[mid:high] in place: reverse each of them, then both together."""
    reverse(buf, low, mid)
    reverse(buf, mid, high)
    reverse(buf, low, high)


def take_apart(buf: bytearray, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> None:
    """Turn a text with cuts at `first` and `second` into its psm or spm form, in place."""
    prefix, suffix, middle = marks
    for at, mark in ((second, suffix), (first, middle), (0, prefix)):
        buf[at:at] = mark
    first += len(prefix)
    second += len(prefix) + len(middle)
    # now prefix, middle, suffix, each behind its own sentinel
    rotate(buf, first if form == "psm" else 0, second, len(buf))


def put_together(buf: bytearray, form: str, marks: tuple[bytes, bytes, bytes]) -> None:
    """Undo ``take_apart``: rotate back, then take the sentinels out."""
    prefix, suffix, middle = marks
    at, last = buf.index(middle), len(buf)
    if form == "psm":
        first = buf.index(suffix)
        rotate(buf, first, at, last)
        second = first + last - at
    else:
        first = buf.index(prefix)
        rotate(buf, 0, first, last)
        first, second = at - first, last - first
    for place, mark in ((second, suffix), (first, middle), (0, prefix)):
        del buf[place : place + len(mark)]


def draws(seed: str, key: str) -> list[int]:
    """Four 32-bit draws from the SHA-256 of seed and id."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(found[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_middle(df: DataFrame, p: FillParams = FillParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take texts apart for fill-in-the-middle training: (id, n, form, prefix_chars, middle_chars, output), one row per input row.

    A text has `n` units: words with the white space before them, and white space at its end. Two draws cut it behind some
    of its units into prefix, middle and suffix, each of which may be empty. Form `psm` gives them as prefix, suffix, middle,
    form `spm` as suffix, prefix, middle, each behind its sentinel. A text that holds a sentinel, is empty or null, or isn't drawn
    keeps its form: `plain`, with null lengths. The draws depend on nothing but seed and id, so rows with equal ids and texts give
    equal results; a null id draws as an empty one. Other columns are left out, whatever their names. A worker
    holds a text twice and blocks of `BLOCK` bytes.
    """
    marks = p.marks()

    def run(batches):
        for batch in portions(batches):
            out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for key, raw in zip(batch.column(1), batch.column(2)):
                raw = raw.as_py()
                n, words = count_units(raw)
                h = draws(p.seed, key.as_py())
                form, sizes = "plain", (None, None)
                if raw and h[2] % 100 < p.percent and not any(m in raw for m in marks):
                    form = "spm" if h[3] % 100 < p.spm_percent else "psm"
                    first, second = (cut_place(raw, words, n, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    sizes = code_points(raw, 0, first), code_points(raw, first, second)
                    buf = bytearray(raw)
                    take_apart(buf, first, second, form, marks)
                    raw = buf
                for name, value in zip(out, (n, form, *sizes, raw)):
                    out[name].append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(values, kind) for values, kind in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:-1], made[-1].cast(pa.string())], names=[id_col, *out])

    kind = df.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col), key.alias("_key"), bytes_of(text_col).alias("_text"))
    return map_texts(rows, run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_middle(df: DataFrame, keep: list[str], p: FillParams = FillParams(), form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The columns `keep` and `restored`, the exact text of each output, from output and form alone. A null output or form restores as it stands."""
    marks = p.marks()

    def run(batches):
        for batch in portions(batches):
            texts = []
            for form, raw in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                form, raw = form.as_py(), raw.as_py()
                if form in ("psm", "spm"):
                    raw = bytearray(raw)
                    put_together(raw, form, marks)
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, "restored"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(form_col).alias("_form"), bytes_of(output_col).alias("_output"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(rows, run, f"{kinds}, restored string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(documents(spark, sf_dir)).withColumn("output_sha256", F.sha2("output", 256))
    keep = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restore_middle(made, keep).select(*keep, F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH rows_in AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM rows_in),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
