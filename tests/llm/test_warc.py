"""Operator 12: what is written comes back, and the archives are what the formats say."""

import glob
import hashlib
import random

import pytest
import zstandard

from plotgauge.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, _id int, id string"


def pages(n=400):
    rng = random.Random(8)
    same = "<html>" + "copy " * 300 + "</html>"
    rows = []
    for i in range(n):
        html = rng.choice([same, f"<html><body class='page'>{' '.join(rng.choices(['lorem', 'ipsum', 'dolor', 'ñandú', '日本'], k=rng.randrange(400)))}</body></html>"])
        rows.append((i, f"http://h{i % 9}.org/{i}", html))
    rows += [(n, None, None), (n + 1, "", ""), (n + 2, "http://a b/\r\nX-Evil: 1\x00", "x" * 999), (n + 3, "http://c", "x" * 999), (n + 4, "u", "y" * 1000), (n + 5, "u", "y" * 1000)]
    rows += [(None, "null id", same), (None, "null id", same), (None, "only null ids", "q" * 2000), (None, "only null ids", "q" * 2000)]
    rows += [(n + 9, "twice", "t" * 1500), (n + 9, "twice", "t" * 1500), (n + 8, "v", "t" * 1500), (n + 10, "long", "日 long " * 300_000), (n + 11, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 90)]
    return rows


def plain(rows):
    best = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = best.get(html)
        later = first is not None and (i is None or i < first)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if later else "response", first if later else None))
    return out


@pytest.mark.parametrize("archive_bytes", [1 << 24, 60_000])
def test_round_trip(spark, tmp_path, archive_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "p", 1, "i") for r in rows], SCHEMA).repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, archive_bytes=archive_bytes)
    read = warc.read_archives(spark, path).collect()
    got = [(r["record_id"] and int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in read]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    html = {(i, h or "") for i, _, h in rows}
    for r in read:
        if r["record_type"] == "response":
            assert (r["record_id"] and int(r["record_id"]), bytes(r["payload"]).decode()) in html and hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None
    urls = {r["target_uri"] for r in read}
    assert "http://a%20b/%0D%0AX-Evil:%201%20" in urls and None in urls
    files = glob.glob(f"{path}/part-*")
    assert len(files) >= (3 if archive_bytes > 1 << 20 else 10)


def test_format(spark, tmp_path):
    """The dictionary's frame comes first, each record is a frame of its own, and the dictionary is needed and pays."""
    records = [warc.page_record(str(i), None, f"http://h/{i}", "00" * 20, len(h or ""), (h or "").encode()) for i, _, h in pages(200)[:200]]
    raw = warc.write_archive(records)
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    made = warc.archive_dictionary(raw)
    at = 8 + int.from_bytes(raw[4:8], "little")
    assert 0 < len(made.as_bytes()) == at - 8 <= warc.DICT_BYTES
    found, rest = [], raw[at:]
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
        found.append(one.decompress(rest))
        rest = one.unused_data
    assert found[1:] == records and found[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(raw[at:])
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(raw) - at < alone
    assert warc.archive_dictionary(warc.write_archive(records[:2])) is None and len(list(warc.read_archive(warc.write_archive(records[:2])))) == 3
    with pytest.raises(ValueError):
        list(warc.read_archive(zstandard.ZstdCompressor().compress(records[0][:-3])))
    with pytest.raises(ValueError):
        list(warc.read_archive(zstandard.ZstdCompressor().compress(b"no archive\r\n")))


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_ids_of_any_kind(spark, tmp_path):
    """Text ids with blanks and brackets come back."""
    ids = ["a b", "<c>", "", "ñ%20\n", "z"]
    df = spark.createDataFrame([(i, "u", "k" * 1200) for i in ids], "page_id string, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = {(r["record_id"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {(i or None, "ñ%20\n" if i != "ñ%20\n" else None) for i in ids}
