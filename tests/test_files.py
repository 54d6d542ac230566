"""Trees and pictures as files."""

import numpy as np
from pyspark.sql import functions as F

from plotgauge.sources import readers, writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_trees(spark, tmp_path):
    """Names that need escapes; no content is read for a listing, and of pictures none at all."""
    for model, task, sample, file in [("m 1", "t+%2F", "s#?é", "gen.html"), ("m 1", "t+%2F", "s#?é", "gen.png"), ("m2", "t", "a=b", "orig.png")]:
        at = tmp_path / "eval" / model / task / sample
        at.mkdir(parents=True, exist_ok=True)
        (at / file).write_text("x")
    tree = readers.read_eval_tree(spark, str(tmp_path / "eval"))
    assert sorted(tuple(r) for r in tree.collect()) == [("m 1", "t+%2F", "s#?é", True, False, False, True), ("m2", "t", "a=b", False, True, False, False)]
    assert "content" not in plan_of(tree)
    for sample, file, text in [("s 1", "chart.html", "<html>\n"), ("s 1", "code.js", "é"), ("s%2", "chart.png", "p"), ("s%2", "code.js", ";"), ("s3", "chart.png", "p"), ("s3", "code.js", "")]:
        at = tmp_path / "src" / sample
        at.mkdir(parents=True, exist_ok=True)
        (at / file).write_text(text)
    got = readers.read_sample_tree(spark, str(tmp_path / "src"))
    assert sorted(tuple(r) for r in got.collect()) == [("s 1", "<html>\n", "é"), ("s%2", None, ";"), ("s3", None, None)]


def test_partitioned_trees(spark, tmp_path):
    rows = [("0 01", "chart.html", "a\nb"), ("0 01", "chart.png", "p"), ("x%:2F", "code.js", "c"), ("007", "chart.png", "p")]
    writers.write_tree(spark.createDataFrame(rows, "sample string, file string, value string"), str(tmp_path / "t"), ("sample", "file"))
    got = readers.read_sample_tree(spark, str(tmp_path / "t"), partitioned=True)
    assert sorted(tuple(r) for r in got.collect()) == [("0 01", "a\nb\n", None), ("007", None, None), ("x%:2F", None, "c\n")]
    assert "content" not in plan_of(readers.tree_paths(spark, str(tmp_path / "t"), ("sample", "file"), True).drop("content"))


def test_tasks_write_a_tree_themselves(spark, tmp_path):
    """One file for each name and nothing beside it, lines of equal names together, bytes of any kind."""
    rows = [(f"s:{k % 40}", f"f{k % 3}", f"{k}".encode()) for k in range(40 * 3)] + [("", "f", b"\xff\x00"), ("s:0", "f0", b"again")]
    files = spark.createDataFrame(rows, "sample string, file string, value binary").withColumn("value", F.col("value").cast("string")).repartition(5)
    writers.write_tree(files, str(tmp_path / "t"), ("sample", "file"))
    found = [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    assert len(found) == 121
    got = readers.tree_paths(spark, str(tmp_path / "t"), ("sample", "file"), True).collect()
    assert {(r[0], r[1], bytes(r[2])) for r in got if r[0:2] not in (("s:0", "f0"), (None, "f"))} == {(a, b, v + b"\n") for a, b, v in rows if (a, b) not in (("s:0", "f0"), ("", "f"))}
    odd = {r[0]: bytes(r[2]) for r in got if r[0:2] in (("s:0", "f0"), (None, "f"))}
    assert odd[None] == b"\xff\x00\n" and sorted(odd["s:0"].split()) == [b"0", b"again"]


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark alone would make a task of every small file."""
    for k in range(40):
        (tmp_path / "p" / f"s{k}").mkdir(parents=True)
        (tmp_path / "p" / f"s{k}" / "chart.html").write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert readers.tree_paths(spark, str(tmp_path / "p"), ("sample", "file")).rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 40
        got = readers.read_sample_tree(spark, str(tmp_path / "p"))
        assert got.where("html = 'x'").count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bitmaps_come_back(spark, tmp_path):
    """Pictures of any width: the same pixels in the same places."""
    rng = np.random.default_rng(2)
    rows = [(k, y, x, *map(int, rng.integers(0, 256, 3))) for k, (h, w) in enumerate([(1, 1), (2, 3), (5, 4), (3, 7), (9, 2)]) for y in range(h) for x in range(w)]
    given = spark.createDataFrame(rows, "image long, y long, x long, c0 long, c1 long, c2 long").repartition(3)
    writers.write_tree(writers.bitmaps(given), str(tmp_path / "p"), ("image",))
    images = readers.read_images(spark, str(tmp_path / "p"))
    back = readers.pixels(images).withColumn("image", F.regexp_extract("image", r"image=(\d+)", 1).cast("long"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    counts = readers.color_counts(images)
    assert "Exchange" not in plan_of(counts)
    assert counts.agg(F.sum("n")).first()[0] == len(rows)


def test_nested_results(spark, tmp_path):
    """Files opened level by level: missing and odd fields are null, nested judgements stay, no map of a whole file is built."""
    import json

    import pytest

    files = {
        "a": {"m": {"t": {"1": {"error_count": 0, "ocr_f1": 0.5, "color_iou": 1, "gpt_evaluation": {"x": "y"}}, "2": {}}, "u": {}}, "n": {}},
        "b": {"m": {"t": {"3": {"error_count": 2.0, "ocr_f1": "odd", "gpt_evaluation": None}}, "ü \"q\"": {"4": {"error_count": 7}}}},
        "c": {},
    }
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    got = readers.read_results_json(spark, str(tmp_path))
    assert sorted(((r["model"], r["task"], r["sample"], r["error_count"], r["ocr_f1"], r["color_iou"], r["gpt_evaluation"]) for r in got.collect()), key=repr) == [
        ("m", "t", "1", 0, 0.5, 1.0, {"x": "y"}), ("m", "t", "2", None, None, None, None), ("m", "t", "3", 2, None, None, None), ("m", "ü \"q\"", "4", 7, None, None, None),
    ]
    (tmp_path / "d").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_results_json(spark, str(tmp_path)).collect()


def test_dictionary_by_place(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Color_Name,LAB(OpenCV)\r\nzinc,[1 2 3]\r\n\r\n"a, b",[53  80 67]\n')
    got = sorted(tuple(r) for r in readers.read_color_dict(spark, str(tmp_path / "d.csv")).collect())
    assert [(n, lab) for _, n, lab in got] == [("zinc", [1, 2, 3]), ("a, b", [53, 80, 67])] and got[0][0] == 0


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """No file of a tree is known to the driver, plain or partitioned; a plain tree has a folder for each sample only."""
    rows = [(f"s{k} a:b?c#d", f, "x\ny") for k in range(30) for f in ("chart.html", "chart.png", "code.js")[k % 3 :]]
    files = spark.createDataFrame(rows, "sample string, file string, value string").repartition(5)
    want = sorted((f"s{k} a:b?c#d", "x\ny\n" if k % 3 < 1 else None, "x\ny\n") for k in range(30))
    for plain in (True, False):
        root = str(tmp_path / f"t{plain}")
        partitioned = writers.write_tree(files, root, ("sample", "file"), plain)
        assert partitioned is not plain
        got = readers.read_sample_tree(spark, root, partitioned)
        assert got.inputFiles() == [] and "FileScan" not in plan_of(got)
        assert sorted(tuple(r) for r in got.collect()) == want
        found = readers.list_tree(spark, root, ("sample", "file"), partitioned)
        assert sorted((r[0], r[1]) for r in found.collect()) == sorted(r[:2] for r in rows)
    assert sum(p.is_dir() for p in (tmp_path / "tTrue").rglob("*")) == 30
    (tmp_path / "tTrue" / "_hidden").mkdir()
    (tmp_path / "tTrue" / "_hidden" / "code.js").write_text("x")
    (tmp_path / "tTrue" / "none").mkdir()
    assert readers.read_sample_tree(spark, str(tmp_path / "tTrue")).count() == 30


def test_names_that_no_file_can_have(spark, tmp_path):
    import pytest

    for k, name in enumerate(["a/b", "", None, "..", ".a", "_a"]):
        files = spark.createDataFrame([("s", name, "x")], "sample string, file string, value string")
        with pytest.raises(Exception, match="no name for a file"):
            writers.write_tree(files, str(tmp_path / f"t{k}"), ("sample", "file"), plain=True)


def test_bitmaps_are_decoded_alike(spark, tmp_path):
    """The same rows as Spark's image source gives, from tasks that read the tree themselves; any other file raises."""
    import pytest

    rng = np.random.default_rng(3)
    rows = [(k, y, x, *map(int, rng.integers(0, 256, 3))) for k, (h, w) in enumerate([(1, 1), (2, 3), (5, 4), (3, 7), (9, 2)]) for y in range(h) for x in range(w)]
    given = spark.createDataFrame(rows, "image long, y long, x long, c0 long, c1 long, c2 long").repartition(3)
    root = str(tmp_path / "p")
    partitioned = writers.write_tree(writers.bitmaps(given).withColumn("folder", F.concat(F.lit("d"), F.col("image") % 2)), root, ("folder", "image"), plain=True)
    images = readers.read_bitmaps(readers.tree_files(spark, root, ("folder", "image"), partitioned))
    assert images.inputFiles() == [] and sum(p.is_dir() for p in (tmp_path / "p").rglob("*")) == 2
    other = readers.read_images(spark, root).withColumn("image", F.substring_index("image", "/", -1))
    assert images.schema.names == other.schema.names
    assert sorted(map(tuple, images.collect())) == sorted(map(tuple, other.collect()))
    counts = readers.color_counts(images)
    assert sorted(map(tuple, counts.groupBy("image").agg(F.sum("n")).collect())) == [("0", 1), ("1", 6), ("2", 20), ("3", 21), ("4", 18)]
    whole = next(p for p in (tmp_path / "p" / "d0").iterdir() if p.name == "2").read_bytes()
    for k, odd in enumerate([b"GIF89a", whole[:60], whole[:28] + b"\x08" + whole[29:]]):
        (tmp_path / f"o{k}").mkdir()
        (tmp_path / f"o{k}" / "1").write_bytes(odd)
        with pytest.raises(Exception, match="no whole 24-bit bitmap"):
            readers.read_bitmaps(readers.tree_files(spark, str(tmp_path / f"o{k}"), ("image",))).collect()
