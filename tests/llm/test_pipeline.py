"""The pipeline's stages against plain versions, each on its own input."""

import collections

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from plotgauge.llm import mixing, queries
from plotgauge.llm.common import write_table
from test_llm import SCHEMA, WORD, corpus, lines_expected, near_expected  # noqa: F401


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    texts = ["the thing " + (t or "") if i % 7 else t for i, t in enumerate(corpus(9))]
    rows = [(i, t, "en" if i % 5 else None, f"src{i % 3}", len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)]
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, None).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_language_stage(staged):
    before, after = staged["language_id"]
    kept = {r["doc_id"] for r in after.collect()}
    assert kept == {r["doc_id"] for r in before.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert after.columns == before.columns and after.where("lang IS NULL").count() == 0


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    expected = lines_expected([r["text"] for r in rows])
    left = {rows[k]["doc_id"]: text for k, (_, gone, text) in expected.items() if not gone or WORD.search(text)}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_stage(staged):
    before, after = staged["near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    expected = near_expected([r["text"] for r in rows])
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {rows[k]["doc_id"]: rows[k]["text"] for k, (_, _, kept) in expected.items() if kept}


def test_mix_stage(spark, staged):
    before, after = staged["mixing"]
    slim, plan = mixing.plan_mix(before)
    taken = {r["doc_id"]: r["c"] for r in slim.join(plan, ["domain", "lang", "source"]).select("doc_id", mixing.copies(mixing.Mix()).alias("c")).collect() if r["c"]}
    assert collections.Counter(r["doc_id"] for r in after.collect()) == taken


def test_encode_stage(staged):
    before, after = staged["encode"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["decoded"] == sp.decode(sp.encode(texts[r["doc_id"]]))


def test_repeated_and_null_ids(spark):
    rows = [(1, "alpha beta gamma delta", "en", "s", 1, "", "", "", "")] * 2 + [(1, "quite another text", "en", "s", 1, "", "", "", ""), (None, "alpha beta gamma delta", "en", "s", 1, "", "", "", "")]
    left = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "alpha beta gamma delta"), (1, "alpha beta gamma delta")]


def test_many_null_ids_beside_a_repeated_one(spark):
    """Rows of null id are never ranked, so they don't meet in one task."""
    rows = [(None, f"text number {k} without an id", "en", "s", 1, "", "", "", "") for k in range(300)]
    rows += [(5, f"one id and text {k} of several", "en", "s", 1, "", "", "", "") for k in (3, 1, 2)] + [(6, "alone here", "en", "s", 1, "", "", "", "")]
    left = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), None)
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(x for x in got if x[0]) == [(5, "one id and text 1 of several"), (6, "alone here")]
    assert sorted(t for i, t in got if i is None) == sorted(r[1] for r in rows[:300])
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :].split("\n")
    assert any("LeftSemi" in line for line in below[:4])


def test_language_stage_and_letters(spark):
    """Numerals aren't letters, with labels or without."""
    rows = [(k, t, lang, "s", 1, "", "", "", "") for k, (t, lang) in enumerate([("½ ² Ⅷ 123 _", None), ("the words of a text", "en"), ("die worte im text", "de"), ("ª", None), ("٣٤ ①", None)])]
    for docs in (rows, [(*r[:2], None, *r[3:]) for r in rows]):
        left = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, spark.createDataFrame(docs, SCHEMA), None).collect()}
        assert left >= {1, 2} and not left & {0, 4}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        assert out.count() == 0


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_clashing_columns(spark):
    """Helper names as input columns: values are the same at the end of every stage."""
    names = "row place new _row _id _version _text _starts _first _n_lines _n_removed n_lines n_removed _kept_text kept_text _score score _lang_pred lang_pred _found id n rep value hub kept component_id n_shingles domain lang_ source_ _copies _copy copies tokens epochs cut_range _l _at".split()
    texts = ["alpha beta gamma delta", "one two three\nfour five\nsix seven\nlast line", "x y z\none two three\nfour five\nsix seven\nother end", "alpha beta gamma delta"]
    rows = [(i, t, "en", "s1", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == 4


def test_query(spark, sf_dir):
    """The registered query runs the stages one after another."""
    expected = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        expected = write_table(stage(spark, expected, sf_dir), name)
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in df.collect())
    assert key(got) == key(expected) and got.count() > 0
