"""Operator 9: typed records in several layouts, rows by turn, very long texts, many turns, and the registered query against its SQL."""

import collections
import hashlib

import duckdb
from pyspark.sql import functions as F

from plotgauge.llm import chat_format
from plotgauge.llm.queries import ORACLE_SQL

ROWS = "conv_id long, turn int, role string, text string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "&amp;lt;| <", "", "a\nb\n", "<<<|", "&#10;", "ñ😀", None]


def rows():
    """Chats of every kind, with null turns, roles, texts and ids, ties and repeated rows."""
    out = []
    for c in range(60):
        n = c % 5
        roles = ["user", "assistant"] if n == 2 else ["system", "user", "assistant"] if n == 3 else (["human", "gpt", "odd\nrole<|", None, "assistant"] * 2)[: 2 * n]
        out += [(c, k, role, NASTY[(c + k) % len(NASTY)]) for k, role in enumerate(roles)]
    out += [(70, None, "user", "b"), (70, 1, "assistant", "z"), (70, 1, "assistant", "y"), (70, 1, "assistant", "y"), (70, None, "user", "a"), (None, 0, "user", "no id"), (None, 1, "assistant", None)]
    return out


def plain(rows):
    """Turns by chat, put together in plain Python."""
    chats = collections.defaultdict(list)
    for c, turn, role, text in rows:
        chats[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in chats.items()}


def test_layouts_of_structs(spark):
    df = spark.createDataFrame(rows(), ROWS).repartition(7)
    dealt = chat_format.deal_layouts(chat_format.turns_of_rows(df))
    got = chat_format.canonical_turns(dealt, "conv_id", "record", roles={}).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == plain(rows())
    assert {r["layout"] for r in got} == {"messages", "from_value", "prompt_response", "instruction_output", "system_prompt_response"}
    renamed = chat_format.canonical_turns(dealt, "conv_id", "record").collect()
    names = {"human": "user", "gpt": "assistant"}
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in renamed} == {c: [(names.get(r, r), t) for r, t in x] for c, x in plain(rows()).items()}
    # a struct and the same record as JSON have one fingerprint
    both = dealt.select("conv_id", "record", F.to_json("record").alias("json"))
    a, b = (chat_format.canonical_turns(both, "conv_id", c).select("conv_id", F.col("fingerprint").alias(c), F.to_json("turns").alias(f"t_{c}")) for c in ("record", "json"))
    assert a.join(b, a.conv_id.eqNullSafe(b.conv_id)).where("record <> json OR t_record <> t_json").count() == 0
    odd = spark.sql("SELECT 1 AS id, named_struct('messages', array(), 'prompt', NULL) AS record UNION ALL SELECT 2, named_struct('messages', NULL, 'prompt', 'p') UNION ALL SELECT 3, NULL")
    assert [(r["layout"], r["turns"]) for r in chat_format.canonical_turns(odd, "id", "record").orderBy("id").collect()] == [("messages_empty", []), (None, []), (None, [])]


def test_query(spark, sf_dir, tmp_path):
    """The registered query against its SQL, on the table and on awkward chats."""
    spark.createDataFrame(rows(), ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    for d in (sf_dir, str(tmp_path)):
        duck = duckdb.connect()
        path = f"{d}/conversations.parquet"
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path + ('/*.parquet' if d == str(tmp_path) else '')}'")
        df = chat_format.op9_chat_format(spark, d)
        found = duck.execute(ORACLE_SQL["op9_chat_format"])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
    got = {r["conv_id"]: r for r in df.collect()}[-1]
    said = chat_format.PLANTED
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_long_texts_and_many_turns(spark):
    """A text of 25,000,000 characters, one of 50,000,000, and a chat of 40,000 turns."""
    long = spark.range(2).select((F.col("id") + 1).alias("conv_id"), F.lit("assistant").alias("role"), F.when(F.col("id") == 0, F.expr("repeat('ab<|\n', 5000000)")).otherwise(F.expr("repeat('abcdefghi\n', 5000000)")).alias("text"), F.lit(1).alias("turn"))
    many = spark.range(40_000).select(F.lit(3).cast("long").alias("conv_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"), F.col("id").cast("int").alias("turn"))
    turns = chat_format.canonical_turns(chat_format.deal_layouts(chat_format.turns_of_rows(long.unionByName(many))), "conv_id", "record", roles={})
    back = chat_format.read_back(chat_format.format_turns(turns, "conv_id"), "conv_id")
    got = {r["conv_id"]: r for r in back.select("conv_id", F.size("turns").alias("n"), F.length("loss_text").alias("size"), F.md5("loss_text").alias("loss"), F.md5(F.array_join(F.transform("turns", lambda t: t["text"]), "")).alias("all")).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for k, text in ((1, "ab<|\n" * 5_000_000), (2, "abcdefghi\n" * 5_000_000)):
        assert (got[k]["n"], got[k]["size"], got[k]["loss"], got[k]["all"]) == (1, len(text), md5(text), md5(text))
    said = [f"turn {i}" for i in range(40_000)]
    assert got[3]["n"] == 40_000 and got[3]["loss"] == md5("".join(said[1::2])) and got[3]["all"] == md5("".join(said))
