"""Operator 11: round trips, layouts, and digests against a plain version and SQL."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallymill.llm import chat_format
from tallymill.llm.chat_format import TRIAL, escape, marked, unescape, unmarked

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
odd_text = st.text(alphabet=st.sampled_from(list("\\#</turn>: ~\nAa")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "Assistant", "a: b", "~x\\"]) | odd_text, odd_text), max_size=6))
def test_marks_can_be_read_back(turns):
    text = "".join(marked(*t)[0] for t in turns)
    assert list(unmarked(text)) == turns
    for role, said in turns:
        assert unescape(escape(said)) == said
        assert "##" not in escape(said) and "</" not in escape(said)
        whole, start, stop = marked(role, said)
        assert unescape(whole[start:stop]) == said


def plainly(rows):
    out = {}
    for conv, turn, role, text in [*rows, *TRIAL]:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for conv, turns in out.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: t[:2])]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), sum(len(marked(*t)[0]) for t in turns))
    return found


def compare(spark, rows, parts=3):
    found = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plainly(rows)
    assert len(found) == len(plainly(rows))


def test_odd_conversations(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(300_000)) + "</turn>\n### User: "
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "x"), (2, 3, "assistant", "\\"), (2, 2, "tool: y\n", "#" * 9), (None, 0, "user", "null id"), (None, 1, "assistant", "</turn>")]
    rows += [(3, 0, "assistant", long), (3, 1, "assistant", long), (3, 2, "user", "\x00\x1c🙂 \u2028"), (4, 5, "user", "same"), (4, 5, "user", "same")]
    compare(spark, rows)
    compare(spark, [])


@pytest.fixture
def parted(spark):
    """Small ranges aren't put together, so that they stand for large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_that_holds_most_rows(spark, parted):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 5)) for i in range(3000)] + [(i + 10, i % 3, "assistant", str(i)) for i in range(600)]
    compare(spark, rows, 5)
    turns = chat_format.canonical(spark.createDataFrame(rows, SCHEMA), F.struct("*"), F.col("conv_id"))
    chunks = chat_format.write(turns, most=500)
    assert chunks.where("conv_id = 7").select("part").distinct().count() > 1  # no task gets it all
    assert chunks.where("conv_id = 7").agg(F.max(F.length("text"))).first()[0] < 700
    read = chat_format.parse(chunks)
    back = [(r["role"], r["text"], r["learned"]) for r in read.where("conv_id = 7").orderBy("part", "chunk", "place").collect()]
    assert back == [(r, x, r == "assistant") for _, _, r, x in rows[:3000]]
    equal = spark.range(4000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("copy").alias("text"))
    assert chat_format.write(chat_format.canonical(equal, F.struct("*"), F.col("conv_id"))).select("part").distinct().count() > 1


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": None}], "text": "extra"},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"instruction": "do", "input": "this", "output": "done", "id": 4}, {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "output": {"x": [1]}},
        {"prompt": "p", "completion": "c", "text": "clash", "role": 3}, {"question": "q", "answer": "a", "context": "c"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}, {"role": "assistant", "content": "three"}]},
        {"conv_id": 5, "turn": 2, "role": "assistant", "text": None}, {"conv_id": "no number", "turn": True, "role": None, "text": 7},
        {"unknown": 1}, [], "text", None, {"messages": []}, {"messages": None},
    ]
    texts = [json.dumps(r) for r in records] + ["{not json", "[" * 100_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, json string")
    found = {}
    for r in chat_format.canonical(df, F.col("json"), F.col("id")).orderBy("step").collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["layout"], r["role"], r["text"]))
    assert found[0, None] == [("messages", "system", "be kind"), ("messages", "user", "hi"), ("messages", "assistant", "")]
    assert [x[1:] for x in found[1, None]] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert [x[1:] for x in found[2, None]] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert [x[1:] for x in found[3, None]] == [("user", "do"), ("assistant", "done")]
    assert found[4, None][1] == ("instruction, output", "assistant", '{"x": [1]}')
    assert [x[1:] for x in found[6, None]] == [("user", "c\n\nq"), ("assistant", "a")]
    assert found[7, None] == [("messages in parts", "user", "one\n\ntwo"), ("messages in parts", "assistant", "three")]
    assert found[5, 2] == [("turn rows", "assistant", "")]
    assert found[None, None] == [("turn rows", "", "7")]
    assert [x[1:] for x in found[5, None]] == [("user", "p"), ("assistant", "c")]
    assert all(k not in found for k in [(i, None) for i in range(10, 20)])
    counts = chat_format.layouts(df, F.col("json")).collect()
    assert sum(r["records"] for r in counts) == len(texts)
    assert len({r["fingerprint"] for r in counts}) == len(counts)


def test_agrees_with_sql(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    clash = rows.withColumns({c: F.lit("x") for c in ("part", "chunk", "hash", "spread", "record", "id", "loss", "step", "messages")})
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = db.sql(chat_format.ORACLE_SQL)
    for given_rows in (rows, clash):
        found = chat_format.format_conversations(given_rows)
        assert found.columns == want.columns
        assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
