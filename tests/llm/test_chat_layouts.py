import json

import oracle
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from weftline.llm import chat_layouts, queries
from weftline.llm.chat_layouts import LAYOUTS, Layout, canonical_turns, conversation_turns, fingerprint_of, render

RECORDS = {
    "messages": ({"messages": [{"role": "system", "content": "s"}, {"role": "Human ", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "bot", "content": "c"}], "extra": 1}, "messages", [(0, "system", "s"), (1, "user", "a\nb"), (2, "assistant", "c")]),
    "from_value": ({"conversations": [{"from": "gpt", "value": "x"}, {"from": "human", "value": ""}]}, "conversations", [(0, "assistant", "x"), (1, "user", "")]),
    "prompt": ({"prompt": "p"}, "prompt", [(0, "user", "p")]),
    "prompt_response": ({"prompt": "p", "response": "r", "score": 2.5}, "prompt_response", [(0, "user", "p"), (1, "assistant", "r")]),
    "with_system": ({"system": "s", "prompt": "p", "completion": "r"}, "prompt_completion_system", [(0, "system", "s"), (1, "user", "p"), (2, "assistant", "r")]),
    "instruction": ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [(0, "user", "i\n\nn"), (1, "assistant", "o")]),
    "no_input": ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [(0, "user", "i"), (1, "assistant", "o")]),
    "null_input": ({"instruction": "i", "input": None, "output": "o"}, "instruction", [(0, "user", "i"), (1, "assistant", "o")]),
    "question": ({"answer": 42, "question": "q"}, "question_answer", [(0, "user", "q"), (1, "assistant", "42")]),
    "row": ({"turn": 7, "role": "tool", "text": "t"}, "turn_row", [(7, "tool", "t")]),
    "missing_content": ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant"}]}, "messages", [(0, "user", "u"), (1, "assistant", None)]),
    "messages_and_system": ({"system": "s", "messages": [{"role": "user", "content": "u"}]}, "messages_system", [(0, "system", "s"), (1, "user", "u")]),
    "from_and_system": ({"system": "s", "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "conversations_system", [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a")]),
    "mixed": ({"prompt": "p", "response": "r", "question": "q"}, "unknown", [(None, None, None)]),
    "nested_elsewhere": ({"meta": {"prompt": "p"}, "response": "r"}, "unknown", [(None, None, None)]),
    "empty_list": ({"messages": []}, "unknown", [(None, None, None)]),
    "nothing": ({}, "unknown", [(None, None, None)]),
    "list": ([1, 2], "unknown", [(None, None, None)]),
}


def test_layouts(spark):
    rows = [(k, json.dumps(v[0])) for k, v in RECORDS.items()] + [("malformed", "{oops"), ("null", None), ("empty", ""), ("long", json.dumps({"prompt": "x" * 200_000}))]
    table = spark.createDataFrame(rows, "layout string, v string").selectExpr("layout AS name", "v AS record", "'k' AS k0", "'x' AS t")
    got = {}
    for r in canonical_turns(table, F.col("record"), ["name", "k0", "t"]).collect():
        assert (r["k0"], r["t"]) == ("k", "x")
        got.setdefault(r["name"], []).append((r["layout"], r["turn"], r["role"], r["content"]))
    for k, (_, layout, turns) in RECORDS.items():
        assert sorted(got[k], key=repr) == sorted(((layout, *t) for t in turns), key=repr), k
    for k in ("malformed", "null", "empty"):
        assert got[k] == [("unknown", None, None, None)]
    assert got["long"] == [("prompt", 0, "user", "x" * 200_000)]


def test_fingerprints(spark):
    assert fingerprint_of(["b", "a"]) == fingerprint_of(["a", "b"]) != fingerprint_of(["a"])
    assert len({x.fingerprint for x in LAYOUTS}) == len(LAYOUTS)
    with pytest.raises(ValueError):
        canonical_turns(spark.createDataFrame([("{}",)], "r string"), F.col("r"), [], (*LAYOUTS, Layout("again", ("prompt",))))


def test_matches_sql(spark):
    got, want = oracle.compare(spark, queries.op6_chat_formatting, chat_layouts.SQL, SMALL)
    assert got == want and got


def test_table_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, layout string, prompt string, k0 string"
    rows = [(1, 0, "User", "hi", "z", None, "q"), (1, 1, "gpt", "", "z", None, "q"), (1, 1, "gpt", "", "z", None, "q"), (2, None, "user", "x", None, None, None), (None, 0, "user", "y", None, None, None), (3, 0, None, "x", None, None, None), (4, 0, "user", None, None, None, None), (5, 0, "user", "a", None, "also a prompt", None)]
    table = spark.createDataFrame(rows, schema)
    got = sorted(((r["conv_id"], r["layout"], r["turn"], r["role"], r["content"]) for r in conversation_turns(table).collect()), key=repr)
    want = [(1, "turn_row", 0, "user", "hi"), (1, "turn_row", 1, "assistant", ""), (1, "turn_row", 1, "assistant", ""), (None, "turn_row", 0, "user", "y")] + [(i, "unknown", None, None, None) for i in (2, 3, 4, 5)]
    assert got == sorted(want, key=repr)
    assert conversation_turns(spark.createDataFrame([], schema)).count() == 0


def test_render(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (3, 0, None, None)], "conv_id int, turn bigint, role string, content string")
    assert {r["conv_id"]: (r["n_turns"], r["chat"]) for r in render(turns).collect()} == {1: (2, "<|user|>\na\n<|assistant|>\nb"), 3: (1, "<|unknown|>\n")}
