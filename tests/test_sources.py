import json

import pytest

from weftline.operators import conversations
from weftline.plans.primitives import Engine, InvalidRequest
from weftline.sources import graphs, tables
from weftline.sources.conversations import read_conversations

LOG = [
    {"type": "user", "uuid": "1", "sessionId": "s", "timestamp": "2024-05-01T10:00:00Z", "message": {"role": "user", "content": "fix a.py and b.rs"}},
    {"type": "assistant", "uuid": "2", "parentUuid": "1", "timestamp": "2024-05-01T10:01:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "Looking"}, {"type": "tool_use", "name": "Edit", "id": "t1", "input": {"file_path": "a.py", "n": 3, "deep": {"x": 1}}}, {"type": "text", "text": "done"}]}},
    {"type": "user", "uuid": "3", "timestamp": "2024-05-01T10:02:30Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]}, "toolUseResult": {"stdout": "out", "interrupted": False}},
]


def test_conversations(spark, tmp_path):
    deep = tmp_path / "deep"
    deep.mkdir()
    (tmp_path / "first.jsonl").write_text("\n".join([json.dumps(x) for x in LOG] + ["{broken", ""]))
    (deep / "second.jsonl").write_text(json.dumps(LOG[0]))
    rows = read_conversations(spark, str(tmp_path), recursive=True)
    by = {(r["conversation_id"], r["seq"]): r for r in rows.collect()}
    assert set(by) == {("first", 0), ("first", 1), ("first", 2), ("second", 0)}
    assert by["first", 1]["text"] == "Looking\ndone" and by["first", 1]["tools"][0]["name"] == "Edit"
    assert by["first", 2]["results"][0] == "ok" and len(by["first", 2]["results"]) == 2 and by["first", 0]["results"] == []
    messages = rows.withColumnRenamed("seq", "turn")
    assert conversations.tool_uses(messages).first()["params"] == {"file_path": "a.py", "n": "3", "deep": "unknown"}
    stats = {r["conversation_id"]: r for r in conversations.conversation_stats(messages).collect()}
    assert stats["first"]["duration_s"] == 150 and stats["first"]["tool_calls"] == 1
    assert {r["name"] for r in conversations.file_mentions(messages).collect()} == {"a.py", "b.rs"}
    assert read_conversations(spark, str(tmp_path), most_bytes=10).count() == 0


def test_stored_graphs(spark, tmp_path):
    n = spark.createDataFrame([("g", 1, "a", {"k": "v"}), ("g", 2, "b", None), ("h", 1, "c", None)], "graph_name string, id bigint, name string, metadata map<string,string>")
    e = spark.createDataFrame([("g", 1, 2, 0.5)], "graph_name string, from_node bigint, to_node bigint, weight double")
    path = str(tmp_path / "graphs")
    graphs.save_graphs(n, e, path)
    nodes, edges = graphs.load_graphs(spark, path)
    assert nodes.count() == 3 and edges.first()["weight"] == 0.5
    e.withColumnRenamed("weight", "w").selectExpr("graph_name", "from_node", "to_node", "w + 1 AS weight").write.mode("overwrite").partitionBy("graph_name").parquet(f"{path}/edges")
    with pytest.raises(graphs.CorruptGraph):
        graphs.load_graphs(spark, path)


def test_json_graphs(spark, tmp_path):
    doc = {"entities": [{"name": "a", "type": "file"}, {"name": "b"}, {"name": "a"}], "relationships": [{"source": "a", "target": "b", "confidence": 0.5}, {"source": "b", "target": "a", "confidence": 0.9}, {"source": "a", "target": "zz"}], "metadata": {"n": 1}}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    entities, edges = graphs.read_json_graphs(spark, str(tmp_path / "g.json"))
    assert entities.count() == 2 and sorted((r["src"], r["dst"], r["weight"]) for r in edges.collect()) == [("a", "b", 0.9), ("b", "a", 0.9)]
    graphs.write_json_graph(entities, edges.withColumnsRenamed({"src": "source", "dst": "target", "weight": "confidence"}), str(tmp_path / "out"))
    assert graphs.read_json_graphs(spark, str(tmp_path / "out"))[1].count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.range(3)
    tables.append(rows, str(tmp_path / "t"))
    tables.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    tables.write_csv(rows, str(tmp_path / "c"))
    tables.write_json(rows, str(tmp_path / "j"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 3


def test_primitives(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), "agent-7")
    stored = engine.execute("store", {"key": "src/a", "value": "function alpha() { return beta; }", "metadata": {"tags": ["x"], "agent_id": "other"}, "embedding": [1, 0]}).first()
    assert stored["success"] and not stored["indexed"]
    told = engine.batch_store([{"key": "b", "value": "x" * 60, "embedding": [0, 1]}, {"key": "", "value": "y"}, {"key": "c", "value": "alpha gamma"}]).collect()
    assert [(r["success"], r["indexed"]) for r in told] == [(True, True), (False, None), (True, False)] and told[1]["error"]
    engine.execute("store", {"key": "src/a", "value": "function alpha() { return delta; }"})
    got = engine.execute("retrieve", {"key": "src/a", "include_history": True}).first()
    assert got["exists"] and "delta" in got["value"] and ["beta" in h["content"] for h in got["history"]] == [False, True]
    assert engine.retrieve("none").first()[:] == (False, "none", None, {})
    engine.execute("link", {"source": "src/a", "target": "c", "relation": "depends_on"})
    engine.execute("link", {"source": "src/a", "target": "c", "relation": "depends_on", "metadata": {"n": 2}})
    assert [(r["relation"], r["metadata"]) for r in engine.links_now().collect()] == [("depends_on", {"n": "2"})]
    find = lambda **k: [r["key"] for r in engine.execute("search", k).collect()]
    assert set(find(query="alpha gamma")) == {"c", "src/a"}
    assert find(query="q", kind="semantic", embedding=[0.0, 1.0])[0] == "b"
    assert find(query="q", kind="graph", starting_nodes=["src/a"]) == ["src/a", "c"]
    assert set(find(query="alpha", kind="temporal", since=0)) == {"src/a", "c"} and find(query="alpha", kind="temporal", until=5) == []
    assert "b" in find(query="gamma", kind="hybrid", embedding=[0.0, 1.0], starting_nodes=["c"])
    assert engine.execute("transform", {"operation": "compress_text", "data": "a  b"}).first()["output"] == "a b"
    for name, params in (("store", {"key": "", "value": "x"}), ("search", {"query": "x", "kind": "psychic"}), ("transform", {"operation": "fly", "data": "x"}), ("link", {"source": "a", "target": "", "relation": "r"}), ("dance", {})):
        with pytest.raises(InvalidRequest):
            engine.execute(name, params)
    engine.register("echo", lambda text: spark.createDataFrame([(text,)], "text string"))
    assert engine.execute("echo", {"text": "hi"}, "agent-9").first()["text"] == "hi"
    uses = {r["name"]: r["uses"] for r in engine.list_primitives().collect()}
    assert uses["store"] == 2 and uses["link"] == 2 and uses["echo"] == 1
    assert [r["op"] for r in engine.operation_logs("-9").collect()] == ["echo"]
    assert {r["op"] for r in engine.performance().collect()} == {"store", "retrieve", "link", "search", "transform", "echo"}
    assert engine.clean_logs(0) == 0 and engine.clean_logs(1 << 40) > 5 and engine.operation_logs().count() == 0
