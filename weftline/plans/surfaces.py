"""Queries over what the others leave out: sinks read back, the engine's primitives, predicates, reports, dense graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import clocks, vectors as vx
from weftline.functions import text as tx
from weftline.operators import ann, collaboration, conversations, graph, graph_build, limits, monitoring, temporal, vectors
from weftline.plans.primitives import Engine
from weftline.sources import graphs, tables
from weftline.sources.conversations import read_conversations
from weftline.sources.tables import EDGES_SQL, as_edges, as_edits, as_operations, table
from weftline.storage import drop_path, materialise, new_path

from .records import _AT, _EDITS, _OPS, _PAIRED, _SECONDS, _moment
from .registry import query
from .retrieval import _PAIRS, SEED

_NOW = "2024-01-30 00:00:00"
#: Edges of a stored graph that a task writes.
TASK_EDGES = 500_000


def _ops(spark, d):
    return as_operations(table(spark, d, "events"))


def _written(spark, label, write, read):
    """What a sink wrote, read back and kept as a table."""
    path = new_path(spark, label)
    write(path)
    kept, _ = materialise(read(path), label)
    drop_path(spark, path)
    return kept


# -- sources and sinks ---------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def sink_csv(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return _written(spark, "csv", lambda p: tables.write_csv(rows, p), lambda p: spark.read.schema(rows.schema).option("header", "true").csv(p))


@query("SELECT event_id, event_type, value, props FROM events")
def sink_json(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    return _written(spark, "json", lambda p: tables.write_json(rows, p), lambda p: spark.read.schema(rows.schema).json(p))


@query("SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part")
def sink_append(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return _written(spark, "append", lambda p: (tables.append(rows, p), tables.append(rows, p)), spark.read.parquet)


def _stored_graph(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("graph_name"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    # a graph's edges are made in parts of about so many by hash of their source
    pairs = nodes.groupBy("graph_name").agg((F.count("*").cast("double") * F.count("*") / 2).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    salts, parts = (int(n // TASK_EDGES) + 1 for n in pairs)
    parts = min(parts + 24, 10_000)
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
    source = nodes.select("graph_name", F.col("id").alias("from_node"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).repartition(parts, "graph_name", "salt")
    ahead = nodes.select("graph_name", F.col("id").alias("to_node"), salt).repartition(parts, "graph_name", "salt")
    edges = source.join(ahead.hint("merge"), ["graph_name", "salt"]).filter("from_node < to_node").select("graph_name", "from_node", "to_node", F.round(1.0 / (F.col("to_node") - F.col("from_node")), 6).alias("weight"))
    return nodes, edges


@query("""WITH e AS (SELECT CAST(a.s_nationkey AS VARCHAR) AS graph_name, a.s_suppkey AS from_node, b.s_suppkey AS to_node, round(1.0 / (b.s_suppkey - a.s_suppkey), 6) AS weight
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT * FROM e""")
def graph_store(spark, d):
    nodes, edges = _stored_graph(spark, d)

    def read(path):
        told = graphs.load_graphs(spark, path)[1]
        return told.select(F.col("graph_name").cast("string").alias("graph_name"), "from_node", "to_node", "weight")

    return _written(spark, "graphs", lambda p: graphs.save_graphs(nodes, edges, p), read)


@query("""WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS g, n_name AS name, n_nationkey AS k FROM nation),
e AS (SELECT a.g, a.name AS src, b.name AS dst, 1.0 / (1 + b.k - a.k) AS w FROM n a JOIN n b ON a.g = b.g AND a.k < b.k)
SELECT src, dst, round(w, 6) AS weight FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)""")
def graph_json(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("graph_name"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    a, b = n.toDF("graph_name", "source", "ka"), n.toDF("graph_name", "target", "kb")
    links = a.join(b, "graph_name").filter("ka < kb").select("graph_name", "source", "target", (1.0 / (1 + F.col("kb") - F.col("ka"))).alias("confidence"))
    found = _written(spark, "json-graphs", lambda p: graphs.write_json_graph(n.select("graph_name", "name").repartition("graph_name"), links, p), lambda p: _lines(spark, p))
    return found


def _lines(spark, path):
    """Graphs of JSON lines, a document each, as one edge table."""
    raw = spark.read.schema(f"graph_name STRING, {graphs.JSON_GRAPH}").json(path)
    one = raw.select("graph_name", F.explode("relationships").alias("r")).select("graph_name", F.col("r.source").alias("src"), F.col("r.target").alias("dst"), F.col("r.confidence").alias("weight"))
    both = one.unionByName(one.select("graph_name", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.round(F.max("weight"), 6).alias("weight"))


_LOG_TEXTS = ["please implement and test it", "now add a button", "thanks", "fix the build", "what is this"]
_LOG_TOOLS = ["Edit", "Write", "Bash", "Read"]
_LOG_SQL = f"""log AS (SELECT CAST(l_orderkey AS VARCHAR) AS conversation_id, CAST(l_linenumber AS BIGINT) AS turn, CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS kind,
  list_extract({_LOG_TEXTS}, CAST(l_partkey % 5 + 1 AS INT)) AS text, list_extract({_LOG_TOOLS}, CAST(l_partkey % 4 + 1 AS INT)) AS tool, 'src/f' || CAST(l_suppkey AS VARCHAR) || '.py' AS file,
  'zig build step' || CAST(l_suppkey AS VARCHAR) AS command FROM lineitem)"""


def _log(spark, d):
    """Messages with tool uses, made of order lines: even lines are assistants that use one tool each."""
    text = F.element_at(F.array(*map(F.lit, _LOG_TEXTS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    tool = F.element_at(F.array(*map(F.lit, _LOG_TOOLS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    key = F.col("l_suppkey").cast("string")
    given = F.when(tool == "Bash", F.to_json(F.struct(F.concat(F.lit("zig build step"), key).alias("command")))).otherwise(F.to_json(F.struct(F.concat(F.lit("src/f"), key, F.lit(".py")).alias("file_path"), F.struct(F.lit(1).alias("x")).alias("opts"))))
    kind = F.when(F.col("l_linenumber") % 2 == 1, "user").otherwise("assistant")
    tools = F.when(kind == "assistant", F.array(F.struct(tool.alias("name"), given.alias("input"), F.lit("t").alias("id")))).otherwise(F.array().cast("array<struct<name:string,input:string,id:string>>"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("conversation_id"), F.col("l_linenumber").cast("bigint").alias("turn"), kind.alias("kind"), text.alias("text"), tools.alias("tools"))


@query(f"WITH {_LOG_SQL} SELECT conversation_id, kind, text, CASE WHEN kind = 'assistant' THEN tool END AS tool FROM log")
def conversation_log(spark, d):
    """Messages written as files of JSON lines, a file for each of 16 parts, and read back."""
    m = _log(spark, d)
    parts = F.concat(F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"))), F.transform("tools", lambda t: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), t["name"].alias("name"), t["input"].alias("input"))))
    lines = m.select(F.col("kind").alias("type"), F.col("conversation_id").alias("sessionId"), F.struct(F.col("kind").alias("role"), parts.alias("content")).alias("message")).repartition(16)
    read = lambda p: read_conversations(spark, p).select(F.col("session_id").alias("conversation_id"), "kind", "text", F.get(F.col("tools"), F.lit(0))["name"].alias("tool"))
    return _written(spark, "log", lambda p: tables.write_json(lines, p), read)


@query(f"WITH {_LOG_SQL} SELECT conversation_id, turn, tool, CASE WHEN tool = 'Bash' THEN NULL ELSE file END AS file_path, CASE WHEN tool = 'Bash' THEN command END AS command, CASE WHEN tool = 'Bash' THEN NULL ELSE 'unknown' END AS opts FROM log WHERE kind = 'assistant'")
def tool_uses(spark, d):
    return conversations.tool_uses(_log(spark, d)).select("conversation_id", "turn", "tool", *[F.col("params")[k].alias(k) for k in ("file_path", "command", "opts")])


@query(f"""WITH {_LOG_SQL} SELECT file AS name, min(conversation_id) AS conversation_id, arg_min(turn, conversation_id || '/' || turn) AS turn FROM log WHERE kind = 'assistant' AND tool <> 'Bash' GROUP BY file""")
def file_entities(spark, d):
    return conversations.file_entities(conversations.tool_uses(_log(spark, d))).select("name", "conversation_id", "turn")


@query(f"WITH {_LOG_SQL} SELECT conversation_id, 'build_command_' || turn AS name, command AS content, turn FROM log WHERE kind = 'assistant' AND tool = 'Bash'")
def command_entities(spark, d):
    return conversations.command_entities(conversations.tool_uses(_log(spark, d))).select("conversation_id", "name", "content", "turn")


@query(f"WITH {_LOG_SQL} SELECT conversation_id, turn, 'task_' || CASE WHEN text LIKE '%implement%' THEN 'implement' WHEN text LIKE '%add%' THEN 'add' WHEN text LIKE '%fix%' THEN 'fix' END || '_' || turn AS name FROM log WHERE kind = 'user' AND (text LIKE '%implement%' OR text LIKE '%add%' OR text LIKE '%fix%')")
def task_entities(spark, d):
    return conversations.task_entities(_log(spark, d)).select("conversation_id", "turn", "name")


@query("""SELECT name, count(*) AS messages FROM (SELECT doc_id, unnest(list_distinct(list_slice(regexp_extract_all(text, '\\b[a-zA-Z0-9_]+\\.[a-zA-Z0-9_]+\\b'), 1, 10))) AS name FROM documents) GROUP BY name""")
def file_mentions(spark, d):
    return conversations.file_mentions(table(spark, d, "documents"))


@query("SELECT conv_id AS conversation_id, turn, length(text) AS size FROM conversations WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 50")
def analysed_messages(spark, d):
    def sizes(frames):
        for f in frames:
            yield f.assign(size=f["text"].str.len())[["conversation_id", "turn", "size"]]

    messages = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "text")
    return conversations.analysed(messages, sizes, "conversation_id bigint, turn bigint, size bigint")


@query("SELECT count(*) AS calls, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS cache_hit_rate, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events")
def analyser_stats(spark, d):
    log = table(spark, d, "events").select((F.col("event_type") == "view").alias("hit"), (F.col("event_type") == "error").alias("failed"))
    return conversations.analyser_stats(log)


@query("""SELECT l_orderkey, l_linenumber, 'x' || l_partkey AS name, CASE l_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS project FROM lineitem""")
def project_names(spark, d):
    where = F.element_at(F.array(F.lit("/p/left/"), F.lit("/right/"), F.lit("/q/")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    path = F.concat(where, F.lit("x"), F.col("l_partkey").cast("string"), F.lit(".jsonl"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.base_name(path).alias("name"), tx.project_of(path, ("left", "right")).alias("project"))


# -- primitives ----------------------------------------------


def _engine(spark):
    return Engine(spark, new_path(spark, "engine"), "agent-7", "session-1")


def _nations(spark, d):
    return [(r["n_name"], r["n_nationkey"]) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]


@query("SELECT n_name AS doc_id, 'nation ' || n_nationkey || ' again' AS text FROM nation")
def engine_documents(spark, d):
    """Values stored in one batch, then again: the last versions."""
    engine = _engine(spark)
    for end in ("", " again"):
        engine.batch_store([{"key": k, "value": f"nation {n}{end}"} for k, n in _nations(spark, d)])
    return engine.documents().select("doc_id", "text")


@query("SELECT n_name AS key, n_nationkey % 5 <> 0 AS success, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 2 = 1 END AS indexed FROM nation")
def engine_batch_store(spark, d):
    """A row for each request: those without a value fail, values of over 50 characters count as indexed."""
    told = _engine(spark).batch_store([{"key": k, "value": "" if n % 5 == 0 else "x" * (60 if n % 2 else 9)} for k, n in _nations(spark, d)])
    return told.select("key", "success", "indexed")


@query("SELECT n_name AS src, 'in' AS relation, CAST(n_regionkey AS VARCHAR) AS dst FROM nation")
def engine_links(spark, d):
    """Links written twice: one a source, relation and target."""
    engine = _engine(spark)
    for r in table(spark, d, "nation").filter("n_nationkey < 3").collect():
        engine.link(r["n_name"], str(r["n_regionkey"]), "in")
    rest = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.lit(1).cast("bigint").alias("ts"), F.col("n_name").alias("src"), F.lit("in").alias("relation"), F.col("n_regionkey").cast("string").alias("dst"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit("a").alias("agent_id"))
    tables.append(rest, f"{engine.root}/links")
    return engine.links_now().select("src", "relation", "dst")


@query("SELECT * FROM (VALUES ('link', 1), ('retrieve', 2), ('search', 1), ('store', 1), ('transform', 1)) AS t(name, uses)")
def engine_uses(spark, d):
    engine = _engine(spark)
    engine.execute("store", {"key": "a", "value": "alpha beta"})
    engine.execute("search", {"query": "alpha"})
    engine.execute("link", {"source": "a", "target": "b", "relation": "r"})
    engine.execute("transform", {"operation": "compress_text", "data": "a  b"})
    for key in "ab":
        engine.execute("retrieve", {"key": key})
    return engine.list_primitives().withColumn("uses", F.col("uses").cast("int"))


# -- versions, vectors, graphs -------------------------------


@query(f"SELECT event_id, round(1 - least(abs(epoch(TIMESTAMP '{_NOW}') - {_SECONDS}), 31536000) / 31536000.0, 6) AS weight FROM events")
def recency_weights(spark, d):
    age = F.unix_timestamp(_moment(_NOW)) - F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", F.round(temporal.recency_weight(age), 6).alias("weight"))


@query(f"WITH {_PAIRS} SELECT src, dst, similarity, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p QUALIFY rank <= 20 AND rank <= 2")
def knn_pruned(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.prune(vectors.neighbour_graph(rows, 20, queries=rows.filter("vec_id % 50 = 0")), 2)


@query("""SELECT doc_id, round(length(text) / 10000.0, 6) AS size, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 6) AS capitals, round(len(regexp_extract_all(text, '[a-z]')) / greatest(length(text), 1), 6) AS small,
  round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) AS digits, round(len(regexp_extract_all(text, '\\n')) / 1000.0, 6) AS lines FROM documents""")
def text_statistics(spark, d):
    v = vx.text_statistics(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[F.round(v[i], 6).alias(n) for i, n in ((0, "size"), (1, "capitals"), (2, "small"), (3, "digits"), (6, "lines"))])


def _edges(spark, d):
    return as_edges(table(spark, d, "lineitem"))


@query(f"""WITH {EDGES_SQL}, nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links), g AS (SELECT src AS node, count(*) AS n FROM links GROUP BY src),
m AS (SELECT node, coalesce(n, 0) / (SELECT count(*) FROM nodes) >= 0.01 AS hub FROM nodes LEFT JOIN g USING (node)) SELECT node FROM m WHERE hub OR NOT (SELECT bool_or(hub) FROM m)""")
def graph_pivots(spark, d):
    return graph.pivots(_edges(spark, d), 0.01)


@query(f"WITH {EDGES_SQL} SELECT dst AS node, min(weight) AS dist FROM links GROUP BY dst ORDER BY dist, node LIMIT 1000")
def graph_frontier(spark, d):
    return graph.nearest_frontier(_edges(spark, d).select(F.col("dst").alias("node"), F.col("weight").alias("dist")))


@query(f"""WITH RECURSIVE {EDGES_SQL}, f(node, depth) AS (SELECT CAST({SEED} AS BIGINT), 0 UNION SELECT l.dst, r.depth + 1 FROM f r JOIN links l ON l.src = r.node WHERE r.depth < 2),
b(node, depth) AS (SELECT CAST({SEED} AS BIGINT), 0 UNION SELECT l.src, r.depth + 1 FROM b r JOIN links l ON l.dst = r.node WHERE r.depth < 2),
i AS (SELECT node, direction, min(depth) AS distance FROM (SELECT *, 1 AS direction FROM f UNION ALL SELECT *, 0 FROM b) GROUP BY node, direction HAVING min(depth) > 0)
SELECT count(*) FILTER (direction = 1) AS forward, count(*) FILTER (direction = 0) AS backward, count(*) FILTER (distance >= 2) AS critical,
  round(count(DISTINCT node) / (SELECT count(*) FROM (SELECT src FROM links UNION SELECT dst FROM links)), 6) AS complexity FROM i""")
def impact_summary(spark, d):
    return graph.impact_summary(_edges(spark, d), spark.createDataFrame([(SEED,)], "node bigint"), 2)


@query("SELECT p_partkey AS node, p_size % 2 = 0 AS even FROM part")
def node_properties(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.create_map(F.lit("even"), F.lit("?"), F.lit("b"), F.lit("1")).alias("properties"), (F.col("p_size") % 2 == 0).cast("string").alias("even"))
    return graph.with_property(rows, "even", F.col("even"), F.lit(0)).select("node", (F.col("properties")["even"] == "true").alias("even"))


# -- dense graphs --------------------------------------------

_FOUND = """found AS (SELECT s_nationkey % 5 AS conversation_id, list_extract(['task', 'file', 'error_event', 'other'], CAST(s_suppkey % 4 + 1 AS INT)) AS entity_type, replace(s_name, 'Supplier', list_extract(['alpha', 'beta', 'gamma'], CAST(s_suppkey % 3 + 1 AS INT))) AS name,
  s_suppkey % 7 AS turn, s_suppkey AS entity_id, s_nationkey AS project, s_suppkey * 1800 AS ts FROM supplier)"""
_DENSE = f"""{_FOUND}, n1 AS (SELECT *, lead(entity_id) OVER w AS nid, lead(turn) OVER w AS nt FROM found WINDOW w AS (PARTITION BY conversation_id ORDER BY turn, entity_id)),
links AS (SELECT entity_id AS from_id, nid AS to_id, 'temporal' AS edge_type, 1.0::DOUBLE AS weight FROM n1 WHERE nt - turn = 1
  UNION ALL SELECT a.entity_id, b.entity_id, 'modifies', 0.7 FROM found a JOIN found b ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id <> b.entity_id AND a.entity_type = 'file' AND b.entity_type = 'file'
  UNION ALL SELECT a.entity_id, b.entity_id, 'creates', 1.0 FROM found a JOIN found b ON a.conversation_id = b.conversation_id AND a.entity_type = 'task' AND b.entity_type = 'file' AND b.turn - a.turn BETWEEN 1 AND 3),
co AS (SELECT DISTINCT a.entity_id AS from_id, b.entity_id AS to_id, 'similar' AS edge_type, 0.6::DOUBLE AS weight FROM found a JOIN found b ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id < b.entity_id
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.from_id = a.entity_id AND l.to_id = b.entity_id)),
medium AS (SELECT * FROM links UNION ALL SELECT * FROM co),
kept AS (SELECT * FROM found WHERE entity_type <> 'other'),
named AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id, a.name AS x, b.name AS y FROM kept a JOIN kept b ON a.entity_id < b.entity_id),
scored AS (SELECT from_id, to_id, 'similar' AS edge_type, round(CASE WHEN x = y THEN 1.0 ELSE 2.0 * (len(list_filter(range(1, CAST(least(length(x), length(y)) + 1 AS BIGINT)), lambda i: left(x, i) = left(y, i)))
  + len(list_filter(range(1, CAST(least(length(x), length(y)) + 1 AS BIGINT)), lambda i: right(x, i) = right(y, i)))) / (length(x) + length(y)) END, 6) AS weight FROM named),
sim AS (SELECT * FROM scored s WHERE weight > 0.6 AND NOT EXISTS (SELECT 1 FROM medium m WHERE m.from_id = s.from_id AND m.to_id = s.to_id)),
evo AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id, 'temporal' AS edge_type, round(1.0 / greatest(1.0, (b.ts - a.ts) / 3600.0), 6) AS weight FROM kept a JOIN kept b ON a.project = b.project AND a.entity_type = b.entity_type AND a.ts < b.ts
  WHERE NOT EXISTS (SELECT 1 FROM medium m WHERE m.from_id = a.entity_id AND m.to_id = b.entity_id)),
most AS (SELECT * FROM medium UNION ALL SELECT * FROM sim UNION ALL SELECT * FROM evo),
hour AS (SELECT entity_id, ts // 3600 AS h, row_number() OVER (PARTITION BY ts // 3600 ORDER BY ts, entity_id) AS k FROM kept),
clustered AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id, 'temporal' AS edge_type, 0.5::DOUBLE AS weight FROM hour a JOIN hour b ON a.h = b.h AND b.k - a.k BETWEEN 1 AND 5
  WHERE NOT EXISTS (SELECT 1 FROM most m WHERE m.from_id = a.entity_id AND m.to_id = b.entity_id)),
dense AS (SELECT * FROM most UNION ALL SELECT * FROM clustered)"""


def _found(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % n + 1).cast("int"))
    return table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 5).cast("bigint").alias("conversation_id"), pick(("task", "file", "error_event", "other"), 4).alias("entity_type"), F.replace("s_name", F.lit("Supplier"), pick(("alpha", "beta", "gamma"), 3)).alias("name"), F.lit(None).cast("string").alias("content"),
        (F.col("s_suppkey") % 7).cast("bigint").alias("turn"), F.col("s_suppkey").cast("bigint").alias("entity_id"), F.col("s_nationkey").alias("project"), (F.col("s_suppkey") * 1800).alias("ts"),
    )


@query(f"WITH {_DENSE} SELECT * FROM dense")
def graph_dense(spark, d):
    found, _ = materialise(_found(spark, d), "found")
    return graph_build.build(found, conversations.relationships(found), "dense")[1]


@query(f"""WITH {_DENSE}, all_edges AS (SELECT 'sparse' AS graph_name, * FROM links WHERE edge_type = 'creates' UNION ALL SELECT 'medium', * FROM medium UNION ALL SELECT 'dense', * FROM dense)
SELECT graph_name, edge_type, count(*) AS n, round(sum(weight), 4) AS weight FROM all_edges GROUP BY graph_name, edge_type""")
def graph_set(spark, d):
    found, _ = materialise(_found(spark, d), "found")
    _, edges = graph_build.build_set(found, conversations.relationships(found))
    return edges.groupBy("graph_name", "edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"WITH {_DENSE} SELECT (SELECT count(*) FROM kept) AS n, count(*) AS m, round(count(*) / (SELECT count(*) FROM kept), 6) AS avg_degree, round(count(*) / (SELECT count(*) FROM kept) / (SELECT count(*) FROM kept), 6) AS density_ratio FROM dense")
def graph_density(spark, d):
    found, _ = materialise(_found(spark, d), "found")
    return graph_build.stats(*graph_build.build(found, conversations.relationships(found), "dense"))


# -- shared documents ----------------------------------------

_HIT = """NOT before AND NOT after AND ((ka = 'insert' AND pa <= pb) OR (ka <> 'insert' AND pa <= pb AND pb < pa + la) OR (kb = 'insert' AND pb <= pa) OR (kb <> 'insert' AND pb <= pa AND pa < pb + lb))"""
_EVENTS = f"""{_PAIRED}, hits AS (SELECT * FROM pairs WHERE {_HIT}), told AS (SELECT document, op_b AS op_id, count(*) AS n_conflicting, max(ta) AS last_ts, arg_max(op_a, (ta, op_a)) AS last_op, max(tb) AS ts FROM hits GROUP BY document, op_b),
events_ AS (SELECT document, op_id, n_conflicting, CASE WHEN op_id % 7 = 0 THEN 'manual' ELSE 'last_writer_wins' END AS strategy, CASE WHEN ts > last_ts OR (ts = last_ts AND op_id > last_op) THEN op_id ELSE last_op END AS lww, ts FROM told)"""


def _edits(spark, d):
    return as_edits(table(spark, d, "events"))


def _events(spark, d):
    return collaboration.conflict_events(_edits(spark, d), F.when(F.col("op_id") % 7 == 0, "manual").otherwise("last_writer_wins"))


@query(f"WITH {_EVENTS} SELECT document, op_id, n_conflicting, strategy, CASE WHEN strategy <> 'manual' THEN lww END AS winner, CASE WHEN strategy <> 'manual' THEN ts END AS resolved_at FROM events_")
def conflict_events(spark, d):
    return _events(spark, d)


@query(f"WITH {_EVENTS} SELECT document, op_id, n_conflicting FROM events_ WHERE strategy = 'manual'")
def unresolved_conflicts(spark, d):
    return collaboration.unresolved(_events(spark, d)).select("document", "op_id", "n_conflicting")


@query(f"""WITH {_EDITS}, l AS (SELECT document, op_id, c0, c1, c2, lead(op_id) OVER w AS op_b, lead(c0) OVER w AS d0, lead(c1) OVER w AS d1, lead(c2) OVER w AS d2 FROM edits WINDOW w AS (PARTITION BY document ORDER BY op_id))
SELECT op_id AS op_a, op_b, greatest(c0, d0) AS m0, greatest(c1, d1) AS m1, greatest(c2, d2) AS m2, c0 + 1 AS t0 FROM l WHERE op_b IS NOT NULL""")
def merged_clocks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document").orderBy("op_id")
    rows = _edits(spark, d).select(F.col("op_id").alias("op_a"), "clock", F.lead("op_id").over(w).alias("op_b"), F.lead("clock").over(w).alias("next")).filter("op_b IS NOT NULL")
    m, t = clocks.merge(F.col("clock"), F.col("next")), clocks.tick(F.col("clock"), F.lit("a0"))
    return rows.select("op_a", "op_b", m["a0"].alias("m0"), m["a1"].alias("m1"), m["a2"].alias("m2"), t["a0"].alias("t0"))


@query(f"""WITH {_PAIRED}, h AS (SELECT document, count(*) AS n FROM pairs WHERE {_HIT} GROUP BY document), e AS (SELECT document, count(DISTINCT agent_id) AS agents, least(count(*), 10) AS recent FROM edits GROUP BY document)
SELECT document, agents, recent, coalesce(n, 0) AS n_conflicts FROM e LEFT JOIN h USING (document)""")
def document_context(spark, d):
    edits = _edits(spark, d)
    docs = edits.select("document").distinct().withColumn("content", F.lit(""))
    return collaboration.context(edits, docs).select("document", F.size("cursors").alias("agents"), F.size("recent_ops").alias("recent"), "n_conflicts")


# -- monitoring and limits -----------------------------------


@query(f"""WITH {_OPS}, k AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY op ORDER BY seq DESC) <= 10000) SELECT op, count(*) AS samples, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM k GROUP BY op""")
def performance_report(spark, d):
    told = monitoring.report(_ops(spark, d))
    parsed = told.select(F.explode(F.from_json("report", "operations ARRAY<STRUCT<op: STRING, samples: BIGINT, p95_ms: DOUBLE>>")["operations"]).alias("o"))
    return parsed.select("o.op", "o.samples", "o.p95_ms")


@query(f"WITH {_OPS} SELECT seq, agent_id FROM ops WHERE ts >= TIMESTAMP '{_AT}'")
def retained_rows(spark, d):
    return monitoring.retained(_ops(spark, d), _moment()).select("seq", "agent_id")


@query(f"WITH {_OPS} SELECT agent_id, seq, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, seq DESC) AS k FROM ops QUALIFY k <= 5")
def newest_by_agent(spark, d):
    return monitoring.newest(_ops(spark, d), 5, ["agent_id"]).select("agent_id", "seq", "k")


@query(f"WITH {_OPS} SELECT op, count(*) AS n, count(DISTINCT agent_id) AS agents, round(count(*) / count(DISTINCT agent_id), 6) AS per_agent FROM ops GROUP BY op")
def participation(spark, d):
    return monitoring.participation(_ops(spark, d))


@query(f"WITH {_OPS}, e AS (SELECT *, CASE op WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'contribution' END AS kind FROM ops) SELECT agent_id, count(*) FILTER (kind = 'contribution') AS contributions, arg_max(kind, seq) <> 'leave' AS present FROM e GROUP BY agent_id")
def participants(spark, d):
    kind = F.when(F.col("op") == "signup", "join").when(F.col("op") == "error", "leave").otherwise("contribution")
    return monitoring.participants(_ops(spark, d).withColumn("kind", kind))


_METRICS = (("latency", 10.0), ("peak", 10.0), ("spread", 20.0))
_THREE = f"""{_OPS}, f AS (SELECT op AS name, ts >= TIMESTAMP '{_AT}' AS now, avg(latency_ms) AS latency, max(latency_ms) AS peak, stddev_samp(latency_ms) AS spread FROM ops GROUP BY ALL),
t AS (SELECT name, now, unnest(['latency', 'peak', 'spread']) AS metric, round(unnest([latency, peak, spread]), 6) AS v, unnest([10.0, 10.0, 20.0]) AS most FROM f)"""


@query(f"WITH {_THREE} SELECT c.name, c.metric, round((c.v - b.v) / b.v * 100, 6) AS percent, round((c.v - b.v) / b.v * 100, 6) > c.most AS regressed FROM t c JOIN t b USING (name, metric) WHERE c.now AND NOT b.now")
def three_metric_regressions(spark, d):
    figures = [F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(F.max("latency_ms"), 6).alias("peak"), F.round(F.stddev_samp("latency_ms"), 6).alias("spread")]
    now, before = (_ops(spark, d).filter(p).groupBy(F.col("op").alias("name")).agg(*figures) for p in (F.col("ts") >= _moment(), F.col("ts") < _moment()))
    return monitoring.metric_regressions(now, before, dict(_METRICS)).select("name", "metric", "percent", "regressed")


_ROLES = ["admin", "readonly", "developer"]


@query(f"WITH {_OPS}, r AS (SELECT seq, op, list_extract({_ROLES}, CAST(seq % 3 + 1 AS INT)) AS role FROM ops) SELECT seq, CASE WHEN role = 'admin' THEN true ELSE op IN ('view', 'click') END AS allowed FROM r")
def authorised_tools(spark, d):
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("seq") % 3 + 1).cast("int"))
    return _ops(spark, d).select("seq", limits.authorised(role, F.array(F.lit("view"), F.lit("click")), F.col("op")).alias("allowed"))


_LOCKS = """locks AS (SELECT o_custkey AS path, o_orderkey AS lock_id, o_orderpriority AS agent_id, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS kind, o_orderdate AS acquired, o_orderdate + INTERVAL 90 DAY AS expires FROM orders)"""
_LOCK_AT = "1996-06-01 00:00:00"


def _locks(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("lock_id"), F.col("o_orderpriority").alias("agent_id"), F.when(F.col("o_orderkey") % 2 == 0, "read").otherwise("write").alias("kind"), F.col("o_orderdate").alias("acquired"), F.expr("o_orderdate + INTERVAL '90' DAY").alias("expires"))


@query(f"""WITH {_LOCKS}, asked AS (SELECT c_custkey AS path, '1-URGENT' AS agent_id, 'read' AS kind FROM customer)
SELECT path FROM asked a WHERE NOT EXISTS (SELECT 1 FROM locks l WHERE l.path = a.path AND l.acquired <= TIMESTAMP '{_LOCK_AT}' AND l.expires > TIMESTAMP '{_LOCK_AT}' AND l.agent_id <> a.agent_id AND NOT (l.kind = 'read' AND a.kind = 'read'))""")
def accessible_paths(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.lit("1-URGENT").alias("agent_id"), F.lit("read").alias("kind"))
    return limits.accessible(asked, _locks(spark, d), _moment(_LOCK_AT)).select("path")


@query(f"WITH {_LOCKS} SELECT lock_id FROM locks WHERE expires > TIMESTAMP '{_LOCK_AT}'")
def live_locks(spark, d):
    return limits.live_locks(_locks(spark, d), _moment(_LOCK_AT)).select("lock_id")


@query(f"""SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS told
FROM (SELECT event_id, ts, CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - {_SECONDS} AS s FROM events)""")
def relative_times(spark, d):
    age = F.unix_timestamp(_moment(_NOW)) - F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", tx.relative_time(age, F.col("ts")).alias("told"))


@query(f"WITH {_OPS} SELECT seq, '{{\"type\":\"agent_activity\",\"agent_id\":\"' || agent_id || '\",\"op\":\"' || op || '\"}}' AS message FROM ops")
def activity_messages(spark, d):
    return _ops(spark, d).select("seq", tx.message("agent_activity", F.col("agent_id"), F.col("op")).alias("message"))


@query()
def ann_neighbours(spark, d):
    """The approximate index, every 50th vector against all; tests measure its recall."""
    rows = table(spark, d, "embeddings")
    return ann.search(ann.build(rows), rows.filter("vec_id % 50 = 0"), 10)
