"""Queries over versions, conversations, edits, operations and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import collaboration, conversations, graph_build, limits, monitoring, temporal
from weftline.sources.tables import as_changes, as_edits, as_operations, table
from weftline.streaming import pipelines, stateful

from .registry import query

# -- versions -----

_CHANGES = "changes AS (SELECT event_id AS seq, ts, user_id AS path, props AS content FROM events)"
_AT = "2024-01-15 00:00:00"


def _changes(spark, d):
    return as_changes(table(spark, d, "events"))


def _moment(text: str = _AT):
    return F.expr(f"timestamp_ntz'{text}'")


@query(f"WITH {_CHANGES} SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def latest_version(spark, d):
    return temporal.latest(_changes(spark, d))


@query(f"WITH {_CHANGES} SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS version FROM changes QUALIFY version <= 10")
def history_top10(spark, d):
    return temporal.history(_changes(spark, d), 10)


@query(f"""WITH {_CHANGES}, recent AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 20)
SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS version, strlen(content) AS bytes FROM recent WHERE ts >= TIMESTAMP '{_AT}'""")
def query_history_since(spark, d):
    return temporal.query_history(_changes(spark, d), 20, _moment())


@query(f"WITH {_CHANGES} SELECT count(DISTINCT path) AS keys, count(*) AS versions, round(count(*) / greatest(count(DISTINCT path), 1), 6) AS mean_versions FROM changes")
def history_overview(spark, d):
    return temporal.overview(_changes(spark, d))


@query(f"WITH {_CHANGES} SELECT * FROM changes WHERE ts <= TIMESTAMP '{_AT}' QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def asof_state(spark, d):
    return temporal.as_of(_changes(spark, d), _moment())


@query(f"WITH {_CHANGES} SELECT * FROM changes WHERE ts <= TIMESTAMP '{_AT}' QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1 AND content NOT LIKE '%7%'")
def asof_replay(spark, d):
    rows = _changes(spark, d)
    early = _moment("2024-01-08 00:00:00")
    snapshot = temporal.as_of(rows, early)
    return temporal.replay(snapshot, rows.filter(F.col("ts") > early), _moment(), deleted=F.col("content").contains("7"))


@query(f"""WITH {_CHANGES}, last AS (SELECT content FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)
SELECT CAST((SELECT sum(strlen(content)) FROM changes) AS BIGINT) AS all_bytes, CAST((SELECT sum(strlen(content)) FROM last) AS BIGINT) AS last_bytes,
  round((SELECT sum(strlen(content)) FROM changes) / greatest((SELECT sum(strlen(content)) FROM last), 1), 6) AS ratio""")
def compression_ratio(spark, d):
    return temporal.compression(_changes(spark, d))


@query("SELECT o_custkey AS src, o_orderstatus AS relation, o_orderpriority AS dst, max(o_orderkey) AS seq FROM orders GROUP BY ALL")
def links_upsert(spark, d):
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("dst"), F.col("o_orderkey").alias("seq"))
    return links.groupBy("src", "relation", "dst").agg(F.max("seq").alias("seq"))


@query(f"""WITH {_CHANGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM changes QUALIFY k <= 10)
SELECT path AS key, true AS "exists", max(CASE WHEN k = 1 THEN content END) AS value, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY k) AS history FROM ranked GROUP BY path""")
def retrieve_with_history(spark, d):
    rows = temporal.history(_changes(spark, d), 10).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("version", "seq", "content"))).alias("h"))
    return rows.select(F.col("path").alias("key"), F.lit(True).alias("exists"), F.col("h")[0]["content"].alias("value"), F.array_join(F.transform("h", lambda x: x["seq"].cast("string")), ",").alias("history"))


# -- conversations -----

_TEXTS = ["please implement and test it", "now add a button", "thanks", "fix the build", "optimize what you create"]
_SAID = f"""said AS (SELECT o_custkey AS conv_id, o_orderkey AS turn, CASE WHEN o_orderkey % 3 = 0 THEN 'assistant' ELSE 'user' END AS role, list_extract({_TEXTS}, CAST(o_orderkey % 5 + 1 AS INT)) AS text FROM orders)"""
_WORDS = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in conversations.TASK_WORDS) + " END"
_TYPES = ["task", "file", "decision", "error_event"]
_ENTITIES = f"""found AS (SELECT l_orderkey AS conversation_id, list_extract({_TYPES}, CAST(l_suppkey % 4 + 1 AS INT)) AS entity_type, 'n' || CAST(l_partkey AS VARCHAR) AS name,
  CASE WHEN l_suppkey % 8 < 4 THEN 'implement it' ELSE 'look' END AS content, CAST(l_linenumber AS BIGINT) AS turn, l_orderkey * 10 + l_linenumber AS entity_id FROM lineitem)"""


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", F.col("role").alias("kind"), "text")


def _said(spark, d):
    """Orders as messages: a customer is a conversation."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("turn"), F.when(F.col("o_orderkey") % 3 == 0, "assistant").otherwise("user").alias("kind"), text.alias("text"))


def _entities(spark, d, *more):
    """Order lines as entities: an order is a conversation, a line a turn."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), kind.alias("entity_type"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_suppkey") % 8 < 4, "implement it").otherwise("look").alias("content"), F.col("l_linenumber").cast("bigint").alias("turn"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entity_id"), *more)


_NEXT = """next AS (SELECT conversation_id, entity_id AS from_id, to_id, 'temporal_next' AS relationship_type, 1.0::DOUBLE AS strength, turn FROM (SELECT *, lead(entity_id) OVER w AS to_id, lead(turn) OVER w AS nt FROM found
  WINDOW w AS (PARTITION BY conversation_id ORDER BY turn, entity_id)) WHERE nt - turn = 1)"""
_RANGE = """made AS (SELECT a.conversation_id, a.entity_id AS from_id, b.entity_id AS to_id, 'creates' AS relationship_type, 0.9::DOUBLE AS strength, a.turn FROM found a JOIN found b
  ON a.conversation_id = b.conversation_id AND a.entity_type = 'task' AND b.entity_type = 'file' AND b.turn - a.turn BETWEEN 1 AND 3)"""


@query(f"WITH {_SAID} SELECT conv_id AS conversation_id, turn, 'task_' || keyword || '_' || turn AS name, left(text, 200) AS content FROM (SELECT *, {_WORDS} AS keyword FROM said WHERE role = 'user') WHERE keyword IS NOT NULL")
def task_keyword(spark, d):
    return conversations.task_entities(_said(spark, d)).select("conversation_id", "turn", "name", "content")


@query(f"WITH {_ENTITIES}, {_NEXT} SELECT * FROM next")
def temporal_next(spark, d):
    return conversations.temporal_next(_entities(spark, d))


_LINES = "lines AS (SELECT l_orderkey AS conversation_id, CAST(l_linenumber % 3 AS BIGINT) AS turn, l_orderkey * 10 + l_linenumber AS entity_id FROM lineitem)"


def _line_entities(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("turn"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entity_id"), F.lit("file").alias("entity_type"))


@query(f"""WITH {_LINES} SELECT a.conversation_id, a.entity_id AS from_id, b.entity_id AS to_id, 'modifies' AS relationship_type, 0.7::DOUBLE AS strength, a.turn
FROM lines a JOIN lines b ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id <> b.entity_id""")
def co_modified(spark, d):
    return conversations.co_modified(_line_entities(spark, d))


@query(f"WITH {_ENTITIES}, {_RANGE} SELECT * FROM made")
def task_to_file_range(spark, d):
    return conversations.task_to_file(_entities(spark, d))


@query("""SELECT conv_id AS conversation_id, count(*) AS turn_count, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, CAST(sum(length(text)) AS BIGINT) AS characters
FROM conversations GROUP BY conv_id""")
def conversation_stats(spark, d):
    return conversations.conversation_stats(_messages(spark, d))


@query("""SELECT conv_id AS conversation_id, turn, role AS kind, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations QUALIFY used <= 3000""")
def context_budget(spark, d):
    return conversations.context_budget(_messages(spark, d), 3000)


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS class, left(text, 300) AS part FROM conversations),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, class ORDER BY turn) <= CASE WHEN class = 0 THEN 10 ELSE 20 END)
SELECT conv_id AS conversation_id, turn, class, CAST(sum(length(part)) OVER (PARTITION BY conv_id ORDER BY class, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM k QUALIFY used <= 1500""")
def tool_context_budget(spark, d):
    return conversations.tool_context_budget(_messages(spark, d), 1500, uses_tool=F.col("kind") == "assistant")


@query("SELECT conv_id AS conversation_id, turn, role AS kind, left(text, 200) AS preview FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10")
def session_preview(spark, d):
    return conversations.session_preview(_messages(spark, d))


@query(f"WITH {_ENTITIES} SELECT name, entity_type, entity_id FROM found QUALIFY row_number() OVER (PARTITION BY name ORDER BY entity_id) = 1")
def merge_entities(spark, d):
    """Of rows with equal identifiers the first in the table stays, as in DuckDB with one thread; its SQL leaves that open."""
    rows = _entities(spark, d, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found, _ = conversations.merge_graphs(rows, rows, ["entity_id", "file", "row"])
    return found.select("name", "entity_type", "entity_id")


@query("SELECT conv_id, turn, left(sha256(text), 16) AS cache_key FROM conversations")
def analysis_cache_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", conversations.cache_key(F.col("text")).alias("cache_key"))


_SAME = """same AS (SELECT a.conversation_id, a.entity_id AS from_id, b.entity_id AS to_id, 'modifies' AS relationship_type, 0.7::DOUBLE AS strength, a.turn FROM found a JOIN found b
  ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id <> b.entity_id AND a.entity_type = 'file' AND b.entity_type = 'file')"""
_ALL_LINKS = f"{_ENTITIES}, {_NEXT}, {_RANGE}, {_SAME}, links AS (SELECT * FROM next UNION ALL SELECT * FROM made UNION ALL SELECT * FROM same)"
_CORE = "core AS (SELECT from_id, to_id, 'creates' AS edge_type, 1.0::DOUBLE AS weight FROM links WHERE relationship_type = 'creates')"
_SEMANTIC = "semantic AS (SELECT from_id, to_id, CASE relationship_type WHEN 'modifies' THEN 'modifies' ELSE 'temporal' END AS edge_type, strength AS weight FROM links WHERE relationship_type <> 'creates')"


def _links(spark, d):
    found = _entities(spark, d)
    return found, conversations.relationships(found)


@query(f"WITH {_ALL_LINKS}, {_CORE} SELECT * FROM core")
def graph_sparse(spark, d):
    return graph_build.build(*_links(spark, d), "sparse")[1]


@query(f"""WITH {_ALL_LINKS}, {_CORE}, {_SEMANTIC}, joined AS (SELECT * FROM core UNION ALL SELECT * FROM semantic),
pairs AS (SELECT DISTINCT a.entity_id AS from_id, b.entity_id AS to_id FROM found a JOIN found b ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id < b.entity_id)
SELECT * FROM joined UNION ALL SELECT from_id, to_id, 'similar', 0.6 FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM joined j WHERE j.from_id = p.from_id AND j.to_id = p.to_id)""")
def graph_medium(spark, d):
    return graph_build.build(*_links(spark, d), "medium")[1]


@query(f"""WITH {_ENTITIES}, nodes AS (SELECT * FROM found WHERE entity_type IN ('file', 'task', 'error_event') OR (entity_type = 'decision' AND content LIKE '%implement%'))
SELECT entity_type AS node_type, name, count(*) AS n FROM nodes GROUP BY entity_type, name""")
def graph_nodes(spark, d):
    return graph_build.nodes(_entities(spark, d), "dense").groupBy("node_type", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES} SELECT DISTINCT a.entity_id AS from_id, b.entity_id AS to_id, 'similar' AS edge_type, 0.6::DOUBLE AS weight
FROM lines a JOIN lines b ON a.conversation_id = b.conversation_id AND a.turn = b.turn AND a.entity_id < b.entity_id""")
def cooccurrence(spark, d):
    return graph_build.cooccurrence(_line_entities(spark, d))


@query("""WITH p AS (SELECT a.s_nationkey, a.s_suppkey AS from_id, b.s_suppkey AS to_id, a.s_name AS x, b.s_name AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
c AS (SELECT *, len(list_filter(range(1, CAST(least(length(x), length(y)) + 1 AS BIGINT)), lambda i: left(x, i) = left(y, i))) + len(list_filter(range(1, CAST(least(length(x), length(y)) + 1 AS BIGINT)), lambda i: right(x, i) = right(y, i))) AS common FROM p)
SELECT from_id, to_id, 'similar' AS edge_type, round(CASE WHEN x = y THEN 1.0 ELSE 2.0 * common / (length(x) + length(y)) END, 6) AS weight FROM c WHERE round(CASE WHEN x = y THEN 1.0 ELSE 2.0 * common / (length(x) + length(y)) END, 6) > 0.6""")
def name_similarity(spark, d):
    found = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("project"))
    return graph_build.similar_names(found)


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _timed(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("entity_id"), F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("entity_type"), F.col("user_id").alias("project"))


@query(f"""WITH k AS (SELECT event_id, s, s // 3600 AS hour, row_number() OVER (PARTITION BY s // 3600 ORDER BY s, event_id) AS k FROM (SELECT event_id, {_SECONDS} AS s FROM events))
SELECT a.event_id AS from_id, b.event_id AS to_id, 'temporal' AS edge_type, 0.5::DOUBLE AS weight FROM k a JOIN k b ON a.hour = b.hour AND b.k - a.k BETWEEN 1 AND 5""")
def hourly_cluster_links(spark, d):
    return graph_build.hourly_links(_timed(spark, d))


@query(f"""WITH k AS (SELECT event_id, {_SECONDS} AS s, user_id, event_type FROM events)
SELECT a.event_id AS from_id, b.event_id AS to_id, 'temporal' AS edge_type, round(1.0 / greatest(1.0, (b.s - a.s) / 3600.0), 6) AS weight FROM k a JOIN k b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.s < b.s""")
def evolution_edges(spark, d):
    return graph_build.evolution_edges(_timed(spark, d))


@query()
def synthetic_dense_edges(spark, d):
    found, links = _links(spark, d)
    return graph_build.densify(found.select("entity_id").distinct(), graph_build.core_edges(links), 1000)


# -- shared documents -----

_EDITS = """edits AS (SELECT event_id AS op_id, 'a' || CAST(user_id % 4 AS VARCHAR) AS agent_id, strftime(ts, '%Y-%m-%d %H') AS document, list_extract(['insert', 'delete', 'modify'], CAST(event_id % 3 + 1 AS INT)) AS kind,
  event_id * 7 % 101 AS place, event_type AS content, event_id % 5 AS c0, event_id % 7 AS c1, event_id % 3 AS c2, ts FROM events)"""
_PAIRED = f"""{_EDITS}, pairs AS (SELECT a.document, a.op_id AS op_a, b.op_id AS op_b, a.kind AS ka, b.kind AS kb, a.place AS pa, b.place AS pb, length(a.content) AS la, length(b.content) AS lb, a.ts AS ta, b.ts AS tb,
  a.c0 <= b.c0 AND a.c1 <= b.c1 AND a.c2 <= b.c2 AND (a.c0 < b.c0 OR a.c1 < b.c1 OR a.c2 < b.c2) AS before, b.c0 <= a.c0 AND b.c1 <= a.c1 AND b.c2 <= a.c2 AND (b.c0 < a.c0 OR b.c1 < a.c1 OR b.c2 < a.c2) AS after
  FROM edits a JOIN edits b ON a.document = b.document AND a.op_id < b.op_id)"""


def _edits(spark, d):
    return as_edits(table(spark, d, "events"))


@query(f"""WITH {_EDITS}, l AS (SELECT document, op_id AS op_a, c0, c1, c2, lead(op_id) OVER w AS op_b, lead(c0) OVER w AS d0, lead(c1) OVER w AS d1, lead(c2) OVER w AS d2 FROM edits WINDOW w AS (PARTITION BY document ORDER BY op_id))
SELECT document, op_a, op_b, CASE WHEN c0 = d0 AND c1 = d1 AND c2 = d2 THEN 'concurrent' WHEN c0 <= d0 AND c1 <= d1 AND c2 <= d2 THEN 'before' WHEN c0 >= d0 AND c1 >= d1 AND c2 >= d2 THEN 'after' ELSE 'concurrent' END AS relation FROM l WHERE op_b IS NOT NULL""")
def happens_before(spark, d):
    return collaboration.causal_steps(_edits(spark, d))


@query(f"""WITH {_PAIRED} SELECT document, op_a, op_b, CASE WHEN ta > tb THEN op_a ELSE op_b END AS winner FROM pairs WHERE NOT before AND NOT after
AND ((ka = 'insert' AND pa <= pb) OR (ka <> 'insert' AND pa <= pb AND pb < pa + la) OR (kb = 'insert' AND pb <= pa) OR (kb <> 'insert' AND pb <= pa AND pa < pb + lb))""")
def op_conflicts(spark, d):
    return collaboration.conflicts(_edits(spark, d))


@query(f"WITH {_EDITS} SELECT document, agent_id, op_id, kind, content FROM edits QUALIFY row_number() OVER (PARTITION BY document, agent_id ORDER BY ts DESC, op_id DESC) = 1")
def lww_winner(spark, d):
    return collaboration.last_writers(_edits(spark, d), ["document", "agent_id"]).select("document", "agent_id", "op_id", "kind", "content")


@query()
def crdt_fold(spark, d):
    return collaboration.applied(_edits(spark, d))


@query(f"WITH {_EDITS} SELECT document, row_number() OVER (PARTITION BY document ORDER BY ts DESC, op_id DESC) AS k, op_id, agent_id, kind, content AS preview FROM edits QUALIFY k <= 10")
def recent_operations(spark, d):
    return collaboration.recent(_edits(spark, d))


@query(f"WITH {_EDITS} SELECT count(DISTINCT document) AS documents, count(DISTINCT agent_id) AS agents, count(*) AS operations, round(count(*) / count(DISTINCT document), 6) AS ops_per_document FROM edits")
def collaboration_stats(spark, d):
    return collaboration.stats(_edits(spark, d))


# -- operations -----

_OPS = "ops AS (SELECT event_id AS seq, ts, 'agent' || CAST(user_id AS VARCHAR) AS agent_id, event_type AS op, value AS latency_ms FROM events)"


def _ops(spark, d):
    return as_operations(table(spark, d, "events"))


def _pct(*shares: tuple[str, float]) -> str:
    return ", ".join(f"round(quantile_cont(latency_ms, {p}), 6) AS {name}" for name, p in shares)


_LATENCY = f"""kept AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY op ORDER BY seq DESC) <= {monitoring.RING}),
figures AS (SELECT op, count(*) AS samples, round(avg(latency_ms), 6) AS mean_ms, {_pct(("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))} FROM kept GROUP BY op)"""


@query(f"WITH {_OPS}, {_LATENCY} SELECT * FROM figures")
def latency_percentiles(spark, d):
    return monitoring.latency(_ops(spark, d))


@query(f"WITH {_OPS} SELECT seq, op, round(avg(latency_ms) OVER w + 1e-9, 6) AS mean_ms, max(latency_ms) OVER w AS max_ms FROM ops WINDOW w AS (PARTITION BY op ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def latency_rolling(spark, d):
    return monitoring.rolling_latency(_ops(spark, d))


@query(f"WITH {_OPS} SELECT seq, op, round(count(*) OVER (PARTITION BY op ORDER BY {_SECONDS} RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) / 600.0, 6) AS per_second FROM ops")
def throughput_600s(spark, d):
    return monitoring.throughput(_ops(spark, d), 600)


_DELTAS = f"{_OPS}, deltas AS (SELECT seq, agent_id, CASE WHEN op = 'error' THEN -latency_ms ELSE latency_ms END AS delta FROM ops)"


@query(f"""WITH {_DELTAS}, used AS (SELECT seq, agent_id, round(sum(delta) OVER (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS in_use FROM deltas)
SELECT seq, agent_id, in_use, max(in_use) OVER (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM used""")
def running_peak(spark, d):
    rows = _ops(spark, d).select("seq", "agent_id", F.when(F.col("op") == "error", -F.col("latency_ms")).otherwise(F.col("latency_ms")).alias("delta"))
    return monitoring.memory_peaks(rows)


@query(f"WITH {_OPS}, a AS (SELECT agent_id AS address, seq, ts FROM ops WHERE op = 'signup') SELECT * FROM a WHERE ts < TIMESTAMP '{_AT}' AND address NOT IN (SELECT agent_id FROM ops WHERE op = 'purchase' AND latency_ms > 60)")
def leak_candidates(spark, d):
    ops = _ops(spark, d)
    allocations = ops.filter("op = 'signup'").select(F.col("agent_id").alias("address"), "seq", "ts")
    return monitoring.leaks(allocations, ops.filter("op = 'purchase' AND latency_ms > 60").select(F.col("agent_id").alias("address")), _moment())


@query(f"""WITH {_OPS}, n AS (SELECT agent_id, op, count(*) AS n FROM ops GROUP BY ALL)
SELECT agent_id, round(var_pop(n) * count(*), 6) AS deviation FROM n GROUP BY agent_id HAVING round(var_pop(n) * count(*), 6) > 10""")
def agent_anomaly(spark, d):
    return monitoring.anomalies(_ops(spark, d))


@query(f"""WITH {_OPS}, {_LATENCY} SELECT 'latency' AS kind, op AS subject, 'critical' AS severity, p99_ms AS value FROM figures WHERE p99_ms > 50
UNION ALL SELECT * FROM (SELECT 'throughput', op, 'warning', round(count(*) / greatest(max({_SECONDS}) - min({_SECONDS}), 1), 6) AS v FROM ops GROUP BY op) WHERE v < 100""")
def alerts(spark, d):
    return monitoring.alerts(_ops(spark, d), p99_ms=50.0)


_HALVES = f"""{_OPS}, cur AS (SELECT op AS name, round(avg(latency_ms), 6) AS latency, round(max(latency_ms), 6) AS peak FROM ops WHERE ts >= TIMESTAMP '{_AT}' GROUP BY op),
base AS (SELECT op AS name, round(avg(latency_ms), 6) AS latency, round(max(latency_ms), 6) AS peak FROM ops WHERE ts < TIMESTAMP '{_AT}' GROUP BY op)"""


def _halves(spark, d):
    ops = _ops(spark, d)
    figures = [F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(F.max("latency_ms"), 6).alias("peak")]
    return tuple(ops.filter(part).groupBy(F.col("op").alias("name")).agg(*figures) for part in (F.col("ts") >= _moment(), F.col("ts") < _moment()))


@query(f"""WITH {_HALVES}, p AS (SELECT name, c.latency AS value, b.latency AS baseline, round((c.latency - b.latency) / b.latency * 100, 6) AS percent FROM cur c JOIN base b USING (name))
SELECT *, CASE WHEN percent < 10 THEN 'none' WHEN percent < 25 THEN 'minor' WHEN percent < 50 THEN 'moderate' WHEN percent < 100 THEN 'major' ELSE 'critical' END AS severity, percent > 10 AS regressed FROM p""")
def regression_report(spark, d):
    now, before = _halves(spark, d)
    return monitoring.regressions(now.withColumnRenamed("latency", "value"), before.withColumnRenamed("latency", "baseline"))


@query(f"""WITH {_HALVES}, p AS (SELECT name, 'latency' AS metric, c.latency AS value, b.latency AS baseline FROM cur c JOIN base b USING (name) UNION ALL SELECT name, 'peak', c.peak, b.peak FROM cur c JOIN base b USING (name))
SELECT *, round((value - baseline) / baseline * 100, 6) AS percent FROM p WHERE round((value - baseline) / baseline * 100, 6) > 0""")
def suite_regressions(spark, d):
    return monitoring.suite_regressions(*_halves(spark, d), ["latency", "peak"], 0.0)


@query(f"WITH {_OPS}, r AS (SELECT op, latency_ms, row_number() OVER (PARTITION BY op ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY op) AS n FROM ops) SELECT op, latency_ms AS baseline FROM r WHERE k = n // 2 + 1")
def upper_median_baseline(spark, d):
    return monitoring.upper_median(_ops(spark, d), "op", "latency_ms")


_AGENTS = "agents AS (SELECT agent_id, count(*) AS requests, round(100.0 * count(*) FILTER (op <> 'error') / count(*), 6) AS success_percent, round(avg(latency_ms), 6) AS mean_ms, max(ts) AS last_activity FROM ops GROUP BY agent_id)"


@query(f"WITH {_OPS}, {_AGENTS} SELECT * FROM agents")
def agent_metrics(spark, d):
    return monitoring.agent_metrics(_ops(spark, d), F.col("op") != "error")


@query(f"WITH {_OPS}, {_AGENTS} SELECT count(*) AS agents, round(avg(success_percent), 6) AS success_percent, round(avg(mean_ms), 6) AS mean_ms FROM agents")
def agent_overall(spark, d):
    return monitoring.overall(monitoring.agent_metrics(_ops(spark, d), F.col("op") != "error"))


@query(f"WITH {_OPS}, n AS (SELECT seq, agent_id, ts, lead(agent_id) OVER w AS next_agent, lead(ts) OVER w AS next_ts FROM ops WINDOW w AS (ORDER BY ts, seq)) SELECT seq, agent_id, next_agent FROM n WHERE next_agent <> agent_id AND epoch(next_ts) - epoch(ts) < 10")
def adjacent_collab(spark, d):
    return monitoring.adjacent_pairs(_ops(spark, d))


@query(f"WITH {_OPS} SELECT * FROM (SELECT * FROM ops ORDER BY ts DESC, seq DESC LIMIT 100)")
def audit_tail(spark, d):
    return monitoring.audit_tail(_ops(spark, d), 100)


@query(f"WITH {_OPS} SELECT op, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(count(*) / (SELECT count(*) FROM ops), 6) AS share FROM ops GROUP BY op")
def operation_stats(spark, d):
    return monitoring.operation_stats(_ops(spark, d))


@query(f"WITH {_OPS} SELECT op, round(avg(latency_ms), 6) AS mean, round(stddev_samp(latency_ms), 6) AS stddev, {_pct(('p50', 0.5), ('p90', 0.9), ('p99', 0.99))} FROM ops GROUP BY op")
def describe_latency(spark, d):
    return monitoring.describe(_ops(spark, d))


@query(f"WITH {_OPS} SELECT seq, op, round(avg(latency_ms) OVER (PARTITION BY op ORDER BY seq ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS mean_ms FROM ops")
def running_mean(spark, d):
    return monitoring.running_mean(_ops(spark, d))


@query(f"WITH {_OPS} SELECT agent_id, max(ts) AS last_activity, count(*) AS operations, {_SECONDS.replace('ts', chr(39) + '2024-01-30 00:00:00' + chr(39) + '::TIMESTAMP')} - CAST(floor(epoch(max(ts))) AS BIGINT) < 86400 AS active FROM ops GROUP BY agent_id")
def agent_sessions(spark, d):
    return monitoring.agent_sessions(_ops(spark, d), _moment("2024-01-30 00:00:00"), 86400).drop("usage")


@query(f"WITH {_OPS} SELECT agent_id, count(*) AS total, count(*) FILTER (op <> 'error') AS succeeded, count(*) FILTER (op = 'error') AS failed, round(count(*) FILTER (op <> 'error') / count(*), 6) AS success_rate FROM ops GROUP BY agent_id")
def auth_outcomes(spark, d):
    return monitoring.outcomes(_ops(spark, d), ["agent_id"], F.col("op") != "error")


# -- limits -----


@query(f"WITH {_OPS} SELECT seq, op AS key, row_number() OVER (PARTITION BY op, date_trunc('hour', ts) ORDER BY seq) AS in_hour, row_number() OVER (PARTITION BY op, date_trunc('hour', ts) ORDER BY seq) <= 3 AS allowed FROM ops")
def rate_limit_hourly(spark, d):
    attempts = _ops(spark, d).select("seq", F.col("op").alias("key"), "ts")
    return limits.hourly_limit(attempts, 3).drop("ts")


@query(f"""WITH {_OPS}, i AS (SELECT seq, agent_id, op, sum(CASE WHEN op <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ops)
SELECT seq, agent_id AS user_id, row_number() OVER (PARTITION BY agent_id, island ORDER BY seq) AS failures, row_number() OVER (PARTITION BY agent_id, island ORDER BY seq) >= 2 AS locked FROM i WHERE op = 'error'""")
def lockout_streaks(spark, d):
    rows = _ops(spark, d).select("seq", F.col("agent_id").alias("user_id"), (F.col("op") != "error").alias("success"))
    return limits.lockouts(rows, 2).select("seq", "user_id", "failures", "locked")


@query("""WITH locks AS (SELECT o_custkey AS path, o_orderkey AS lock_id, o_orderpriority AS agent_id, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS kind, o_orderdate AS acquired, o_orderdate + INTERVAL 90 DAY AS expires FROM orders)
SELECT a.path, a.lock_id AS lock_a, b.lock_id AS lock_b FROM locks a JOIN locks b ON a.path = b.path AND a.lock_id < b.lock_id AND a.acquired < b.expires AND b.acquired < a.expires AND a.agent_id <> b.agent_id AND NOT (a.kind = 'read' AND b.kind = 'read')""")
def lock_overlap(spark, d):
    locks = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("lock_id"), F.col("o_orderpriority").alias("agent_id"), F.when(F.col("o_orderkey") % 2 == 0, "read").otherwise("write").alias("kind"), F.col("o_orderdate").alias("acquired"), F.expr("o_orderdate + INTERVAL '90' DAY").alias("expires"))
    return limits.lock_conflicts(locks)


@query(f"""WITH {_OPS}, m AS (SELECT agent_id, ts, seq, CASE WHEN {_SECONDS} - lag({_SECONDS}) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM ops WINDOW w AS (PARTITION BY agent_id ORDER BY ts, seq)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY agent_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m)
SELECT agent_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM s GROUP BY agent_id, session""")
def session_idle(spark, d):
    return limits.sessions(_ops(spark, d))


_PERMISSIONS = [("admin", k) for k in ("view", "signup", "purchase", "error", "click")] + [("developer", "error"), ("developer", "click"), ("readonly", "view")]


@query(f"WITH {_OPS}, permissions(role, op) AS (VALUES {', '.join(f'{p!r}' for p in _PERMISSIONS)}) SELECT role, op, seq FROM ops JOIN permissions USING (op)")
def role_routing(spark, d):
    return limits.routed(_ops(spark, d), spark.createDataFrame(_PERMISSIONS, "role string, op string"), "op").select("role", "op", "seq")


@query(f"""WITH {_OPS}, k AS (SELECT op AS key, row_number() OVER (PARTITION BY op, date_trunc('hour', ts) ORDER BY seq) <= 3 AS allowed FROM ops), t AS (SELECT round(count(*) / 10000.0, 6) AS utilisation, count(DISTINCT CASE WHEN NOT allowed THEN key END) AS limited FROM k)
SELECT *, concat_ws('; ', CASE WHEN utilisation > 0.8 THEN 'raise capacity' END, CASE WHEN limited > 10 THEN 'many limited keys' END) AS advice FROM t""")
def security_report(spark, d):
    attempts = _ops(spark, d).select("seq", F.col("op").alias("key"), "ts")
    return limits.security_report(limits.hourly_limit(attempts, 3), 10000)


def _arrivals(spark, d):
    return _ops(spark, d).select("seq", F.col("op").alias("key"), (F.unix_timestamp("ts") * 1000).alias("at_ms"))


@query()
def rate_limit_anchored(spark, d):
    return stateful.decided(_arrivals(spark, d), stateful.anchored_window(3, 3_600_000))


@query()
def connection_blocks(spark, d):
    return stateful.decided(_arrivals(spark, d), stateful.gap_limit(5, 3_600_000, 14_400_000))


@query(f"WITH {_OPS}, hours AS (SELECT op, date_trunc('hour', ts) AS began FROM ops) SELECT op, began, count(*) AS events, round(count(*) / 3600.0, 6) AS per_second FROM hours WHERE began + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ops) GROUP BY op, began")
def stream_throughput(spark, d):
    """A stream over the table of events, as far as its watermark comes."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ops = as_operations(rows).withColumn("ts", F.col("ts").cast("timestamp"))
    told = pipelines.run_to_table(pipelines.windowed_throughput(ops, "1 hour"), "throughput")
    return told.withColumn("began", F.col("began").cast("timestamp_ntz"))
