"""The five primitives over stored tables: store, retrieve, search, link, transform; batches, logs and statistics.

An engine keeps append-only Parquet tables under one folder (changes, metadata, links, operations, embeddings).
Every primitive validates its parameters and returns a DataFrame; more can be registered.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import PASSED_THROUGH, TRANSFORMS, transform
from weftline.functions.vectors import vector
from weftline.operators import fusion, graph, lexical, temporal, vectors

SCHEMAS = {
    "changes": "seq BIGINT, ts BIGINT, path STRING, content STRING, indexed BOOLEAN",
    "metadata": "seq BIGINT, path STRING, metadata MAP<STRING, STRING>",
    "links": "seq BIGINT, ts BIGINT, src STRING, relation STRING, dst STRING, metadata MAP<STRING, STRING>, agent_id STRING",
    "operations": "seq BIGINT, ts BIGINT, op STRING, agent_id STRING, latency_ms DOUBLE, session_id STRING",
    "embeddings": "seq BIGINT, path STRING, embedding ARRAY<FLOAT>",
}
SEARCHES = ("lexical", "semantic", "graph", "temporal", "hybrid")
INDEXED_OVER = 50


class InvalidRequest(ValueError):
    """Parameters that a primitive doesn't take."""


@dataclass(frozen=True)
class Primitive:
    execute: Callable[..., DataFrame]
    validate: Callable[[dict[str, Any]], None]


def _text(params: dict[str, Any], *names: str) -> None:
    for name in names:
        if not isinstance(params.get(name), str) or not params[name]:
            raise InvalidRequest(f"{name} must be a text that isn't empty")


def _plain(metadata: dict[str, Any] | None) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in (metadata or {}).items()}


class Engine:
    def __init__(self, spark: SparkSession, root: str, agent_id: str = "default", session_id: str | None = None):
        self.spark, self.root, self.agent_id = spark, root.rstrip("/"), agent_id
        self.session_id = session_id or self.new_session()
        self._last = 0
        self.primitives: dict[str, Primitive] = {
            "store": Primitive(self.store, lambda p: _text(p, "key", "value")),
            "retrieve": Primitive(self.retrieve, lambda p: _text(p, "key")),
            "search": Primitive(self.search, self._check_search),
            "link": Primitive(self.link, lambda p: _text(p, "source", "target", "relation")),
            "transform": Primitive(self.transform, self._check_transform),
        }

    # -- tables -----

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _next(self) -> int:
        self._last = max(time.time_ns(), self._last + 1)
        return self._last

    @staticmethod
    def new_session() -> str:
        return f"session-{time.time_ns()}"

    # -- validation -----

    @staticmethod
    def _check_search(params: dict[str, Any]) -> None:
        _text(params, "query")
        if params.get("kind", "lexical") not in SEARCHES:
            raise InvalidRequest(f"kind must be one of {', '.join(SEARCHES)}")

    @staticmethod
    def _check_transform(params: dict[str, Any]) -> None:
        _text(params, "operation", "data")
        if params["operation"] not in (*TRANSFORMS, *PASSED_THROUGH):
            raise InvalidRequest("unknown operation")

    # -- dispatch -----

    def register(self, name: str, execute: Callable[..., DataFrame], validate: Callable[[dict[str, Any]], None] = lambda p: None) -> None:
        self.primitives[name] = Primitive(execute, validate)

    def execute(self, name: str, params: dict[str, Any], agent_id: str | None = None) -> DataFrame:
        """Look up, validate, run, log."""
        if name not in self.primitives:
            raise InvalidRequest(f"no primitive {name!r}")
        primitive = self.primitives[name]
        primitive.validate(params)
        began = time.perf_counter()
        result = primitive.execute(**params)
        self._append("operations", [(self._next(), int(time.time()), name, agent_id or self.agent_id, (time.perf_counter() - began) * 1000, self.session_id)])
        return result

    # -- primitives -----

    def store(self, key: str, value: str, metadata: dict[str, Any] | None = None, embedding: list[float] | None = None) -> DataFrame:
        """(success, key, timestamp, indexed)."""
        return self.batch_store([{"key": key, "value": value, "metadata": metadata, "embedding": embedding}]).select("success", "key", "timestamp", "indexed")

    def batch_store(self, requests: list[dict[str, Any]]) -> DataFrame:
        """A row for each request with its success or error; all good ones are one append."""
        now, told, changes, metadata, embeddings = int(time.time()), [], [], [], []
        for r in requests:
            try:
                _text(r, "key", "value")
            except InvalidRequest as e:
                told.append((False, r.get("key"), None, None, str(e)))
                continue
            seq, indexed = self._next(), len(r["value"]) > INDEXED_OVER
            own = {"agent_id": self.agent_id, "session_id": self.session_id, "timestamp": str(now), "size": str(len(r["value"].encode()))}
            changes.append((seq, now, r["key"], r["value"], indexed))
            metadata.append((seq, r["key"], own | _plain(r.get("metadata"))))
            if r.get("embedding"):
                embeddings.append((seq, r["key"], [float(x) for x in r["embedding"]]))
            told.append((True, r["key"], now, indexed, None))
        for name, rows in (("changes", changes), ("metadata", metadata), ("embeddings", embeddings)):
            if rows:
                self._append(name, rows)
        return self.spark.createDataFrame(told, "success BOOLEAN, key STRING, timestamp BIGINT, indexed BOOLEAN, error STRING")

    def retrieve(self, key: str, include_history: bool = False) -> DataFrame:
        """(exists, key, value, metadata[, history]): one row, also for an unknown key."""
        asked = self.spark.createDataFrame([(key,)], "key STRING")
        mine = self.table("changes").filter(F.col("path") == key)
        value = mine.agg(F.max_by("content", "seq").alias("value"), F.count("*").alias("n"))
        meta = self.table("metadata").filter(F.col("path") == key).agg(F.max_by("metadata", "seq").alias("metadata"))
        out = asked.crossJoin(value).crossJoin(meta).select((F.col("n") > 0).alias("exists"), "key", "value", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
        if include_history:
            newest = temporal.history_of(mine, key, 10).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ts", "content")), asc=False), lambda x: F.struct(x["ts"].alias("ts"), x["content"].alias("content"))).alias("history"))
            out = out.crossJoin(newest)
        return out

    def documents(self) -> DataFrame:
        return temporal.latest(self.table("changes")).select(F.col("path").alias("doc_id"), F.col("content").alias("text"), "ts")

    def links_now(self) -> DataFrame:
        """The last link of each (source, relation, target)."""
        best = self.table("links").groupBy("src", "relation", "dst").agg(F.max_by(F.struct("ts", "metadata", "agent_id"), "seq").alias("v"))
        return best.select("src", "relation", "dst", "v.*")

    def search(self, query: str, kind: str = "lexical", max_results: int = 20, threshold: float | None = None, embedding: list[float] | None = None, weights: tuple[float, float, float] | None = None, starting_nodes: list[str] | None = None, max_hops: int = 2, since: int | None = None, until: int | None = None) -> DataFrame:
        """(key, score): the best stored values; temporal search takes a range of times, graph search starting keys."""
        docs = self.documents()
        legs: list[DataFrame | None] = [None, None, None]
        w = fusion.Weights(*weights) if weights else fusion.Weights()
        run = fusion.route(w, embedding is not None, starting_nodes is not None) if kind == "hybrid" else (kind == "lexical", kind == "semantic", kind == "graph")
        if kind == "semantic" and embedding is None or kind == "graph" and starting_nodes is None:
            raise InvalidRequest(f"{kind} search needs {'an embedding' if kind == 'semantic' else 'starting nodes'}")
        if run[0]:
            legs[0] = lexical.search(docs, query, 2 * max_results).select("doc_id", "score")
        if run[1]:
            stored = temporal.latest(self.table("embeddings"))
            legs[1] = vectors.nearest(stored, vector(embedding), 2 * max_results, "path", "embedding").select(F.col("id").alias("doc_id"), "similarity")
        if run[2]:
            seeds = self.spark.createDataFrame([(n,) for n in starting_nodes], "node STRING")
            legs[2] = graph.hops(self.links_now().select("src", "dst"), seeds, max_hops).select(F.col("node").alias("doc_id"), "distance")
        if kind == "hybrid":
            found = fusion.combine(*legs, w, max_results).select("doc_id", F.col("combined_score").alias("score"))
        elif kind == "temporal":
            within = docs.filter(F.col("text").contains(query))
            if since is not None:
                within = within.filter(F.col("ts") >= since)
            if until is not None:
                within = within.filter(F.col("ts") <= until)
            found = within.select("doc_id", F.col("ts").cast("double").alias("score"))
        elif kind == "graph":
            found = legs[2].select("doc_id", F.round(1 / (F.col("distance") + 1), 6).alias("score"))
        else:
            leg = legs[0] if kind == "lexical" else legs[1]
            found = leg.select("doc_id", F.col(leg.columns[1]).alias("score"))
        if threshold is not None:
            found = found.filter(F.col("score") >= threshold)
        return found.orderBy(F.desc("score"), "doc_id").limit(max_results).withColumnRenamed("doc_id", "key")

    def batch_search(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """Lexical search for a table of (item_id, text) at once."""
        return lexical.batch_search(lexical.build_index(self.documents()), queries, n)

    def link(self, source: str, target: str, relation: str, metadata: dict[str, Any] | None = None) -> DataFrame:
        """(success, source, relation, target, timestamp)."""
        now = int(time.time())
        self._append("links", [(self._next(), now, source, relation, target, _plain(metadata), self.agent_id)])
        return self.spark.createDataFrame([(True, source, relation, target, now)], "success BOOLEAN, source STRING, relation STRING, target STRING, timestamp BIGINT")

    def transform(self, operation: str, data: str) -> DataFrame:
        """(operation, output, input_size, output_size)."""
        row = self.spark.createDataFrame([(data,)], "data STRING")
        told = row.select(F.lit(operation).alias("operation"), transform(operation, F.col("data")).alias("output"), F.length("data").alias("input_size"))
        return told.withColumn("output_size", F.length("output"))

    # -- logs -----

    def operation_logs(self, agent: str | None = None, n: int = 100) -> DataFrame:
        """The newest operations, of agents whose name has ``agent`` in it."""
        log = self.table("operations")
        return (log.filter(F.col("agent_id").contains(agent)) if agent else log).orderBy(F.desc("seq")).limit(n)

    def clean_logs(self, before: int) -> int:
        """Operations from before a moment go; their number."""
        log = self.table("operations")
        gone = log.filter(F.col("ts") < before).count()
        if gone:
            kept = f"{self.root}/operations-{self._next()}"
            log.filter(F.col("ts") >= before).write.parquet(kept)
            self.spark.read.parquet(kept).write.mode("overwrite").parquet(f"{self.root}/operations")
            from weftline.storage import drop_path

            drop_path(self.spark, kept)
        return gone

    def performance(self) -> DataFrame:
        """(op, n, mean_ms, share)."""
        log = self.table("operations")
        each = log.groupBy("op").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"))
        return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))

    def list_primitives(self) -> DataFrame:
        """(name, uses) of all registered primitives."""
        names = self.spark.createDataFrame([(n,) for n in self.primitives], "name STRING")
        used = self.table("operations").groupBy(F.col("op").alias("name")).agg(F.count("*").alias("uses"))
        return names.join(used, "name", "left").select("name", F.coalesce("uses", F.lit(0)).alias("uses"))
