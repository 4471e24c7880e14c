"""Stored graphs: a folder of nodes and edges in Parquet, split by graph name, with a checksum of each graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.storage import read_text, write_text

VERSION = 1
JSON_GRAPH = """entities ARRAY<STRUCT<name: STRING, type: STRING, description: STRING, file_path: STRING, language: STRING>>,
relationships ARRAY<STRUCT<source: STRING, target: STRING, type: STRING, confidence: DOUBLE, context: STRING>>, metadata STRING"""


class CorruptGraph(ValueError):
    """A stored graph of another version, or one that isn't what was written."""


def checksum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_name, n_nodes, n_edges, checksum): order doesn't matter, repeated rows do."""
    n = nodes.groupBy("graph_name").agg(F.count("*").alias("n_nodes"), F.sum(F.xxhash64("id", "name").cast("decimal(38,0)")).alias("a"))
    e = edges.groupBy("graph_name").agg(F.count("*").alias("n_edges"), F.sum(F.xxhash64("from_node", "to_node", "weight").cast("decimal(38,0)")).alias("b"))
    both = n.join(e, "graph_name", "full")
    zero = F.lit(0).cast("decimal(38,0)")
    return both.select("graph_name", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.xxhash64(F.coalesce("a", zero), F.coalesce("b", zero)).alias("checksum"))


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("graph_name").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("graph_name").parquet(f"{path}/edges")
    write_text(nodes.sparkSession, f"{path}/schemas.json", json.dumps([df.schema.json() for df in (nodes, edges)]))
    checksum(nodes, edges).withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/checksums")


def load_graphs(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), checked against what was written."""
    schemas = [T.StructType.fromJson(json.loads(x)) for x in json.loads(read_text(spark, f"{path}/schemas.json") or "[]")]
    if len(schemas) != 2:
        raise CorruptGraph(f"{path} has no schemas")
    nodes, edges = (spark.read.schema(s).parquet(f"{path}/{t}") for s, t in zip(schemas, ("nodes", "edges")))
    written = spark.read.parquet(f"{path}/checksums")
    if not written.filter(F.col("version") != VERSION).isEmpty():
        raise CorruptGraph(f"{path} isn't of version {VERSION}")
    if verify:
        columns = ["graph_name", "n_nodes", "n_edges", "checksum"]
        now = checksum(nodes.withColumn("graph_name", F.col("graph_name").cast("string")), edges.withColumn("graph_name", F.col("graph_name").cast("string"))).select(*columns)
        before = written.select(*columns)
        if not now.exceptAll(before).isEmpty() or not before.exceptAll(now).isEmpty():
            raise CorruptGraph(f"{path} isn't what was written")
    return nodes, edges


def read_json_graphs(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(entities, undirected edges without repeats) of JSON files; relationships to unknown names are left out."""
    raw = spark.read.schema(JSON_GRAPH).option("multiLine", "true").json(list(paths)).withColumn("graph_name", F.col("_metadata.file_name"))
    entities = raw.select("graph_name", F.posexplode("entities").alias("pos", "e")).select("graph_name", "pos", "e.*").dropDuplicates(["graph_name", "name"])
    links = raw.select("graph_name", F.explode("relationships").alias("r")).select("graph_name", F.col("r.source").alias("src"), F.col("r.target").alias("dst"), F.coalesce("r.confidence", F.lit(1.0)).alias("weight"))
    known = entities.select("graph_name", "name")
    for end in ("src", "dst"):
        links = links.join(known.withColumnRenamed("name", end), ["graph_name", end], "left_semi")
    both = links.unionByName(links.select("graph_name", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return entities, both.groupBy("graph_name", "src", "dst").agg(F.max("weight").alias("weight"))


def write_json_graph(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """One JSON document a graph, as read_json_graphs reads them."""
    e = entities.groupBy("graph_name").agg(F.collect_list(F.struct(*[c for c in entities.columns if c != "graph_name"])).alias("entities"))
    r = relationships.groupBy("graph_name").agg(F.collect_list(F.struct(*[c for c in relationships.columns if c != "graph_name"])).alias("relationships"))
    e.join(r, "graph_name", "full").write.mode("overwrite").json(path)
