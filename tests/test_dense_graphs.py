"""Edges between any two entities, looked for block by block."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import conversations, graph_build

FOUND = "entity_id bigint, conversation_id bigint, turn bigint, entity_type string, name string, content string, project int, ts bigint"


def _found(spark, n=60):
    rng = random.Random(5)
    name = lambda: rng.choice(["alpha", "alphb", "beta", "x", "", None, "é𝄞a", "é𝄞b", "a\0", "a"])
    kinds = ["file", "task", "error_event", "other", "decision"]
    maybe = lambda x: rng.choice([x] * 9 + [None])
    rows = [(rng.randrange(45), maybe(rng.randrange(3)), maybe(rng.randrange(4)), maybe(rng.choice(kinds)), name(), "implement it", maybe(rng.randrange(2)), maybe(rng.choice([rng.randrange(9) * 900, 6_400_000]))) for _ in range(n)]
    return spark.createDataFrame(rows, FOUND)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [7, 1024])
def test_dense_edges_are_those_of_joins(spark, block, monkeypatch):
    """Identifiers and names that repeat, nulls and several blocks: the same as joining all with all and leaving out what is joined already."""
    monkeypatch.setattr(graph_build, "BLOCK", block)
    found = _found(spark).localCheckpoint()
    links = conversations.relationships(found).unionByName(spark.createDataFrame([(0, 1, 2, "calls", 0.9, 0), (0, 3, 4, None, 0.5, 0), (0, 1, 9, "calls", 0.8, 0)], "conversation_id bigint, from_id bigint, to_id bigint, relationship_type string, strength double, turn bigint")).localCheckpoint()
    edges = graph_build.core_edges(links).unionByName(graph_build.semantic_edges(links))
    edges = edges.unionByName(graph_build.cooccurrence(found, edges))
    edges = edges.unionByName(graph_build.dense_edges(links, edges)).localCheckpoint()
    kept = graph_build.nodes(found, "dense").localCheckpoint()
    a, b = (kept.filter("name <> ''").select(F.col("entity_id").alias(i), F.col("name").alias(n)) for i, n in (("from_id", "x"), ("to_id", "y")))
    named = a.join(b, F.col("from_id") < F.col("to_id")).select("from_id", "to_id", F.lit("similar").alias("edge_type"), F.round(graph_build.name_similarity(F.col("x"), F.col("y")), 6).alias("weight")).filter("weight > 0.6")
    new = named.join(edges.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    want = edges.unionByName(new.select(*edges.columns)).unionByName(graph_build.evolution_edges(kept, present=edges)).localCheckpoint()
    # of rows that repeat an identifier and a moment, either may come first in its hour
    hourly = graph_build.hourly_links(kept.dropDuplicates(["entity_id", "ts"]))
    got = graph_build.build(found, links, "dense")[1]
    firm = (F.col("edge_type") != "temporal") | (F.col("weight") != 0.5)
    assert _rows(got.filter(firm)) == _rows(want.filter(firm)) and hourly.count() > 0
    assert _rows(graph_build.similar_names(kept)) == _rows(named)
    sets = graph_build.build_set(found, links)[1]
    assert _rows(sets.filter("graph_name = 'dense'").drop("graph_name")) == _rows(got)
    for density in ("sparse", "medium"):
        assert _rows(sets.filter(F.col("graph_name") == density).drop("graph_name")) == _rows(graph_build.build(found, links, density)[1])


def test_pairs_are_not_shuffled(spark):
    """Equal beginnings of all names: no task had all pairs, and none is joined row by row."""
    found = spark.range(4000).select(F.col("id").alias("entity_id"), F.format_string("Supplier#%09d", "id").alias("name"))
    told = graph_build.similar_names(found)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and told.rdd.getNumPartitions() > 4
