"""What a task holds or sends doesn't grow with the tables."""

import pytest
from pyspark.sql import functions as F

from weftline import storage
from weftline.operators import graph, vectors
from weftline.sources.tables import as_edges


def test_edges_are_made_by_as_many_tasks_as_they_take(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    lines = spark.range(1000).select((F.col("id") % 100).alias("l_orderkey"), (F.col("id") * 7 % 53).alias("l_partkey"), F.col("id").alias("l_linenumber"), (F.col("id") % 9).cast("double").alias("l_quantity"))
    edges = as_edges(lines)
    assert edges.rdd.getNumPartitions() == 20
    few = graph.degree_centrality(edges).orderBy("node").collect()
    monkeypatch.setattr(storage, "TASK_ROWS", 10**6)
    assert as_edges(lines).rdd.getNumPartitions() == 1 and graph.degree_centrality(as_edges(lines)).orderBy("node").collect() == few


@pytest.mark.parametrize("frontier", [0, 50_000])
def test_paths_by_pieces_are_those_walked(spark, frontier, monkeypatch):
    """Frontiers broadcast and joined; paths of 37 edges are put together in six rounds."""
    monkeypatch.setattr(graph, "FRONTIER", frontier)
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)] + [(i, i + 32, 40.0) for i in range(3)] + [(2, 9, 0.5)], "src bigint, dst bigint, weight double")
    seed, all_nodes = spark.createDataFrame([(0,)], "node bigint"), graph.nodes_of(chain)
    paths = graph.shortest_paths(chain, seed, 1e9)
    walked = {r["target"]: (r["dist"], r["path"]) for r in graph.path_to(paths, all_nodes).collect()}
    assert {r["target"]: (r["dist"], r["path"]) for r in graph.path_to(paths, all_nodes, many=True).collect()} == walked and walked[9] == (2.5, [0, 1, 2, 9])


def test_similarities_are_computed_a_few_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "AT_ONCE", 64)
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
    rows = rng.normal(size=(40, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([lists(np.arange(40), pa.int64()), lists(rows.ravel(), pa.float32())] * 2, ["a_ids", "a_rows", "b_ids", "b_rows"])
    told = list(vectors._partners(3, None, False)(iter([batch])))
    assert len(told) == 40 and all(b.num_rows == 3 for b in told)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    vectors.bound_batches(spark)
    assert spark.conf.get(key, None) is not None
