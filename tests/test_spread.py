"""Work that one key, one document or few bytes would leave to a single task."""

import random
from collections import Counter

from oracle import MIDDLE
from pyspark.sql import functions as F

from weftline.functions.text import tokens_of
from weftline.operators import lexical
from weftline.plans import surfaces


def test_edges_of_a_stored_graph_are_made_in_parts(spark, monkeypatch):
    """However many edges a graph has, a task makes few of them."""
    monkeypatch.setattr(surfaces, "TASK_EDGES", 3)
    edges = surfaces._stored_graph(spark, MIDDLE)[1]
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    largest = edges.groupBy("graph_name").count().agg(F.max("count")).first()[0]
    assert max(sizes) < largest and len(sizes) > edges.select("graph_name").distinct().count()


def test_batch_search_by_shards_is_a_search_each(spark, monkeypatch):
    """Shards of few postings and blocks of few queries; texts that repeat tie, and the least number stays."""
    monkeypatch.setattr(lexical, "SHARD", 40)
    monkeypatch.setattr(lexical, "QUERIES", 2)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta eps fn class zeta eta".split()) for _ in range(n))
    rows = [(i, text(rng.randint(1, 12))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:30]] + [(300, None), (301, "")]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id bigint, text string"))
    asked = [(i, text(4)) for i in range(5)] + [(9, "nothing"), (10, None), (11, "alpha alpha beta")]
    found = lexical.batch_search(index, spark.createDataFrame(asked, "item_id bigint, text string"), 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()  # no score of a pair is shuffled
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = {i: [(r["doc_id"], r["score"]) for r in lexical.search_index(index, t, 4).collect()] for i, t in asked if t and Counter(tokens_of(t))}
    assert got == {i: w for i, w in want.items() if w} and len(got) == 6
