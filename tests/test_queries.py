"""Every registered query of the library proper against its SQL, or against a plain version of it."""

import heapq
import math

import oracle
import pytest
from oracle import MIDDLE, SMALL

from weftline.plans import records, registry, retrieval, surfaces  # noqa: F401
from weftline.operators import ann, vectors
from weftline.operators.collaboration import apply_edit
from weftline.streaming.stateful import anchored_window, gap_limit

SLOW = {"bm25_batch", "bm25_postings", "op_conflicts", "conflict_events", "unresolved_conflicts", "document_context", "graph_medium", "evolution_edges"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    got, want = oracle.compare(spark, registry.QUERIES[name], registry.SQL[name], SMALL if name in SLOW else MIDDLE)
    assert got == want


def test_applied_documents(spark):
    """The query against a fold that looks for conflicts one edit after another."""
    edits = sorted(records._edits(spark, SMALL).collect(), key=lambda r: r["op_id"])
    want, seen = {}, {}
    for r in edits:
        rivals = [o for o in seen.setdefault(r["document"], []) if _conflict(o, r)]
        seen[r["document"]].append(r)
        text, n = want.get(r["document"], ("", 0))
        if max([r, *rivals], key=lambda o: (o["ts"], o["op_id"])) is r:
            want[r["document"]] = (apply_edit(text, r["kind"], r["offset"], r["content"]), n + 1)
    got = {r["document"]: (r["content"], r["operations"]) for r in registry.QUERIES["crdt_fold"](spark, SMALL).collect()}
    assert got == want


def _conflict(a, b):
    less, more = (any(x[k] < y[k] for k in a["clock"]) for x, y in ((a["clock"], b["clock"]), (b["clock"], a["clock"])))
    reach = lambda x, y: x["offset"] <= y["offset"] if x["kind"] == "insert" else x["offset"] <= y["offset"] < x["offset"] + len(x["content"])
    return less == more and (reach(a, b) or reach(b, a))


@pytest.mark.parametrize(("name", "step"), [("rate_limit_anchored", anchored_window(3, 3_600_000)), ("connection_blocks", gap_limit(5, 3_600_000, 14_400_000))])
def test_stateful_decisions(spark, name, step):
    rows = registry.QUERIES[name](spark, MIDDLE).collect()
    state = {}
    for r in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
        state[r["key"]], ok = step(state.get(r["key"]), r["at_ms"])
        assert ok == r["allowed"]
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/events.parquet").count()
    assert len({r["allowed"] for r in rows}) == 2


def test_generated_edges(spark):
    g = registry.QUERIES["synthetic_graph"](spark, SMALL)
    assert g.count() > 2000 and g.filter("src = dst").isEmpty() and sorted(map(tuple, g.collect())) == sorted(map(tuple, g.collect()))
    e = registry.QUERIES["synthetic_dense_edges"](spark, MIDDLE)
    assert e.filter("from_id = to_id").isEmpty() and e.distinct().count() == e.count() > 0


def dijkstra(rows, source):
    links, best, heap = {}, {source: 0.0}, [(0.0, source)]
    for r in rows:
        links.setdefault(r["src"], []).append((r["dst"], float(r["weight"])))
    while heap:
        dist, node = heapq.heappop(heap)
        if dist == best[node]:
            for other, weight in links.get(node, ()):
                if dist + weight < best.get(other, math.inf):
                    best[other] = dist + weight
                    heapq.heappush(heap, (dist + weight, other))
    return links, best


@pytest.mark.parametrize(("name", "targets"), [("shortest_path", {15}), ("multi_target", None)])
def test_unbounded_paths_are_dijkstras(spark, name, targets):
    links, best = dijkstra(retrieval._edges(spark, MIDDLE).collect(), retrieval.SEED)
    want = {n: d for n, d in best.items() if targets is None or n in targets}
    assert max(want.values()) > retrieval.BOUND
    rows = registry.QUERIES[name](spark, MIDDLE).collect()
    assert len(rows) == len(want) and {r["target"]: r["dist"] for r in rows} == want
    for r in rows:
        path = [int(n) for n in r["path"].split(">")]
        assert path[0] == retrieval.SEED and path[-1] == r["target"]
        assert sum(min(w for n, w in links[a] if n == b) for a, b in zip(path, path[1:])) == r["dist"]


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score", "matching_terms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf", [MIDDLE, "/root/testdata/sf0.1"])
def test_recall_of_the_approximate_index(spark, sf):
    """Every vector is in it, and nine in ten of the true neighbours are found."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert ann.build(rows).blocks.selectExpr("explode(ids) AS id").distinct().count() == rows.count()
    true = {(r["src"], r["dst"]) for r in vectors.neighbour_graph(rows, 10, queries=rows.filter("vec_id % 50 = 0")).collect()}
    found = {(r["src"], r["dst"]) for r in registry.QUERIES["ann_neighbours"](spark, sf).collect()}
    assert len(found & true) >= 0.9 * len(true) > 50
    assert ann.search(ann.build(rows.limit(0)), rows.limit(0)).count() == 0
