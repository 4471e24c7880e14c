"""Graphs as tables of (src, dst, weight): traversal, shortest paths, reachability, impact, statistics.

Loops run over frontiers. Each round writes its state in the shared folder and reads it again, so that the plan
doesn't grow and a lost executor costs a round, not the run. Weights aren't negative.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import drop_path, materialise, parts_of

#: Nodes of a frontier that are broadcast; a larger one is joined by a shuffle, with equal results.
FRONTIER = 50_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges to be followed: out, in, or both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return {"out": edges, "in": back.select(*edges.columns), "both": edges.unionByName(back)}[direction]


def _relax(edges: DataFrame, seeds: DataFrame, cost: Column, bound: float | None, rounds: int | None, kind: str) -> tuple[DataFrame, str]:
    """(node, dist) of all within the bound and the number of rounds; the written table's path."""
    spark = edges.sparkSession
    state, path = materialise(seeds.select("node", F.lit(0).cast(kind).alias("dist"), F.lit(True).alias("fresh")).distinct(), "frontier")
    done, ahead = 0, state.count()
    while rounds is None or done < rounds:
        front = F.broadcast(state.filter("fresh")) if ahead <= FRONTIER else state.filter("fresh")  # bounded
        offers = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("dist") + cost).cast(kind).alias("dist"), F.lit(True).alias("fresh"))
        if bound is not None:
            offers = offers.filter(F.col("dist") <= bound)
        best = state.select("node", "dist", F.lit(False).alias("fresh")).unionByName(offers).groupBy("node").agg(F.min(F.struct("dist", "fresh")).alias("b"))
        after, fresh_path = materialise(best.select("node", F.col("b.dist").alias("dist"), F.col("b.fresh").alias("fresh")), "frontier")
        drop_path(spark, path)
        state, path, done = after, fresh_path, done + 1
        ahead = after.filter("fresh").count()
        if not ahead:
            break
    return state.select("node", "dist"), path


def hops(edges: DataFrame, seeds: DataFrame, most: int, direction: str = "out") -> DataFrame:
    """(node, distance): the fewest edges from any seed, up to ``most``; seeds have 0.

    The edges are written once; a round joins the last level with them, and what is reached already is left out by an anti-join.
    """
    spark = edges.sparkSession
    light, path = materialise(oriented(edges, direction).select("src", "dst").distinct(), "edges")
    level, _ = materialise(seeds.select("node", F.lit(0).alias("distance")).distinct(), "level")
    reached = level
    for depth in range(1, most + 1):
        ahead = light.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        level, level_path = materialise(ahead.select("node", F.lit(depth).alias("distance")), "level")
        if level.isEmpty():
            drop_path(spark, level_path)
            break
        reached = reached.unionByName(level)
    drop_path(spark, path)
    return reached


def shortest_paths(edges: DataFrame, seeds: DataFrame, bound: float, direction: str = "out") -> DataFrame:
    """(node, dist, pred): least weight from any seed, ``bound`` included; of equal predecessors the least.

    Nodes out of reach have no row.
    """
    light = oriented(edges, direction).groupBy("src", "dst").agg(F.min("weight").alias("weight")).filter(F.col("weight") <= bound)
    light, _ = materialise(light, "edges")
    found, _ = _relax(light, seeds, F.col("weight"), bound, None, "double")
    a, b = found.select(F.col("node").alias("src"), F.col("dist").alias("d0")), found.select(F.col("node").alias("dst"), F.col("dist").alias("d1"))
    preds = light.join(a, "src").join(b, "dst").filter((F.abs(F.col("d0") + F.col("weight") - F.col("d1")) < 1e-9) & (F.col("weight") > 0)).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
    return found.join(preds, "node", "left").select("node", F.round("dist", 6).alias("dist"), F.when(F.col("dist") > 0, F.col("pred")).alias("pred"))


def path_to(paths: DataFrame, targets: DataFrame, many: bool = False) -> DataFrame:
    """(target, dist, path): the nodes from the source to each reached target, by predecessors.

    With ``many`` targets the pieces of all nodes' paths are joined, twice as long with each round; else each path is walked.
    """
    table, _ = materialise(paths, "paths")
    wanted = targets.select(F.col("node").alias("node")).distinct()
    if many:
        return _doubled(table).join(wanted.withColumnRenamed("node", "target"), "target", "left_semi")
    walk, path = materialise(table.join(wanted, "node", "left_semi").select(F.col("node").alias("target"), "dist", F.array("node").alias("path"), F.col("pred").alias("head")), "walk")
    step = table.select(F.col("node").alias("head"), F.col("pred").alias("next"))
    while not walk.filter("head IS NOT NULL").isEmpty():
        joined = walk.join(step, "head", "left").select("target", "dist", F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat(F.array("head"), F.col("path"))).alias("path"), F.col("next").alias("head"))
        after, fresh_path = materialise(joined, "walk")
        drop_path(table.sparkSession, path)
        walk, path = after, fresh_path
    return walk.select("target", "dist", "path")


def _doubled(table: DataFrame) -> DataFrame:
    """(target, dist, path) of all nodes of (node, dist, pred)."""
    pieces, path = materialise(table.select(F.col("node").alias("target"), "dist", F.array("node").alias("path"), F.col("pred").alias("head")), "walk")
    while not pieces.filter("head IS NOT NULL").isEmpty():
        before = pieces.select(F.col("target").alias("head"), F.col("path").alias("start"), F.col("head").alias("next"))
        joined = pieces.join(before, "head", "left").select("target", "dist", F.when(F.col("start").isNull(), F.col("path")).otherwise(F.concat("start", "path")).alias("path"), F.col("next").alias("head"))
        after, fresh_path = materialise(joined, "walk")
        drop_path(table.sparkSession, path)
        pieces, path = after, fresh_path
    return pieces.select("target", "dist", "path")


def shortest_path(edges: DataFrame, source, target, bound: float = math.inf) -> DataFrame:
    """(target, dist, path) between two nodes: no row if there is none; 0 and the node itself if they are the same."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(source,)], f"node {dict(edges.dtypes)['src']}")
    goal = spark.createDataFrame([(target,)], f"node {dict(edges.dtypes)['src']}")
    return path_to(shortest_paths(edges, seed, bound), goal)


def multi_target(edges: DataFrame, source, targets: DataFrame, bound: float = math.inf) -> DataFrame:
    """Shortest paths from one node to many: one search for all."""
    seed = edges.sparkSession.createDataFrame([(source,)], f"node {dict(edges.dtypes)['src']}")
    return path_to(shortest_paths(edges, seed, bound), targets, many=True)


def reachable(edges: DataFrame, seeds: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(node, distance) of the targets within ``most`` hops of a seed."""
    return hops(edges, seeds, most).join(targets.select("node").distinct(), "node", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def dependencies(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """The edges among the nodes within ``depth`` hops of the roots."""
    return induced(edges, hops(edges, roots, depth, direction))


def impact(edges: DataFrame, changed: DataFrame, radius: int) -> DataFrame:
    """(node, direction, distance): what changed nodes reach, and what reaches them."""
    out = hops(edges, changed, radius).withColumn("direction", F.lit("forward"))
    return out.unionByName(hops(edges, changed, radius, "in").withColumn("direction", F.lit("backward"))).filter("distance > 0").select("node", "direction", "distance")


def impact_summary(edges: DataFrame, changed: DataFrame, radius: int) -> DataFrame:
    """One row: nodes reached each way, nodes at the radius, share of all nodes."""
    found, _ = materialise(impact(edges, changed, radius), "impact")
    total = nodes_of(edges).agg(F.count("*").alias("n"))
    counted = found.agg(F.count_if(F.col("direction") == "forward").alias("forward"), F.count_if(F.col("direction") == "backward").alias("backward"), F.count_if(F.col("distance") >= radius).alias("critical"), F.count_distinct("node").alias("reached"))
    return counted.crossJoin(F.broadcast(total)).select("forward", "backward", "critical", F.round(F.col("reached") / F.greatest("n", F.lit(1)), 6).alias("complexity"))


def subtree_size(edges: DataFrame, root, most_hops: int, cap: int = 100) -> DataFrame:
    """One row: nodes within reach of a root, at most ``cap``."""
    seed = edges.sparkSession.createDataFrame([(root,)], f"node {dict(edges.dtypes)['src']}")
    return hops(edges, seed, most_hops).agg(F.least(F.count("*"), F.lit(cap)).alias("size"))


def pivots(edges: DataFrame, least_share: float = 0.1) -> DataFrame:
    """Nodes whose out-degree is at least a share of all nodes; all nodes if there is none."""
    nodes = nodes_of(edges)
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    table = nodes.join(degree, "node", "left").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    marked = table.select("node", (F.coalesce("degree", F.lit(0)) / F.col("n") >= least_share).alias("pivot"))
    some = marked.agg(F.max("pivot").alias("some"))
    return marked.crossJoin(F.broadcast(some)).filter("pivot OR NOT some").select("node")


def nearest_frontier(states: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` nearest nodes of a frontier, each once."""
    return states.groupBy("node").agg(F.min("dist").alias("dist")).orderBy("dist", "node").limit(n)


def with_property(nodes: DataFrame, key: str, value: Column, at: Column) -> DataFrame:
    """``nodes`` with a property set in their map and the moment noted."""
    return nodes.withColumn("properties", F.map_concat(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k != key), F.create_map(F.lit(key), value))).withColumn("last_modified", at)


def frontier_parameters(n: Column) -> tuple[Column, Column]:
    """(k, t) of frontier reduction for n nodes, 1 at least."""
    each = lambda power: F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.round(F.log2(n.cast("double")) * power, 9)).cast("int")))
    return each(1 / 3), each(2 / 3)


def recursion_depth(n: Column, t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.log2(n.cast("double")) / t).cast("int"))


def prefers_frontier(n: Column, m: Column) -> Column:
    """Whether frontier reduction is expected to beat Dijkstra's algorithm."""
    log_n = F.log2(n.cast("double"))
    return F.when(n <= 1, False).otherwise(m * F.pow(log_n, F.lit(2 / 3)) < m + n * log_n)


def level_of(n: Column, most: int = 3) -> Column:
    return F.when(n < 100, 1).when(n < 1000, 2).when(n < 10000, 3).otherwise(F.greatest(F.lit(1), F.least(F.floor(F.log(n.cast("double")) * 2 / 3).cast("int"), F.lit(most))))


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, edges a node, degree both ways, k and t, and which algorithm suits."""
    base = edges.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(nodes_of(edges).agg(F.count("*").alias("nodes"))))
    k, t = frontier_parameters(F.col("nodes"))
    each = F.greatest("nodes", F.lit(1))
    told = base.select("nodes", "edges", F.round(F.col("edges") / each, 6).alias("avg_degree"), F.round(2 * F.col("edges") / each, 6).alias("avg_both"), k.alias("k"), t.alias("t"), prefers_frontier(F.col("nodes"), F.col("edges")).alias("prefers_frontier"), level_of(F.col("nodes")).alias("level"))
    return told.withColumn("depth", recursion_depth(F.greatest("nodes", F.lit(2)), F.col("t")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, neighbours, centrality): distinct neighbours either way, and their share of the other nodes."""
    edges, _ = materialise(edges.select("src", "dst"), "edges")
    both = oriented(edges, "both").filter("src <> dst").repartition(parts_of(2 * edges.count()), "src", "dst").distinct()
    count = nodes_of(edges).agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"))
    return degree.crossJoin(F.broadcast(count)).select("node", "neighbours", F.round(F.col("neighbours") / F.col("others"), 6).alias("centrality"))


def synthetic(spark, nodes: int, degree: int = 4, topology: str = "random", seed: int = 7) -> DataFrame:
    """A generated graph: random, scale_free or dependency (edges to lesser nodes); the same for the same seed."""
    ids = spark.range(nodes * degree).select((F.col("id") % nodes).alias("src"), F.col("id"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    target = {"random": F.floor(draw * nodes), "scale_free": F.floor(draw * draw * draw * nodes), "dependency": F.floor(draw * F.greatest(F.col("src"), F.lit(1)))}[topology]
    weight = 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10))
    return ids.select("src", target.cast("bigint").alias("dst"), weight.cast("double").alias("weight")).filter("src <> dst").dropDuplicates(["src", "dst"])
