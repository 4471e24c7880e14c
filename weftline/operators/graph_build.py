"""Graphs of several densities from entities and relationships.

Nodes are entities and keep their identifiers. Co-occurrence is within a turn of a conversation, similarity of names
among all entities.

Edges between any two entities are looked for block by block: entities are split by hash of their identifier, and each two
blocks are a task's unit of work, which gets the edges that join them already. So no pair of entities is ever shuffled.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY_WORDS = ("implement", "algorithm", "architecture")
CORE = {"imports": "dependency", "creates": "creates", "contains": "contains"}
SEMANTIC = {"similar_purpose": "similar", "modifies": "modifies", "temporal_next": "temporal"}
DENSE = {"decides": "decision_leads_to", "creates": "task_implements", "calls": "calls"}
MEDIUM_TYPES, DENSE_TYPES = ("task", "function"), ("test_file", "error_event", "fix")


def is_primary(content: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(content.contains(w), F.lit(False)) for w in PRIMARY_WORDS])


def _kept(density: str) -> Column:
    keep = (F.col("entity_type") == "file") | ((F.col("entity_type") == "decision") & is_primary(F.col("content")))
    if density in ("medium", "dense"):
        keep = keep | F.col("entity_type").isin(*MEDIUM_TYPES)
    if density == "dense":
        keep = keep | F.col("entity_type").isin(*DENSE_TYPES)
    return keep


def nodes(found: DataFrame, density: str = "sparse") -> DataFrame:
    """(entity_id, node_type, name, ...): files and primary decisions; also tasks and functions; also tests, errors and fixes."""
    return found.filter(_kept(density)).withColumn("node_type", F.col("entity_type"))


def _mapped(links: DataFrame, table: dict[str, str], weight: Column, default: str | None = None) -> DataFrame:
    """Relationships as edges; those outside the table get the default, or go."""
    kind = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("relationship_type")]
    edges = links.withColumn("edge_type", F.coalesce(kind, F.lit(default)) if default else kind).filter("edge_type IS NOT NULL")
    return edges.select("from_id", "to_id", "edge_type", F.round(weight, 6).alias("weight"))


def core_edges(links: DataFrame) -> DataFrame:
    return _mapped(links, CORE, F.lit(1.0))


def semantic_edges(links: DataFrame) -> DataFrame:
    return _mapped(links, SEMANTIC, F.col("strength"))


def dense_edges(links: DataFrame, present: DataFrame) -> DataFrame:
    """What no edge joins yet, at 0.7 of its strength."""
    return _mapped(links.join(present.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti"), DENSE, F.col("strength") * 0.7, "similar")


def cooccurrence(found: DataFrame, present: DataFrame | None = None, strength: float = 0.6) -> DataFrame:
    """Pairs of entities of one turn, from the lesser identifier, unless an edge joins them already."""
    a = found.select("conversation_id", "turn", F.col("entity_id").alias("from_id"))
    b = a.withColumnRenamed("from_id", "to_id")
    pairs = a.join(b, ["conversation_id", "turn"]).filter("from_id < to_id").select("from_id", "to_id").distinct()
    if present is not None:
        pairs = pairs.join(present.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return pairs.select("from_id", "to_id", F.lit("similar").alias("edge_type"), F.lit(strength).alias("weight"))


def name_similarity(a: Column, b: Column) -> Column:
    """Twice the common prefix and suffix by the sum of lengths: over 1 where these overlap; 1 for equal names."""
    least = F.least(F.length(a), F.length(b))

    def common(x: Column, y: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), least), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))
        return F.size(F.filter(same, lambda s: s))

    score = 2.0 * (common(a, b) + common(F.reverse(a), F.reverse(b))) / (F.length(a) + F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(score)


def _rounded(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """2k / n to six decimals, halves away from zero as Spark's round has it; 0 where n is."""
    width = int(n.max(initial=0)) + 1
    code = k.astype(np.int64) * width + n
    seen, where = np.unique(code, return_inverse=True) if len(code) * width > 1 << 22 else (None, None)
    if seen is None:
        mark = np.zeros(int(code.max(initial=0)) + 1, bool)
        mark[code.ravel()] = True
        seen = np.flatnonzero(mark)
    values = np.array([float(Decimal(repr(2.0 * (c // width) / (c % width))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if c % width else 0.0 for c in seen.tolist()], float)
    if where is not None:
        return values[where.reshape(code.shape)]
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1)
    table[seen] = values
    return table[code]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters each row of ``a`` shares with each of ``b`` before they differ."""
    alive, count = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        alive &= a[:, i][:, None] == b[:, i][None, :]
        if not alive.any():
            break
        count += alive
    return count


def _scores(a: list[str], b: list[str]) -> np.ndarray:
    """``name_similarity`` of each of ``a`` with each of ``b``, rounded to six decimals; names aren't empty."""

    def points(names: list[str], width: int) -> np.ndarray:
        return np.frombuffer("".join(x.ljust(width, "\0") for x in names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), width)

    la, lb = (np.array([len(x) for x in names], np.int32) for names in (a, b))
    width, least = max(la.max(initial=0), lb.max(initial=0)), np.minimum(la[:, None], lb[None, :])
    ahead, behind = (np.minimum(_common(points(x, width), points(y, width)), least) for x, y in ((a, b), ([n[::-1] for n in a], [n[::-1] for n in b])))
    return np.where((ahead == least) & (la[:, None] == lb[None, :]), 1.0, _rounded(ahead + behind, la[:, None] + lb[None, :]))


#: Entities in a block; what their edges are called by.
BLOCK, CO, NAME, EVOLVED, HOURLY = 1024, 0, 1, 2, 3


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where all columns are; -1 where one is null."""
    code = 0
    for column in columns:
        told = column.combine_chunks().dictionary_encode()
        own = told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where((own < 0) | (np.asarray(code) < 0), -1, code * (len(told.dictionary) + 1) + own)
    return code


def _paired(strength: float, least: float, ahead: int, wanted: frozenset[int]):
    """A unit's entities and the edges among them to (from_id, to_id, what, weight): those of two blocks, or within one."""

    def run(rows: pa.Table, present: pa.Table) -> pa.Table:
        ids = rows["id"].combine_chunks()
        side = rows["side"].to_numpy()
        x, y = (np.flatnonzero(side <= 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(side)),) * 2
        values, uid = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        once = len(values) == len(uid)
        joined = np.zeros((len(values), len(values)), bool)
        if present.num_rows and len(values):
            ends = [present[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("from_id", "to_id")]
            at = [np.minimum(np.searchsorted(values, e), len(values) - 1) for e in ends]
            known = (values[at[0]] == ends[0]) & (values[at[1]] == ends[1])
            joined[at[0][known], at[1][known]] = True
        kept = rows["kept"].to_numpy(zero_copy_only=False).astype(bool)
        out = []

        def told(i, j, hit, what, weight):
            a, b = np.nonzero(hit)
            if what == CO and not once:
                _, first = np.unique(uid[i[a]] * len(values) + uid[j[b]], return_index=True)
                a, b = a[first], b[first]
            w = weight if isinstance(weight, float) else weight[a, b]
            out.append(pa.table({"from_id": ids.take(pa.array(i[a])), "to_id": ids.take(pa.array(j[b])), "what": pa.array(np.full(len(a), what, np.int8)), "weight": pa.array(np.broadcast_to(np.float64(w), len(a)) if isinstance(w, float) else w)}))

        def spread(i, j, hit):
            """An edge joins identifiers, whichever of their rows it was found in."""
            if once:
                return hit
            marks, (a, b) = np.zeros_like(joined), np.nonzero(hit)
            marks[uid[i[a]], uid[j[b]]] = True
            return marks[uid[i]][:, uid[j]]

        if NAME in wanted and len(x) and len(y):
            names = rows["name"].to_pylist()
            named = kept & np.array([bool(n) for n in names], bool)
            score = np.zeros((len(x), len(y)))
            nx, ny = np.flatnonzero(named[x]), np.flatnonzero(named[y])
            score[np.ix_(nx, ny)] = _scores([names[k] for k in x[nx]], [names[k] for k in y[ny]])
            named_pair = named[x][:, None] & named[y][None, :]
        if CO in wanted:
            turn = _codes(rows["conversation_id"], rows["turn"])
        if EVOLVED in wanted:
            group, ts = np.where(kept, _codes(rows["block"], rows["entity_type"]), -1), rows["ts"].to_numpy()
        if HOURLY in wanted:
            hour, rank = np.where(kept, _codes(rows["hour"]), -1), rows["k"].combine_chunks().fill_null(0).to_numpy()
        for i, j, turned in ((x, y, False), (y, x, True))[: 1 if x is y else 2]:
            if not len(i) or not len(j):
                continue
            taken = joined[uid[i]][:, uid[j]]
            less = uid[i][:, None] < uid[j][None, :]
            found = taken
            if CO in wanted:
                hit = (turn[i][:, None] == turn[j][None, :]) & (turn[i] >= 0)[:, None] & less
                told(i, j, hit & ~taken, CO, strength)
                found = taken = taken | spread(i, j, hit)
            if NAME in wanted:
                s, both = (score.T, named_pair.T) if turned else (score, named_pair)
                hit = both & (s > least) & less & ~taken
                told(i, j, hit, NAME, s)
                found = found | spread(i, j, hit)
            if EVOLVED in wanted:
                with np.errstate(invalid="ignore"):
                    hit = (group[i][:, None] == group[j][None, :]) & (group[i] >= 0)[:, None] & (ts[i][:, None] < ts[j][None, :]) & ~taken
                a, b = np.nonzero(hit)
                weight = np.zeros(hit.shape)
                weight[a, b] = 1.0 / np.maximum(1.0, (ts[j[b]] - ts[i[a]]) / 3600.0)
                told(i, j, hit, EVOLVED, weight)
                found = found | spread(i, j, hit)
            if HOURLY in wanted:
                after = rank[j][None, :] - rank[i][:, None]
                told(i, j, (hour[i][:, None] == hour[j][None, :]) & (hour[i] >= 0)[:, None] & (after >= 1) & (after <= ahead) & ~found, HOURLY, 0.5)
        empty = pa.table({"from_id": ids[:0], "to_id": ids[:0], "what": pa.array([], pa.int8()), "weight": pa.array([], pa.float64())})
        return pa.concat_tables(out) if out else empty

    return run


def _pairs(rows: DataFrame, present: DataFrame | None, wanted: set[int], strength: float = 0.6, least: float = 0.6, ahead: int = 5) -> DataFrame:
    """(from_id, to_id, what, weight) between any two of ``rows`` (id, kept, and what the wanted kinds of edges look at)."""
    n = max(1, -(-rows.count() // BLOCK))
    parts = min(n * (n + 1) // 2, 4096)
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    unit = lambda a, b: F.least(a, b) * n + F.greatest(a, b)
    with_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("with")
    units = rows.withColumn("own", own("id")).select("*", with_).withColumn("unit", unit(F.col("own"), F.col("with"))).withColumn("side", F.signum(F.col("own") - F.col("with")).cast("int")).drop("own", "with")
    kind = dict(rows.dtypes)["id"]
    there = present.select("from_id", "to_id") if present is not None else rows.sparkSession.createDataFrame([], f"from_id {kind}, to_id {kind}")
    there = there.withColumn("unit", unit(own("from_id"), own("to_id")))
    each = (df.repartition(parts, "unit").groupBy("unit") for df in (units, there))  # as many tasks as that takes, however few bytes they read
    left, right = each
    return left.cogroup(right).applyInArrow(_paired(strength, least, ahead, frozenset(wanted)), f"from_id {kind}, to_id {kind}, what tinyint, weight double")


def similar_names(found: DataFrame, least: float = 0.6, block: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """Pairs of entities whose names are similar, from the lesser identifier, unless an edge joins them already.

    Their pairs are as many as their definition makes them. With ``block``, a column such as the project, only pairs within
    a block are looked at.
    """
    if block:
        return _similar_within(found, least, block, present)
    rows = found.filter("name <> ''").select(F.col("entity_id").alias("id"), F.lit(True).alias("kept"), "name")
    return _pairs(rows, present, {NAME}, least=least).select("from_id", "to_id", F.lit("similar").alias("edge_type"), "weight")


def _similar_within(found: DataFrame, least: float, block: str, present: DataFrame | None) -> DataFrame:
    """Similar names share their first or their last character, by which they are joined."""
    ends = F.array(F.concat(F.lit("^"), F.substring("name", 1, 1)), F.concat(F.lit("$"), F.substring(F.reverse("name"), 1, 1)))
    named = found.filter("name <> ''").select(block, "entity_id", "name", F.explode(ends).alias("end"))
    keys = [block, "end"]
    a = named.select(*keys, F.col("entity_id").alias("from_id"), F.col("name").alias("name_a"))
    b = named.select(*keys, F.col("entity_id").alias("to_id"), F.col("name").alias("name_b"))
    both = a.join(b, keys).filter("from_id < to_id")
    once = both.filter(F.col("end").startswith("^") | (F.substring("name_a", 1, 1) != F.substring("name_b", 1, 1)))
    scored = once.withColumn("weight", F.round(name_similarity(F.col("name_a"), F.col("name_b")), 6)).filter(F.col("weight") > least)
    if present is not None:
        scored = scored.join(present.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return scored.select("from_id", "to_id", F.lit("similar").alias("edge_type"), "weight")


def temporal_weight(seconds: Column) -> Column:
    """One by the hours between, an hour at least."""
    return 1.0 / F.greatest(F.lit(1.0), seconds / 3600.0)


def evolution_edges(found: DataFrame, block: str = "project", present: DataFrame | None = None) -> DataFrame:
    """From each entity to every later one of its type in its block that no edge joins to it yet, weighing less the longer it takes."""
    a = found.select(block, "entity_type", F.col("entity_id").alias("from_id"), F.col("ts").alias("t0"))
    b = found.select(block, "entity_type", F.col("entity_id").alias("to_id"), F.col("ts").alias("t1"))
    pairs = a.join(b, [block, "entity_type"]).filter("t0 < t1")
    if present is not None:
        pairs = pairs.join(present.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return pairs.select("from_id", "to_id", F.lit("temporal").alias("edge_type"), F.round(temporal_weight(F.col("t1") - F.col("t0")), 6).alias("weight"))


def hourly_links(rows: DataFrame, id_col: str = "entity_id", seconds: str = "ts", ahead: int = 5, strength: float = 0.5) -> DataFrame:
    """From each member of an hour to the next ``ahead`` of it: ranks are unrolled into an equi-join."""
    hour = F.floor(F.col(seconds) / 3600)
    k = F.row_number().over(Window.partitionBy("hour").orderBy(seconds, id_col))
    ranked = rows.select(F.col(id_col), F.col(seconds), hour.alias("hour")).withColumn("k", k)
    a = ranked.select("hour", F.col(id_col).alias("from_id"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + ahead)).alias("k"))
    b = ranked.select("hour", "k", F.col(id_col).alias("to_id"))
    return a.join(b, ["hour", "k"]).select("from_id", "to_id", F.lit("temporal").alias("edge_type"), F.lit(strength).alias("weight"))


def _numbered(node_ids: DataFrame, buckets: int = 64) -> DataFrame:
    """(id, k): nodes numbered from 0, in buckets and on top of the sizes of the buckets before."""
    ids = node_ids.select(F.col("entity_id").alias("id"), F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).alias("bucket"))
    sizes = ids.groupBy("bucket").count()
    before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))  # a row a bucket
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    return ids.withColumn("own", own).join(before, "bucket").select("id", (F.col("own") + F.col("before")).alias("k"))


def densify(node_ids: DataFrame, edges: DataFrame, wanted: int, seed: int = 7) -> DataFrame:
    """``wanted`` new edges, drawn by hash, between nodes that no edge joins yet; the same for the same seed."""
    n = node_ids.count()
    if n < 2 or wanted <= 0:
        return edges.select("from_id", "to_id").limit(0)
    numbered = _numbered(node_ids)
    # a pair that is drawn twice or joined already is lost, so draw more than wanted and keep the first
    draws = node_ids.sparkSession.range(wanted * 3 + 16).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)).alias("j")).filter("i <> j")
    a, b = numbered.select(F.col("k").alias("i"), F.col("id").alias("from_id")), numbered.select(F.col("k").alias("j"), F.col("id").alias("to_id"))
    pairs = draws.join(a, "i").join(b, "j").groupBy("from_id", "to_id").agg(F.min("draw").alias("draw"))
    return pairs.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").orderBy("draw").limit(wanted).select("from_id", "to_id")


def _unjoined(links: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """``dense_edges`` of links whose types make no other edge, between entities that neither an edge joins nor a turn."""
    other = links.filter(~F.coalesce(F.col("relationship_type").isin(*CORE, *SEMANTIC), F.lit(False)))
    a = found.select("conversation_id", "turn", F.col("entity_id").alias("from_id"))
    b = a.withColumnRenamed("from_id", "to_id")
    together = other.select("from_id", "to_id").distinct().join(a, "from_id").join(b, ["to_id", "conversation_id", "turn"]).filter("from_id < to_id")
    return dense_edges(other.join(together.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti"), edges)


def _all_dense(found: DataFrame, links: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, weight, density) of the dense graph, with the least dense graph that has the edge."""
    tag = lambda df, d: df.withColumn("density", F.lit(d))
    core, semantic = core_edges(links), semantic_edges(links)
    rest = _unjoined(links, core.unionByName(semantic), found)
    linked = tag(core, "sparse").unionByName(tag(semantic, "medium")).unionByName(tag(rest, "dense"))
    rows = found.withColumn("kept", F.coalesce(_kept("dense"), F.lit(False)))
    hour = F.when(F.col("kept"), F.floor(F.col("ts") / 3600))
    ranked = rows.withColumn("hour", hour).withColumn("k", F.row_number().over(Window.partitionBy("hour").orderBy("ts", "entity_id")))
    wide = ranked.select(F.col("entity_id").alias("id"), "kept", "name", "conversation_id", "turn", F.col("project").alias("block"), "entity_type", F.col("ts").cast("double").alias("ts"), "hour", "k")
    pairs = _pairs(wide, linked, {CO, NAME, EVOLVED, HOURLY})
    what = F.col("what")
    return linked.unionByName(pairs.select("from_id", "to_id", F.when(what <= NAME, "similar").otherwise("temporal").alias("edge_type"), F.when(what == EVOLVED, F.round("weight", 6)).otherwise(F.col("weight")).alias("weight"), F.when(what == CO, "medium").otherwise("dense").alias("density")))


def build(found: DataFrame, links: DataFrame, density: str = "sparse") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph: sparse, medium or dense."""
    if density == "dense" and {"project", "ts"} <= set(found.columns):
        return nodes(found, density), _all_dense(found, links).drop("density")
    edges = core_edges(links)
    if density in ("medium", "dense"):
        edges = edges.unionByName(semantic_edges(links))
        edges = edges.unionByName(cooccurrence(found, edges))
    if density == "dense":
        edges = edges.unionByName(dense_edges(links, edges))
    return nodes(found, density), edges


def build_set(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all three, tagged with their graph's name."""
    names = ("sparse", "medium", "dense")
    tag = lambda df, d: df.withColumn("graph_name", F.lit(d))
    all_nodes = reduce(DataFrame.unionByName, [tag(nodes(found, d), d) for d in names])
    if {"project", "ts"} <= set(found.columns):  # each graph has the edges of those less dense
        has = F.when(F.col("density") == "sparse", F.array(*map(F.lit, names))).when(F.col("density") == "medium", F.array(*map(F.lit, names[1:]))).otherwise(F.array(F.lit("dense")))
        return all_nodes, _all_dense(found, links).select("from_id", "to_id", "edge_type", "weight", F.explode(has).alias("graph_name"))
    return all_nodes, reduce(DataFrame.unionByName, [tag(build(found, links, d)[1], d) for d in names])


def stats(node_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, edges a node, and which algorithm suits such a density."""
    base = node_rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("m"))))
    average = F.col("m") / F.greatest("n", F.lit(1))
    return base.select("n", "m", F.round(average, 6).alias("avg_degree"), F.round(average / F.greatest("n", F.lit(1)), 6).alias("density_ratio"))
