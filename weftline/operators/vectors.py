"""Exact vector search: one query, many queries, coarse-to-fine, neighbour graphs, similarity joins.

Joins of all vectors with all vectors multiply blocks of packed rows in NumPy: a block pair is a task's unit
of work, keeps only its best partners, and no pair of rows is ever materialised before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import cosine, euclidean, truncate

BLOCK = 2048
#: Bytes of an Arrow batch that a worker is given, of which a pair of blocks is a row, and similarities that it computes at once.
BATCH_BYTES, AT_ONCE = "4m", 1 << 19


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session does: the usual bound is on rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def nearest(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, similarity, distance): the ``k`` most similar by cosine; a top-k without a shuffle of rows."""
    sim = F.round(cosine(F.col(vec_col), query), 6)
    found = vectors.select(F.col(id_col).alias("id"), sim.alias("similarity"))
    return found.orderBy(F.desc("similarity"), "id").limit(k).select("id", "similarity", F.round(1 - F.col("similarity"), 6).alias("distance"))


def nearest_euclidean(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    found = vectors.select(F.col(id_col).alias("id"), F.round(euclidean(F.col(vec_col), query), 6).alias("distance"))
    return found.orderBy("distance", "id").limit(k)


def coarse_to_fine(vectors: DataFrame, query: Column, k: int = 10, dims: int = 16, over: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The best ``k * over`` on the first ``dims`` dimensions, ranked again on all of them."""
    coarse = vectors.withColumn("coarse", F.round(cosine(truncate(F.col(vec_col), dims), truncate(query, dims)), 6)).orderBy(F.desc("coarse"), id_col).limit(k * over)
    fine = coarse.select(F.col(id_col).alias("id"), "coarse", F.round(cosine(F.col(vec_col), query), 6).alias("similarity"))
    return fine.orderBy(F.desc("similarity"), "id").limit(k)


def modulo_sample(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Sampling search: beyond 1000 vectors, every n-th of them, 100 and a hundredth of their number."""
    total = vectors.agg(F.count("*").alias("total"), F.min(id_col).alias("least"))
    wanted = F.lit(100) + F.floor(F.col("total") / 100)
    step = F.greatest(F.floor(F.col("total") / wanted), F.lit(1))
    numbered = vectors.crossJoin(F.broadcast(total))  # one row
    kept = numbered.filter((F.col("total") <= 1000) | ((F.col(id_col) - F.col("least")) % step == 0))
    return nearest(kept, query, k, id_col, vec_col)


def like(vectors: DataFrame, example, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Query by example: the vectors nearest to the one with this identifier, itself included."""
    query = vectors.filter(F.col(id_col) == example).select(F.col(vec_col).alias("example")).limit(1)
    joined = vectors.crossJoin(F.broadcast(query))  # one row
    return nearest(joined, F.col("example"), k, id_col, vec_col)


def batch_cosine(vectors: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), query), 6).alias("similarity"))


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """(block, ids, rows): packed blocks of about ``block`` vectors, by hash of the identifier."""
    named = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    count = named.count()
    n = max(1, -(-count // block))
    return named.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("rows"))


def _partners(k: int | None, least: float | None, ordered: bool):
    def unit(column: pa.Array, i: int, n: int) -> np.ndarray:
        m = column[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def best(a_ids: np.ndarray, b_ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        barred = a_ids[:, None] >= b_ids[None, :] if ordered else a_ids[:, None] == b_ids[None, :]
        sims[barred] = -np.inf
        if least is not None:
            sims[sims <= least] = -np.inf
        if k is not None and k < sims.shape[1]:
            order = np.lexsort((np.broadcast_to(b_ids, sims.shape), -sims), axis=1)[:, :k]
            row, col = np.repeat(np.arange(len(a_ids)), k), order.ravel()
        else:
            row, col = np.nonzero(np.ones_like(sims, bool))
        value = sims[row, col]
        ok = np.isfinite(value)
        return pa.RecordBatch.from_arrays([pa.array(a_ids[row[ok]]), pa.array(b_ids[col[ok]]), pa.array(value[ok])], ["src", "dst", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a_ids, b_ids = (batch.column(c)[i].values.to_numpy() for c in (0, 2))
                a, b = unit(batch.column(1), i, len(a_ids)), unit(batch.column(3), i, len(b_ids))
                step = max(1, AT_ONCE // max(1, len(b_ids)))
                for lo in range(0, len(a_ids), step):
                    yield best(a_ids[lo : lo + step], b_ids, np.round(a[lo : lo + step] @ b.T, 6))

    return run


def _joined(vectors: DataFrame, k: int | None, least: float | None, ordered: bool, id_col: str, vec_col: str, block: int, queries: DataFrame | None = None) -> DataFrame:
    bound_batches(vectors.sparkSession)
    blocks = _blocks(vectors, id_col, vec_col, block)
    a = (_blocks(queries, id_col, vec_col, block) if queries is not None else blocks).select(F.col("ids").alias("a_ids"), F.col("rows").alias("a_rows"))
    b = blocks.select(F.col("ids").alias("b_ids"), F.col("rows").alias("b_rows"))
    return a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(_partners(k, least, ordered), "src bigint, dst bigint, similarity double")


def _best(pairs: DataFrame, m: int) -> DataFrame:
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")))
    return ranked.filter(F.col("rank") <= m).select("src", "dst", "similarity", "rank")


def neighbour_graph(vectors: DataFrame, m: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity, rank): the ``m`` nearest others of each of ``queries``, rows of ``vectors``; of each vector by default."""
    return _best(_joined(vectors, m, None, False, id_col, vec_col, block, queries), m)


def similar_pairs(vectors: DataFrame, least: float, m: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """Pairs more similar than ``least``: all (src < dst), or the ``m`` best of each of ``queries``, of each vector by default."""
    if m is None:
        return _joined(vectors, None, least, True, id_col, vec_col, block)
    return _best(_joined(vectors, m, least, False, id_col, vec_col, block, queries), m)


def prune(links: DataFrame, m: int) -> DataFrame:
    """Each node's ``m`` most similar links."""
    return _best(links.select("src", "dst", "similarity"), m)


def graph_stats(links: DataFrame) -> DataFrame:
    """One row: nodes, links, links a node."""
    nodes = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).distinct().agg(F.count("*").alias("nodes"))
    both = links.agg(F.count("*").alias("links")).crossJoin(F.broadcast(nodes))
    return both.select("nodes", "links", F.round(F.col("links") / F.greatest("nodes", F.lit(1)), 6).alias("avg_links"))
