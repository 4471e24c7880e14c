"""Approximate vector search: an inverted file of cells.

Centres are fitted by k-means on a bounded sample (``SAMPLE`` vectors, those with the least hash of their identifier); every
vector is in the index, under its nearest centre by cosine. A query looks at the ``probes`` cells nearest to it and ranks what is
there exactly: what it may miss is in other cells. Cells are stored as packed blocks of rows, so that a large cell is
many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import new_path

from .vectors import _best, _partners, bound_batches

SAMPLE, ROUNDS, BLOCK, MOST_CELLS = 20_000, 8, 2048, 4096


@dataclass(frozen=True)
class Cells:
    """Unit centres, and the table (cell, ids, rows) of packed blocks."""

    centres: np.ndarray
    blocks: DataFrame


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the sample's own first rows; a centre without members stays where it was."""
    x, centres = _unit(sample), _unit(sample)[:cells].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def _celled(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            cells = np.argsort(-(_unit(rows) @ centres.T), axis=1, kind="stable")[:, :probes]
            who = np.repeat(np.arange(batch.num_rows), cells.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who))], ["cell", "id", "v"])

    return run


def _named(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))


def _packed(celled: DataFrame, parts: int) -> DataFrame:
    salt = F.pmod(F.xxhash64("id"), F.lit(parts))
    return celled.groupBy("cell", salt.alias("part")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("rows"))


def build(vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None) -> Cells:
    """Index every vector; about sqrt(n) cells unless given."""
    named = _named(vectors, id_col, vec_col)
    n = named.count()
    drawn = named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = drawn.flatten().to_numpy().astype(np.float64).reshape(len(drawn), -1) if len(drawn) else np.zeros((1, 1))
    centres = _centres(sample, max(1, min(cells or int(n**0.5), len(sample), MOST_CELLS)))
    path = path or new_path(vectors.sparkSession, "cells")
    # the largest cell may hold all rows: as many parts as that takes, of which small cells fill few
    parts = max(1, -(-n // BLOCK))
    _packed(named.mapInArrow(_celled(centres, 1), "cell int, id bigint, v array<float>"), parts if n > BLOCK * len(centres) else 1).write.mode("overwrite").parquet(path)
    return Cells(centres, vectors.sparkSession.read.parquet(path))


def search(index: Cells, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(src, dst, similarity, rank): the ``k`` best others of each query among its ``probes`` nearest cells.

    By default three quarters of the cells: what vectors without any clusters take for a recall of 0.9. Clustered ones take few.
    """
    probes = probes or max(1, -(-3 * len(index.centres) // 4))
    bound_batches(queries.sparkSession)
    asked = _packed(_named(queries, id_col, vec_col).mapInArrow(_celled(index.centres, probes), "cell int, id bigint, v array<float>"), 8)
    a = asked.select("cell", F.col("ids").alias("a_ids"), F.col("rows").alias("a_rows"))
    b = index.blocks.select("cell", F.col("ids").alias("b_ids"), F.col("rows").alias("b_rows"))
    return _best(a.join(b, "cell").drop("cell").mapInArrow(_partners(k, None, False), "src bigint, dst bigint, similarity double"), k)
