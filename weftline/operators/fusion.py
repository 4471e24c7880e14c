"""Fusion of lexical, vector and graph scores into one ranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESETS = {"exact": (0.7, 0.2, 0.1), "semantic": (0.2, 0.7, 0.1), "related": (0.1, 0.2, 0.7), "balanced": (0.4, 0.4, 0.2)}
LEAST_WEIGHT, PREFERRED_WEIGHT = 0.05, 0.1


@dataclass(frozen=True)
class Weights:
    """Shares of the lexical, the vector and the graph score; they add up to 1, within a hundredth."""

    lexical: float = 0.4
    vector: float = 0.4
    graph: float = 0.2

    @property
    def valid(self) -> bool:
        return abs(self.lexical + self.vector + self.graph - 1) < 0.01

    @classmethod
    def preset(cls, kind: str) -> Weights:
        return cls(*PRESETS.get(kind, PRESETS["balanced"]))

    def combined(self, lexical: Column, vector: Column, graph: Column) -> Column:
        return self.lexical * lexical + self.vector * vector + self.graph * graph


def route(weights: Weights, has_vector: bool, has_nodes: bool, prefer: str | None = None) -> tuple[bool, bool, bool]:
    """Which legs are worth running; a leg that isn't never enters the plan."""
    w = (weights.lexical, weights.vector, weights.graph)
    if prefer == "exact":
        return True, w[1] > PREFERRED_WEIGHT, w[2] > PREFERRED_WEIGHT
    if prefer == "semantic":
        return w[0] > PREFERRED_WEIGHT, has_vector, w[2] > PREFERRED_WEIGHT
    if prefer == "related":
        return w[0] > PREFERRED_WEIGHT, w[1] > PREFERRED_WEIGHT, has_nodes
    return w[0] >= LEAST_WEIGHT, w[1] >= LEAST_WEIGHT and has_vector, w[2] >= LEAST_WEIGHT and has_nodes


def combine(lexical: DataFrame | None, vector: DataFrame | None, graph: DataFrame | None, weights: Weights, n: int = 10) -> DataFrame:
    """The ``n`` best of legs (doc_id, score), (doc_id, similarity) and (doc_id, distance).

    A document that a leg lacks scores 0 there. Lexical scores are divided by the greatest, if over 1;
    graph distances count as one less the share of the greatest distance.
    """
    if not weights.valid:
        raise ValueError("weights must add up to 1")
    kinds = (("lexical", lexical, "score"), ("vector", vector, "similarity"), ("graph", graph, "distance"))
    rows = None
    for name, leg, value in kinds:
        if leg is None:
            continue
        part = leg.select("doc_id", *[(F.col(value).cast("double") if k == name else F.lit(None).cast("double")).alias(k) for k, _, _ in kinds])
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no leg to run")
    merged = rows.groupBy("doc_id").agg(*[F.max(k).alias(k) for k, _, _ in kinds])
    most = merged.agg(F.greatest(F.max("lexical"), F.lit(1.0)).alias("most"), F.max("graph").alias("farthest"))
    scored = merged.crossJoin(F.broadcast(most)).select(  # one row
        "doc_id",
        F.round(F.coalesce(F.col("lexical") / F.col("most"), F.lit(0.0)), 6).alias("bm25_score"),
        F.round(F.coalesce("vector", F.lit(0.0)), 6).alias("vector_score"),
        F.round(F.when(F.col("graph").isNull(), 0.0).when(F.col("farthest") > 0, 1 - F.col("graph") / F.col("farthest")).otherwise(1.0), 6).alias("graph_score"),
    )
    total = F.round(weights.combined(F.col("bm25_score"), F.col("vector_score"), F.col("graph_score")), 6)
    return scored.withColumn("combined_score", total).orderBy(F.desc("combined_score"), "doc_id").limit(n)


def merge_rank(semantic: DataFrame, graph: DataFrame, n: int = 50) -> DataFrame:
    """(id, similarity, distance, score): 0.7 similarity and 0.3 nearness in the graph; the similarity alone outside it."""
    both = semantic.select("id", "similarity").join(graph.select("id", "distance"), "id", "full")
    near = F.coalesce("similarity", F.lit(0.0)) * 0.7 + 0.3 / (F.col("distance") + 1)
    score = F.round(F.when(F.col("distance").isNotNull(), near).otherwise(F.coalesce("similarity", F.lit(0.0))), 6)
    return both.withColumn("score", score).orderBy(F.desc("score"), "id").limit(n)


def reweighted(weights: Weights, **changes: float) -> Weights:
    return replace(weights, **changes)
