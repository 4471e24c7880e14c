"""Versioned key/value tables: (seq, ts, path, content) rows, appended and never changed.

``seq`` orders versions; ``ts`` is in seconds or any other orderable type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_SECONDS = 365 * 86400


def latest(changes: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last version of each key: an aggregate with a map-side part, so that only one row a key and task moves."""
    others = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("v"))
    return best.select(*[F.col(f"v.{c}").alias(c) if c != key else F.col(key) for c in changes.columns])


def history(changes: DataFrame, n: int = 10, key: str = "path", order: str = "seq") -> DataFrame:
    """The newest ``n`` versions of each key, numbered from the newest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return changes.withColumn("version", rank).filter(F.col("version") <= n)


def history_of(changes: DataFrame, path, n: int = 10, key: str = "path", order: str = "seq") -> DataFrame:
    """One key's newest versions; the filter reaches the scan. An unknown key gives no row."""
    return changes.filter(F.col(key) == path).orderBy(F.desc(order)).limit(n)


def query_history(changes: DataFrame, n: int, since, key: str = "path", order: str = "seq") -> DataFrame:
    """The newest ``n`` versions of each key, of these the ones from ``since`` on, numbered anew, with their sizes in bytes."""
    recent = history(changes, n, key, order).filter(F.col("ts") >= since)
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return recent.withColumn("version", number).withColumn("bytes", F.octet_length("content"))


def overview(changes: DataFrame, key: str = "path") -> DataFrame:
    """One row: keys, versions, versions a key."""
    return changes.agg(F.count_distinct(key).alias("keys"), F.count("*").alias("versions")).withColumn("mean_versions", F.round(F.col("versions") / F.greatest("keys", F.lit(1)), 6))


def includes(begin: Column, end: Column, at: Column) -> Column:
    """Whether a closed interval holds a moment; without an end it is open."""
    return (begin <= at) & (end.isNull() | (end >= at))


def active(edges: DataFrame, at, begin: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return edges.filter(includes(F.col(begin), F.col(end), F.lit(at)))


def as_of(changes: DataFrame, at, key: str = "path", order: str = "seq", deleted: Column | None = None) -> DataFrame:
    """The state at a moment: the last version of each key up to then, without keys deleted by then."""
    state = latest(changes.filter(F.col("ts") <= at), key, order)
    return state if deleted is None else state.filter(~deleted)


def replay(snapshot: DataFrame, deltas: DataFrame, at, key: str = "path", order: str = "seq", deleted: Column | None = None) -> DataFrame:
    """The state at a moment from a snapshot and the changes after it."""
    return as_of(snapshot.unionByName(deltas), at, key, order, deleted)


def compression(rows: DataFrame, content: str = "content", key: str = "path", order: str = "seq") -> DataFrame:
    """One row: bytes of all versions, bytes of the last ones, their ratio."""
    all_bytes = rows.agg(F.sum(F.octet_length(content)).alias("all_bytes"))
    last = latest(rows, key, order).agg(F.sum(F.octet_length(content)).alias("last_bytes"))
    return all_bytes.crossJoin(F.broadcast(last)).withColumn("ratio", F.round(F.col("all_bytes") / F.greatest("last_bytes", F.lit(1)), 6))


def recency_weight(seconds: Column) -> Column:
    """1 now, falling to 0 in a year."""
    return 1 - F.least(F.abs(seconds), F.lit(YEAR_SECONDS)) / float(YEAR_SECONDS)
