"""Rate limits, lockouts, locks, sessions and permissions over logs, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_limit(attempts: DataFrame, limit: int, key: str = "key", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Every attempt, with its number in its hour and whether it is let through."""
    hour = F.date_trunc("hour", ts)
    k = F.row_number().over(Window.partitionBy(key, hour).orderBy(order))
    return attempts.withColumn("in_hour", k).withColumn("allowed", F.col("in_hour") <= limit)


def lockouts(attempts: DataFrame, most: int = 5, key: str = "user_id", order: str = "seq") -> DataFrame:
    """Every failed attempt, with the failures since the last success, and whether it locks the user out."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = attempts.withColumn("island", F.sum(F.when(F.col("success"), 1).otherwise(0)).over(so_far)).filter(~F.col("success"))
    k = F.row_number().over(Window.partitionBy(key, "island").orderBy(order))
    return island.withColumn("failures", k).withColumn("locked", F.col("failures") >= most).drop("island")


def sessions(rows: DataFrame, gap_s: int = 3600, key: str = "agent_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """(key, session, began, ended, events): activity without a pause over ``gap_s``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    new = F.when(F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) <= gap_s, 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def compatible(kind_a: Column, agent_a: Column, kind_b: Column, agent_b: Column) -> Column:
    """Locks of one agent, or both for reading."""
    return (agent_a == agent_b) | ((kind_a == "read") & (kind_b == "read"))


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """(path, lock_a, lock_b): locks of one path that overlap in time and aren't compatible."""
    fields = ["lock_id", "agent_id", "kind", "acquired", "expires"]
    a, b = (locks.select("path", F.struct(*fields).alias(x)) for x in "ab")
    overlap = (F.col("a.acquired") < F.col("b.expires")) & (F.col("b.acquired") < F.col("a.expires"))
    return a.join(b, "path").filter((F.col("a.lock_id") < F.col("b.lock_id")) & overlap & ~compatible(F.col("a.kind"), F.col("a.agent_id"), F.col("b.kind"), F.col("b.agent_id"))).select("path", F.col("a.lock_id").alias("lock_a"), F.col("b.lock_id").alias("lock_b"))


def accessible(requests: DataFrame, locks: DataFrame, at: Column) -> DataFrame:
    """Requests (path, agent_id, kind) that no live lock of another forbids."""
    live = locks.filter((F.col("acquired") <= at) & (F.col("expires") > at)).select(F.col("path").alias("p"), F.col("agent_id").alias("holder"), F.col("kind").alias("held"))
    return requests.join(live, (F.col("path") == F.col("p")) & ~compatible(F.col("kind"), F.col("agent_id"), F.col("held"), F.col("holder")), "left_anti")


def live_locks(locks: DataFrame, at: Column) -> DataFrame:
    return locks.filter(F.col("expires") > at)


def routed(events: DataFrame, permissions: DataFrame, kind: str = "kind") -> DataFrame:
    """(event, role) of the roles that may see it: permissions are (role, kind), a table of the size of the roles."""
    return events.join(permissions, kind)


def authorised(role: Column, allowed: Column, tool: Column) -> Column:
    """Admins may use any tool, readers none that writes, others those on their list."""
    return F.when(role == "admin", True).when((role == "readonly") & (tool.contains("write") | tool.contains("store") | tool.contains("link")), False).otherwise(F.coalesce(F.array_contains(allowed, tool), F.lit(False)))


def security_report(connections: DataFrame, capacity: int, most_share: float = 0.8, most_limited: int = 10) -> DataFrame:
    """One row: use of capacity, keys over their limit, and what to do."""
    told = connections.agg(F.round(F.count("*") / float(capacity), 6).alias("utilisation"), F.count_distinct(F.when(~F.col("allowed"), F.col("key"))).alias("limited"))
    advice = F.filter(F.array(F.when(F.col("utilisation") > most_share, F.lit("raise capacity")), F.when(F.col("limited") > most_limited, F.lit("many limited keys"))), lambda x: x.isNotNull())
    return told.withColumn("advice", F.array_join(advice, "; "))
