"""Latency, throughput, memory, anomalies, alerts and regressions over logs of operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 10_000
SALTS = 64
BUCKET_S, BUCKET_ROWS = 86_400, 1 << 20
#: Added before rounding, so that a mean that ends in 5 is rounded up whatever the order of its sum.
TIE = 1e-9
P99_MS, LEAST_QPS, MEMORY_MB = 100.0, 100.0, 1000.0


def _percentiles(value: str, shares: dict[str, float]) -> list[Column]:
    return [F.round(F.percentile(value, F.lit(p)), 6).alias(name) for name, p in shares.items()]


def latency(ops: DataFrame, key: str = "op", value: str = "latency_ms", last: int | None = RING, order: str = "seq") -> DataFrame:
    """Percentiles of each operation, over its ``last`` samples.

    There are few operations and many samples: the last of each of SALTS parts come first, then the last of these.
    """
    if last is not None:
        ops = ops.select(key, value, order, F.pmod(F.xxhash64(order), F.lit(SALTS)).alias("salt"))
        for keys in ([key, "salt"], [key]):
            k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
            ops = ops.withColumn("k", k).filter(F.col("k") <= last)
    return ops.groupBy(key).agg(F.count("*").alias("samples"), F.round(F.avg(value), 6).alias("mean_ms"), *_percentiles(value, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}))


def rolling_latency(ops: DataFrame, rows: int = 100, key: str = "op", value: str = "latency_ms", order: str = "seq") -> DataFrame:
    """Mean and maximum of each operation's last ``rows`` samples at every sample."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return ops.select(order, key, F.round(F.avg(value).over(frame) + TIE, 6).alias("mean_ms"), F.max(value).over(frame).alias("max_ms"))


def throughput(ops: DataFrame, seconds: int = 60, key: str = "op", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Operations a second in the ``seconds`` up to each operation.

    A day of an operation is one task's work; rows near its end are lent to the next day.
    """
    bucket_s = max(BUCKET_S, seconds)
    timed = ops.select(order, key, F.unix_timestamp(ts).alias("s"))
    own = F.floor(F.col("s") / bucket_s)
    lent = F.when((F.col("s") + seconds) >= (own + 1) * bucket_s, F.array(own, own + 1)).otherwise(F.array(own))
    spread = timed.withColumn("own", own).withColumn("bucket", F.explode(lent))
    frame = Window.partitionBy(key, "bucket").orderBy("s").rangeBetween(-seconds, 0)
    counted = spread.withColumn("n", F.count("*").over(frame)).filter("bucket = own")
    return counted.select(order, key, F.round(F.col("n") / float(seconds), 6).alias("per_second"))


def memory_peaks(deltas: DataFrame, key: str = "agent_id", delta: str = "delta", order: str = "seq") -> DataFrame:
    """Memory in use, and its peak so far, at every change."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("in_use", F.round(F.sum(delta).over(so_far), 6)).select(order, key, "in_use", F.max("in_use").over(so_far).alias("peak"))


def leaks(allocations: DataFrame, frees: DataFrame, before, key: str = "address", ts: str = "ts") -> DataFrame:
    """Allocations from before a moment that nothing freed."""
    return allocations.filter(F.col(ts) < before).join(frees.select(key).distinct(), key, "left_anti")


def agent_operations(ops: DataFrame) -> DataFrame:
    return ops.groupBy("agent_id", "op").agg(F.count("*").alias("n"))


def anomalies(ops: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(agent_id, deviation): agents whose counts by operation are uneven: sum of squared deviations from their mean."""
    spread = agent_operations(ops).groupBy("agent_id").agg(F.round(F.var_pop("n") * F.count("*"), 6).alias("deviation"))
    return spread.filter(F.col("deviation") > threshold)


def alerts(ops: DataFrame, memory_mb: DataFrame | None = None, p99_ms: float = P99_MS, least_qps: float = LEAST_QPS, most_mb: float = MEMORY_MB) -> DataFrame:
    """(kind, subject, severity, value): slow operations, low throughput, much memory."""
    slow = latency(ops).filter(F.col("p99_ms") > p99_ms).select(F.lit("latency").alias("kind"), F.col("op").alias("subject"), F.lit("critical").alias("severity"), F.col("p99_ms").alias("value"))
    span = F.greatest(F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts")), F.lit(1))
    rate = ops.groupBy("op").agg(F.round(F.count("*") / span, 6).alias("value")).filter(F.col("value") < least_qps)
    parts = [slow, rate.select(F.lit("throughput").alias("kind"), F.col("op").alias("subject"), F.lit("warning").alias("severity"), "value")]
    if memory_mb is not None:
        parts.append(memory_mb.filter(F.col("value") > most_mb).select(F.lit("memory").alias("kind"), "subject", F.lit("critical").alias("severity"), "value"))
    return reduce(DataFrame.unionByName, parts)


def report(ops: DataFrame) -> DataFrame:
    """One row: a JSON document of each operation's figures."""
    told = latency(ops).agg(F.sort_array(F.collect_list(F.struct("op", "samples", "mean_ms", "p50_ms", "p95_ms", "p99_ms"))).alias("operations"))
    return told.select(F.to_json(F.struct("operations")).alias("report"))


def retained(rows: DataFrame, since: Column, ts: str = "ts") -> DataFrame:
    """Rows that cleaning up leaves."""
    return rows.filter(F.col(ts) >= since)


def newest(rows: DataFrame, n: int, keys: list[str] | None = None, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The newest ``n`` rows, or of each key, numbered from the newest."""
    if keys:
        k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie)))
        return rows.withColumn("k", k).filter(F.col("k") <= n)
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def audit_tail(rows: DataFrame, n: int, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return newest(rows, n, None, ts, tie).orderBy(ts, tie)


def outcomes(rows: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Successes and failures of each key, and their share."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("total"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"), F.round(F.count_if(success) / n, 6).alias("success_rate"))


def upper_median(runs: DataFrame, key: str = "name", value: str = "latency") -> DataFrame:
    """(key, baseline): the element at half the number of each key's sorted values."""
    w = Window.partitionBy(key)
    ranked = runs.filter(F.col(value).isNotNull()).select(key, value, F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select(key, F.col(value).alias("baseline"))


def severity(percent: Column) -> Column:
    return F.when(percent < 10, "none").when(percent < 25, "minor").when(percent < 50, "moderate").when(percent < 100, "major").otherwise("critical")


def regressions(current: DataFrame, baseline: DataFrame, most_percent: float = 10.0, key: str = "name") -> DataFrame:
    """(key, value, baseline, percent, severity, regressed): change against the baseline."""
    both = current.select(key, "value").join(baseline.select(key, "baseline"), key)
    percent = F.round(F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0), 6)
    return both.withColumn("percent", percent).withColumn("severity", severity(F.col("percent"))).withColumn("regressed", F.col("percent") > most_percent)


def suite_regressions(current: DataFrame, baseline: DataFrame, metrics: list[str], most_percent: float = 5.0, key: str = "name") -> DataFrame:
    """The same for several metrics at once, a row each."""
    tall = lambda df, v: df.unpivot([key], metrics, "metric", v)
    both = tall(current, "value").join(tall(baseline, "baseline"), [key, "metric"])
    percent = F.round(F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0), 6)
    return both.withColumn("percent", percent).filter(F.col("percent") > most_percent)


def agent_metrics(ops: DataFrame, success: Column, value: str = "latency_ms") -> DataFrame:
    """One row an agent: requests, share of successes, mean duration, last activity."""
    return ops.groupBy("agent_id").agg(F.count("*").alias("requests"), F.round(100.0 * F.count_if(success) / F.count("*"), 6).alias("success_percent"), F.round(F.avg(value), 6).alias("mean_ms"), F.max("ts").alias("last_activity"))


def overall(metrics: DataFrame) -> DataFrame:
    """Means of the agents' means, each agent counting the same."""
    return metrics.agg(F.count("*").alias("agents"), F.round(F.avg("success_percent"), 6).alias("success_percent"), F.round(F.avg("mean_ms"), 6).alias("mean_ms"))


def adjacent_pairs(ops: DataFrame, within_s: float = 10.0, part: str | None = None) -> DataFrame:
    """(seq, agent_id, next_agent): neighbours in time by different agents, less than ``within_s`` apart.

    Without ``part`` the order is of all rows; days are separate tasks and hand over their first row.
    """
    day = part or "_day"
    rows = ops if part else ops.withColumn("_day", F.to_date("ts"))
    order = Window.partitionBy(day).orderBy("ts", "seq")
    told = rows.select(day, "seq", "ts", "agent_id", F.lead(F.struct("ts", "agent_id")).over(order).alias("next"))
    if not part:
        heads = rows.groupBy(day).agg(F.min(F.struct("ts", "seq", "agent_id")).alias("h"))
        after = heads.select(day, F.lead(F.struct(F.col("h.ts").alias("ts"), F.col("h.agent_id").alias("agent_id"))).over(Window.orderBy(day)).alias("after"))  # one row a day
        told = told.join(after, day, "left").withColumn("next", F.coalesce("next", "after"))
    gap = F.col("next.ts").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return told.filter((F.col("next.agent_id") != F.col("agent_id")) & (gap < within_s)).select("seq", "agent_id", F.col("next.agent_id").alias("next_agent"))


def operation_stats(ops: DataFrame) -> DataFrame:
    """One row an operation: count, mean, share of all."""
    total = ops.agg(F.count("*").alias("total"))
    each = ops.groupBy("op").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
    return each.crossJoin(F.broadcast(total)).select("op", "n", "mean_ms", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def agent_sessions(ops: DataFrame, now: Column, active_s: int = 300) -> DataFrame:
    """One row an agent: last activity, operations, uses by operation, whether active."""
    each = agent_operations(ops).groupBy("agent_id").agg(F.sum("n").alias("operations"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("op", "n")))).alias("usage"))
    last = ops.groupBy("agent_id").agg(F.max("ts").alias("last_activity"))
    return last.join(each, "agent_id").withColumn("active", F.unix_timestamp(now) - F.unix_timestamp("last_activity") < active_s)


def running_mean(ops: DataFrame, key: str = "op", value: str = "latency_ms", order: str = "seq") -> DataFrame:
    """Mean of all samples so far, at every sample: running sums within buckets of the order, on top of the buckets before."""
    rows = ops.select(order, key, value, F.floor(F.col(order) / BUCKET_ROWS).alias("bucket"))
    totals = rows.groupBy(key, "bucket").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    within = Window.partitionBy(key, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(order, key, "bucket", F.sum(value).over(within).alias("s"), F.count(value).over(within).alias("c"))
    return own.join(before, [key, "bucket"]).select(order, key, F.round((F.col("s") + F.col("total")) / (F.col("c") + F.col("n")) + TIE, 6).alias("mean_ms"))


def describe(ops: DataFrame, key: str = "op", value: str = "latency_ms") -> DataFrame:
    """Mean, sample deviation and percentiles."""
    return ops.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stddev"), *_percentiles(value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}))


def participation(ops: DataFrame) -> DataFrame:
    """One row an operation: how many, by how many agents, and how many each."""
    n, agents = F.count("*"), F.count_distinct("agent_id")
    return ops.groupBy("op").agg(n.alias("n"), agents.alias("agents"), F.round(n / agents, 6).alias("per_agent"))


def participants(events: DataFrame, order: str = "seq") -> DataFrame:
    """(agent_id, contributions, present) from joins, leaves and contributions (column kind): who left last is not present."""
    return events.groupBy("agent_id").agg(F.count_if(F.col("kind") == "contribution").alias("contributions"), (F.max_by("kind", order) != "leave").alias("present"))


def metric_regressions(current: DataFrame, baseline: DataFrame, most_percent: dict[str, float], key: str = "name") -> DataFrame:
    """(key, metric, value, baseline, percent, regressed): each metric against its own bound."""
    both = suite_regressions(current, baseline, list(most_percent), float("-inf"), key)
    bound = F.create_map(*[F.lit(x) for pair in most_percent.items() for x in pair])[F.col("metric")]
    return both.withColumn("regressed", F.col("percent") > bound)
