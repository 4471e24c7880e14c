"""Structured Streaming forms of operators: windowed throughput, documents replayed from edits, event routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.collaboration import apply_edit
from weftline.storage import new_path


def windowed_throughput(events: DataFrame, window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", key: str = "op") -> DataFrame:
    """(op, began, events, per_second) of event-time windows; events later than ``late`` are dropped."""
    each = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = events.withWatermark(ts, late).groupBy(key, each.alias("w")).agg(F.count("*").alias("events"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counted.select(key, F.col("w.start").alias("began"), "events", F.round(F.col("events") / seconds, 6).alias("per_second"))


def replayed_stream(edits: DataFrame) -> DataFrame:
    """(document, content, operations) after every batch of a stream of edits (document, op_id, kind, offset, content)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else ("", 0)
        rows = pd.concat(frames).sort_values("op_id")
        for kind, offset, content in zip(rows["kind"], rows["offset"], rows["content"]):
            text, n = apply_edit(text, kind, int(offset), content or ""), n + 1
        state.update((text, n))
        yield pd.DataFrame([(key[0], text, n)], columns=["document", "content", "operations"])

    return edits.groupBy("document").applyInPandasWithState(update, "document string, content string, operations bigint", "content string, operations bigint", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, keys: list[str], within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events without those that repeat one's keys within a time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def broadcast_events(events: DataFrame, permissions: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "kind") -> StreamingQuery:
    """Each batch joined with who may see it, and handed to ``deliver``."""
    return events.join(permissions, kind).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its result as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path = new_path(spark, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
