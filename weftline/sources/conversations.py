"""Conversation logs: files of JSON lines, one message a line, malformed lines skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import base_name

MESSAGE = "type STRING, uuid STRING, parentUuid STRING, sessionId STRING, timestamp STRING, cwd STRING, gitBranch STRING, message STRUCT<role: STRING, content: STRING>, toolUseResult STRING, _bad STRING"
MOST_BYTES = 10 * 1024 * 1024
PART = "ARRAY<STRUCT<type: STRING, text: STRING, name: STRING, input: STRING, id: STRING, tool_use_id: STRING, content: STRING, is_error: BOOLEAN>>"


def read_conversations(spark: SparkSession, *paths: str, recursive: bool = False, most_bytes: int | None = None) -> DataFrame:
    """Messages of all files: conversation_id, file, seq, ts, kind, text, tools, results.

    ``message.content`` is a text, or a list of parts whose texts are joined. ``seq`` orders a file's messages
    by timestamp and place. All files are read, whatever their size; with ``most_bytes`` (such as ``MOST_BYTES``) larger ones are left out.
    """
    raw = spark.read.schema(MESSAGE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", str(recursive).lower()).json(list(paths))
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    if most_bytes is not None:
        raw = raw.filter(F.col("_size") <= most_bytes)
    content = F.col("message.content")
    listed = content.startswith("[")
    parts = F.when(listed, F.from_json(content, PART))
    told = raw.filter(F.col("_bad").isNull() & F.col("type").isNotNull()).select(
        base_name(F.col("file")).alias("conversation_id"),
        "file",
        F.col("type").alias("kind"),
        "uuid",
        F.col("parentUuid").alias("parent"),
        F.col("sessionId").alias("session_id"),
        F.to_timestamp("timestamp").alias("ts"),
        "cwd",
        F.when(listed & parts.isNotNull(), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(content).alias("text"),
        F.coalesce(F.transform(F.filter(parts, lambda p: p["type"] == "tool_use"), lambda p: F.struct(p["name"].alias("name"), p["input"].alias("input"), p["id"].alias("id"))), F.array().cast("array<struct<name:string,input:string,id:string>>")).alias("tools"),
        F.concat(F.coalesce(F.transform(F.filter(parts, lambda p: p["type"] == "tool_result"), lambda p: p["content"]), F.array().cast("array<string>")), F.when(F.col("toolUseResult").isNotNull(), F.array("toolUseResult")).otherwise(F.array().cast("array<string>"))).alias("results"),
        "_start",
        "_row",
    )
    from pyspark.sql import Window

    order = Window.partitionBy("conversation_id").orderBy(F.col("ts").asc_nulls_last(), "_start", "_row")
    return told.withColumn("seq", F.row_number().over(order) - 1).drop("_start", "_row")
