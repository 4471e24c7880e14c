"""Named tables of a folder, and the tables that stand in for others in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.storage import parts_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table; the table is made if there is none."""
    rows.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_changes(events: DataFrame) -> DataFrame:
    """Events as versions: a user is a path, the properties its content."""
    return events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("path"), F.col("props").alias("content"))


def as_operations(events: DataFrame) -> DataFrame:
    """Events as operations: a user is an agent, a type an operation, a value its latency."""
    return events.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_id"), F.col("event_type").alias("op"), F.col("value").alias("latency_ms"))


def as_edges(lineitem: DataFrame) -> DataFrame:
    """Parts that follow each other in an order, with the least quantity of the former as weight; as many tasks as the lines take."""
    parts = parts_of(lineitem.count())
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition(parts, "l_orderkey")
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("weight"))
    return pairs.filter("dst IS NOT NULL AND src <> dst").repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


EDGES_SQL = """
links AS (
  SELECT src, dst, min(weight) AS weight FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, l_quantity AS weight FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def as_edits(events: DataFrame) -> DataFrame:
    """Events as edits of shared documents: a document is an hour, agents are users in four groups."""
    agent = F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string"))
    return events.select(
        F.col("event_id").alias("op_id"),
        agent.alias("agent_id"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("document"),
        F.element_at(F.array(*[F.lit(x) for x in ("insert", "delete", "modify")]), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"),
        (F.col("event_id") * 7 % 101).alias("offset"),
        F.col("event_type").alias("content"),
        F.create_map(F.lit("a0"), F.col("event_id") % 5, F.lit("a1"), F.col("event_id") % 7, F.lit("a2"), F.col("event_id") % 3).alias("clock"),
        "ts",
    )
