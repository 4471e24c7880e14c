"""From conversation messages to entities, relationships and digests.

Messages are (conversation_id, turn, kind, text, tools, ...); entities (entity_id, conversation_id, entity_type, name,
content, turn, ...). Joins are within a conversation and on turns, so no pair of unrelated rows is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_WORDS = ("implement", "create", "add", "fix", "optimize", "test", "build")
FILE_TOOLS = ("Read", "Edit", "Write")
BUILD_COMMANDS = ("zig build", "zig test", "zig fmt")


def tool_uses(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn, tool, params): tools that assistants called; parameters that aren't scalars are 'unknown'."""
    used = messages.filter(F.col("kind") == "assistant").select("conversation_id", "turn", F.explode("tools").alias("t"))
    raw = F.from_json("t.input", "map<string,string>")
    plain = F.transform_values(raw, lambda k, v: F.when(v.startswith("{") | v.startswith("["), "unknown").otherwise(v))
    return used.select("conversation_id", "turn", F.col("t.name").alias("tool"), plain.alias("params"))


def task_word(text: Column, words: tuple[str, ...] = TASK_WORDS) -> Column:
    """The first of the words, in their own order, that the text has."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def task_entities(messages: DataFrame) -> DataFrame:
    """A task for each user message that has a task word."""
    told = messages.filter(F.col("kind") == "user").withColumn("keyword", task_word(F.col("text"))).filter("keyword IS NOT NULL")
    return told.select("conversation_id", F.lit("task").alias("entity_type"), F.concat_ws("_", F.lit("task"), "keyword", "turn").alias("name"), F.substring("text", 1, 200).alias("content"), "turn", "keyword")


def file_entities(uses: DataFrame) -> DataFrame:
    """A file for each path that a file tool named, where it was seen first."""
    seen = uses.filter(F.col("tool").isin(*FILE_TOOLS) & F.col("params")["file_path"].isNotNull())
    first = seen.groupBy(F.col("params")["file_path"].alias("name")).agg(F.min(F.struct("conversation_id", "turn")).alias("first"))
    return first.select("first.conversation_id", F.lit("file").alias("entity_type"), "name", F.lit(None).cast("string").alias("content"), "first.turn", F.lit(None).cast("string").alias("keyword"))


def command_entities(uses: DataFrame) -> DataFrame:
    """A decision for each build command."""
    command = F.col("params")["command"]
    hit = command.startswith(BUILD_COMMANDS[0]) | command.startswith(BUILD_COMMANDS[1]) | command.startswith(BUILD_COMMANDS[2])
    return uses.filter(hit).select("conversation_id", F.lit("decision").alias("entity_type"), F.concat_ws("_", F.lit("build_command"), "turn").alias("name"), command.alias("content"), "turn", F.lit(None).cast("string").alias("keyword"))


def entities(messages: DataFrame) -> DataFrame:
    """All entities, numbered by hash of what they are, so that numbering needs no order of the whole."""
    uses = tool_uses(messages)
    found = task_entities(messages).unionByName(file_entities(uses)).unionByName(command_entities(uses))
    return found.withColumn("entity_id", F.xxhash64("conversation_id", "entity_type", "name", "turn"))


def _relation(kind: str, strength: float) -> list[Column]:
    return [F.lit(kind).alias("relationship_type"), F.lit(strength).alias("strength")]


def temporal_next(found: DataFrame) -> DataFrame:
    """From an entity to the next of its conversation, if that one's turn is the next."""
    order = Window.partitionBy("conversation_id").orderBy("turn", "entity_id")
    ahead = found.select("conversation_id", "turn", F.col("entity_id").alias("from_id"), F.lead("entity_id").over(order).alias("to_id"), F.lead("turn").over(order).alias("next_turn"))
    return ahead.filter(F.col("next_turn") - F.col("turn") == 1).select("conversation_id", "from_id", "to_id", *_relation("temporal_next", 1.0), "turn")


def co_modified(found: DataFrame, kind: str = "file") -> DataFrame:
    """Both ways between files of one turn."""
    a = found.filter(F.col("entity_type") == kind).select("conversation_id", "turn", F.col("entity_id").alias("from_id"))
    b = a.select("conversation_id", "turn", F.col("from_id").alias("to_id"))
    return a.join(b, ["conversation_id", "turn"]).filter("from_id <> to_id").select("conversation_id", "from_id", "to_id", *_relation("modifies", 0.7), "turn")


def task_to_file(found: DataFrame, within: int = 3, source: str = "task", target: str = "file") -> DataFrame:
    """From a task to the files of the next turns: the range of turns is unrolled into an equi-join."""
    tasks = found.filter(F.col("entity_type") == source).select("conversation_id", F.col("entity_id").alias("from_id"), "turn", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + within)).alias("at"))
    files = found.filter(F.col("entity_type") == target).select("conversation_id", F.col("entity_id").alias("to_id"), F.col("turn").alias("at"))
    return tasks.join(files, ["conversation_id", "at"]).select("conversation_id", "from_id", "to_id", *_relation("creates", 0.9), "turn")


def relationships(found: DataFrame) -> DataFrame:
    return temporal_next(found).unionByName(co_modified(found)).unionByName(task_to_file(found))


def conversation_stats(messages: DataFrame) -> DataFrame:
    """One row a conversation: turns, messages by kind, characters, duration if there are times."""
    aggs = [F.count("*").alias("turn_count"), F.count_if(F.col("kind") == "user").alias("user_messages"), F.count_if(F.col("kind") == "assistant").alias("assistant_messages"), F.sum(F.length("text")).alias("characters")]
    if "tools" in messages.columns:
        aggs.append(F.sum(F.size("tools")).alias("tool_calls"))
    if "ts" in messages.columns:
        aggs.append((F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("duration_s"))
    return messages.groupBy("conversation_id").agg(*aggs)


def file_mentions(messages: DataFrame, most: int = 10) -> DataFrame:
    """(name, messages): file-like words, the first ``most`` of each message."""
    found = F.slice(F.regexp_extract_all("text", F.lit(r"\b\w+\.\w+\b"), F.lit(0)), 1, most)
    return messages.select(F.explode(F.array_distinct(found)).alias("name")).groupBy("name").agg(F.count("*").alias("messages"))


def session_preview(messages: DataFrame, most: int = 10, cut: int = 200) -> DataFrame:
    """The first messages of each conversation, shortened."""
    order = Window.partitionBy("conversation_id").orderBy("turn")
    return messages.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("conversation_id", "turn", "kind", F.substring("text", 1, cut).alias("preview"))


def context_budget(messages: DataFrame, budget: int = 8000) -> DataFrame:
    """The messages of each conversation that fit a budget of characters, in order: a running sum, up to the first that doesn't fit."""
    order = Window.partitionBy("conversation_id").orderBy("turn")
    run = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("used", run).filter(F.col("used") <= budget).select("conversation_id", "turn", "kind", "used")


def tool_context_budget(messages: DataFrame, budget: int = 6000, tools_first: int = 10, others: int = 20, cut: int = 300, uses_tool: Column | None = None) -> DataFrame:
    """First messages that use tools, then others, shortened, as many as fit the budget."""
    uses = uses_tool if uses_tool is not None else F.size("tools") > 0
    classed = messages.withColumn("class", F.when(uses, 0).otherwise(1)).withColumn("part", F.substring("text", 1, cut))
    k = F.row_number().over(Window.partitionBy("conversation_id", "class").orderBy("turn"))
    kept = classed.withColumn("k", k).filter((F.col("k") <= F.when(F.col("class") == 0, tools_first).otherwise(others)))
    run = F.sum(F.length("part")).over(Window.partitionBy("conversation_id").orderBy("class", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("used", run).filter(F.col("used") <= budget).select("conversation_id", "turn", "class", "used")


def merge_graphs(found: DataFrame, links: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities once a name, the first by ``order`` staying; all relationships)."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return found.withColumn("k", rank).filter("k = 1").drop("k"), links


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def analyser_stats(log: DataFrame) -> DataFrame:
    """One row: shares of calls that hit the cache and that failed."""
    n = F.greatest(F.count("*"), F.lit(1))
    return log.agg(F.count("*").alias("calls"), F.round(F.count_if("hit") / n, 6).alias("cache_hit_rate"), F.round(F.count_if("failed") / n, 6).alias("error_rate"))


def analysed(messages: DataFrame, analyser, schema: str, most: int = 50) -> DataFrame:
    """Outputs of an outside analyser, a function from an iterator of pandas frames to one, over the first messages with text of each conversation."""
    order = Window.partitionBy("conversation_id").orderBy("turn")
    kept = messages.filter("text IS NOT NULL AND text <> ''").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
    return kept.mapInPandas(analyser, schema)
