"""Chat formatting: heterogeneous records to canonical turns, by fingerprints of their nested field paths.

Each layout is declared: the field paths that make it, and how they map to turns. A record's fingerprint is
the hash of those of its non-null paths that any layout mentions; a table from fingerprints to layouts then
selects the mapping. So fields that no layout knows don't matter, wherever they stand, and a record that mixes
two layouts has a fingerprint of neither. Everything is a column expression on variants: nothing is
collected, and no row moves.

Roles are trimmed, put in lower case and mapped to system, user, assistant or tool; others stay as they are.
Contents that are lists of parts become the texts of the parts, one a line; other values become JSON.

Nulls and corner cases. A null or malformed record, one with a fingerprint that no layout has (a null
where a path is needed included) and one with an empty list of messages give a single row of layout
'unknown' without turn, role and content: no record is lost. A message that lacks its role or content gives
a turn with a null there. Empty contents stay empty. Rows that repeat give their turns each. Columns beside the
record are carried as they are; they may bear any name but those of the result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col

ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system", "function": "tool", "observation": "tool"}


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, paths whose texts make the content); or ``each`` with the paths of an element's role and content.

    A role that begins with $ is a path. ``index``: the path of the turn's number, else turns count from 0. ``before``: turns ahead of
    those of ``each``.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = ""
    content: str = ""
    index: str | None = None
    before: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _pairs(name: str, user: tuple[str, ...], assistant: str) -> list[Layout]:
    """A layout of one question and one answer, without and with a system prompt."""
    turns = (("user", user), ("assistant", (assistant,)))
    return [Layout(name, (*user, assistant), turns), Layout(f"{name}_system", (*user, assistant, "system"), (("system", ("system",)), *turns))]


LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_row", ("turn", "role", "text"), (("$role", ("text",)),), index="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), each="messages", role="role", content="content"),
    Layout("messages_system", ("messages[].role", "messages[].content", "system"), each="messages", role="role", content="content", before=(("system", ("system",)),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", content="value"),
    Layout("conversations_system", ("conversations[].from", "conversations[].value", "system"), each="conversations", role="from", content="value", before=(("system", ("system",)),)),
    *_pairs("prompt_response", ("prompt",), "response"),
    *_pairs("prompt_completion", ("prompt",), "completion"),
    *_pairs("question_answer", ("question",), "answer"),
    *_pairs("instruction", ("instruction",), "output"),
    *_pairs("instruction_input", ("instruction", "input"), "output"),
    *_pairs("instruction_response", ("instruction",), "response"),
    Layout("prompt", ("prompt",), (("user", ("prompt",)),)),
)


def _get(v: F.Column, path: str, kind: str = "variant") -> F.Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: F.Column) -> F.Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def _has(v: F.Column, path: str) -> F.Column:
    head, _, leaf = path.partition("[].")
    if not leaf:
        return _is(_get(v, head))
    return F.coalesce(F.exists(_get(v, head, "array<variant>"), lambda m: _is(_get(m, leaf))), F.lit(False))


def record_fingerprint(v: F.Column, layouts: tuple[Layout, ...] = LAYOUTS) -> F.Column:
    known = sorted({p for x in layouts for p in x.paths})
    return F.substring(F.sha2(F.array_join(F.array(*[F.when(_has(v, p), F.lit(p)) for p in known]), "\n").cast("binary"), 256), 1, 16)


def _text(v: F.Column) -> F.Column:
    """A string as it is; the texts of a list of parts; JSON of anything else."""
    kind = F.schema_of_variant(v)
    parts = F.array_join(F.transform(v.cast("array<variant>"), lambda p: F.coalesce(_get(p, "text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))), "\n")
    return F.when(~_is(v), F.lit(None).cast("string")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY<"), F.when(kind.startswith("ARRAY<OBJECT") | (kind == "ARRAY<STRING>"), parts).otherwise(F.to_json(v))).otherwise(F.to_json(v))


def canonical_role(role: F.Column) -> F.Column:
    plain = F.lower(F.trim(role))
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(table[plain], plain)


def _turn(index: F.Column, role: F.Column, content: F.Column) -> F.Column:
    return F.struct(index.cast("bigint").alias("turn"), role.cast("string").alias("role"), content.cast("string").alias("content"))


def _turns(v: F.Column, layout: Layout) -> F.Column:
    out = []
    for n, (role, paths) in enumerate(layout.before or layout.turns):
        said = [_text(_get(v, p)) for p in paths]
        own = canonical_role(_get(v, role[1:], "string")) if role.startswith("$") else F.lit(role)
        content = said[0] if len(said) == 1 else F.concat_ws("\n\n", *[F.when(x != "", x) for x in said])
        out.append(_turn(_get(v, layout.index, "bigint") if layout.index else F.lit(n), own, content))
    if not layout.each:
        return F.array(*out)
    told = F.transform(_get(v, layout.each, "array<variant>"), lambda m, i: _turn(i + len(out), canonical_role(_get(m, layout.role, "string")), _text(_get(m, layout.content))))
    return F.concat(F.array(*out), told) if out else told


def canonical_turns(records: DataFrame, record: F.Column, keep: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``keep`` columns, then (layout, fingerprint, turn, role, content): a row for each turn of each record.

    ``record`` is a column of JSON texts or of variants.
    """
    if len({x.fingerprint for x in layouts}) < len(layouts):
        raise ValueError("two layouts have the same paths")
    carried = {f"k{i}": c for i, c in enumerate(keep)}
    rows = records.select(*[col(c).alias(k) for k, c in carried.items()], record.alias("v"))
    if dict(rows.dtypes)["v"] != "variant":
        rows = rows.withColumn("v", F.try_parse_json("v"))
    marked = rows.withColumn("fingerprint", F.coalesce(record_fingerprint(F.col("v"), layouts), F.lit(fingerprint_of(()))))
    names = F.create_map(*[F.lit(x) for lay in layouts for x in (lay.fingerprint, lay.name)])
    named = marked.withColumn("layout", F.coalesce(names[F.col("fingerprint")], F.lit("unknown")))
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,content:string>>")
    for lay in layouts:
        turns = F.when(F.col("layout") == lay.name, _turns(F.col("v"), lay)).otherwise(turns)
    told = named.select(*carried, "layout", "fingerprint", F.explode_outer(turns).alias("t"))
    return told.select(*[F.col(k).alias(c) for k, c in carried.items()], F.when(F.col("t").isNull(), "unknown").otherwise(F.col("layout")).alias("layout"), "fingerprint", "t.turn", "t.role", "t.content")


def conversation_turns(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, fingerprint, turn, role, content) of a table whose rows are records, whatever their columns."""
    return canonical_turns(table, F.to_variant_object(F.struct(*[col(c) for c in table.columns])), ["conv_id"], layouts)


def render(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, chat): each conversation's turns in order, as ``<|role|>`` and content lines."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("content", F.lit("")))
    listed = turns.filter("turn IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return listed.select(key, F.size("t").cast("bigint").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("chat"))


_ROLE_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())
SQL = f"""
SELECT conv_id, CASE WHEN whole THEN 'turn_row' ELSE 'unknown' END AS layout,
       substr(sha256(array_to_string(list_filter([CASE WHEN role IS NOT NULL THEN 'role' END, CASE WHEN text IS NOT NULL THEN 'text' END, CASE WHEN turn IS NOT NULL THEN 'turn' END], lambda x: x IS NOT NULL), chr(10))), 1, 16) AS fingerprint,
       CASE WHEN whole THEN turn END AS turn, CASE WHEN whole THEN CASE lower(trim(role)) {_ROLE_CASES} ELSE lower(trim(role)) END END AS role, CASE WHEN whole THEN text END AS content
FROM (SELECT *, role IS NOT NULL AND text IS NOT NULL AND turn IS NOT NULL AS whole FROM conversations)
"""
