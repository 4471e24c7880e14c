"""Column functions over vector clocks: maps from agent to count, a missing agent counting 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zipped(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, zero) - F.coalesce(x, zero)))


def tick(clock: Column, agent: Column) -> Column:
    """``clock`` with one more for ``agent``."""
    return merge(clock, F.create_map(agent, F.coalesce(clock[agent], F.lit(0).cast("bigint")) + 1))


def merge(a: Column, b: Column) -> Column:
    """The greater count of each agent."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def happens_before(a: Column, b: Column) -> Column:
    """No agent counts more in ``a``, and some agent counts less."""
    more = _zipped(a, b)
    return F.forall(more, lambda d: d >= 0) & F.exists(more, lambda d: d > 0)


def concurrent(a: Column, b: Column) -> Column:
    """Neither happens before the other; equal clocks are concurrent."""
    more = _zipped(a, b)
    behind, ahead = F.exists(more, lambda d: d > 0), F.exists(more, lambda d: d < 0)
    return behind == ahead


def affects(kind: Column, offset: Column, length: Column, other: Column) -> Column:
    """Whether an edit at ``offset`` touches the place ``other``."""
    return F.when(kind == "insert", offset <= other).when(kind.isin("delete", "modify"), (offset <= other) & (other < offset + length)).otherwise(False)


def edited(content: Column, kind: Column, offset: Column, text: Column) -> Column:
    """One edit applied to a text, in characters, places beyond its end being clamped."""
    at = F.least(F.greatest(offset, F.lit(0)), F.length(content)).cast("int")
    head = F.substring(content, F.lit(1), at)
    rest = content.substr(at + 1, F.length(content))
    tail = content.substr((at + F.length(text) + 1).cast("int"), F.length(content))
    return F.when(kind == "insert", F.concat(head, text, rest)).when(kind == "delete", F.concat(head, tail)).when((kind == "modify") & (offset < F.length(content)), F.concat(head, text, tail)).otherwise(content)
