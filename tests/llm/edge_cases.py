"""Awkward rows for every operator."""

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
EXTRA = ("id", "H", "k", "first", "c0", "sig", "rep", "token", "v", "count", "content_hash", "bucket", "label", "gone_id", "meta.url", "a`b.c", "T")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in EXTRA)


def table(spark, rows):
    """Documents with extra columns of clashing names; rows are (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None, *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


PROSE = "the quick brown fox jumps over the lazy dog while a slow green turtle looks on from the far bank of the river and says nothing at all"
EDGES = [
    (1, PROSE),
    (2, PROSE),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (7, LONG),
    (8, "one"),
    (8, "one"),
    (None, PROSE),
    (None, None),
    (9, PROSE + " indeed", None),
    (10, "!!! ### ???"),
    (11, "日本語 テキスト ñandú straße 😀"),
    (12, "a" * 30_000),
]
