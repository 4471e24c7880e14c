"""Known answers of column functions."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import clocks, vectors
from weftline.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [
    ("getUserData", ["getUserData", "get", "User", "Data"]),
    ("word", ["word", "word"]),
    ("snake_case", ["snake_case", "snake", "case"]),
    ("getUserDataFromAPI", ["getUserDataFromAPI", "get", "User", "Data", "From", "A", "P", "I"]),
    ("x = 3.14;", ["x", "x", "=", "3.14", ";"]),
    ("é _ __a", ["é", "_", "__a", "a"]),
    ("", []),
])
def test_tokens(spark, text, want):
    assert one(spark, tx.code_tokens(F.lit(text))) == want == tx.tokens_of(text)


@pytest.mark.parametrize(("text", "want"), [("function test() {}", "function_code"), ("interface User {}", "type_definition"), ("const x = 5;", "variable_declaration"), ("// this is a comment", "comment_block"), ("plain prose", "mixed_content")])
def test_content_type(spark, text, want):
    assert one(spark, tx.content_type(F.lit(text))) == want


SNIPPET = 'const std = @import("std");\nconst fs = @import("fs");\n  pub fn calculateDistance(a: f32) f32 {\nfunction processData(x) {\n}'


def test_transforms(spark):
    assert one(spark, tx.function_lines(F.lit(SNIPPET))) == ["pub fn calculateDistance(a: f32) f32 {", "function processData(x) {"]
    assert len(one(spark, tx.import_lines(F.lit(SNIPPET)))) == 2
    assert one(spark, tx.transform("generate_summary", F.lit("x" * 300))) == "x" * 200 + "..."
    assert one(spark, tx.transform("compress_text", F.lit("a \t\n b\r c"))) == "a b\r c"
    assert one(spark, tx.transform("refactor_code", F.lit("a"))) == "[refactor_code] a"
    with pytest.raises(ValueError):
        tx.transform("fly", F.lit("a"))


@pytest.mark.parametrize(("path", "want"), [
    ("src/a.py", None), ("plain.txt", None), ("", "InvalidPath"), ("/etc/passwd", "AbsolutePathNotAllowed"), ("C:x", "AbsolutePathNotAllowed"), ("src/../x", "PathTraversalAttempt"), ("src/..", "PathTraversalAttempt"),
    ("..", None), ("a..b", None), ("a\\b", "InvalidPathSeparator"), ("..\\x", "PathTraversalAttempt"), ("data/%2e%2E/x", "EncodedTraversalAttempt"), ("a\0b", "NullByteInPath"), ("other/x", "PathNotInAllowedDirectory"),
])
def test_paths(spark, path, want):
    assert one(spark, tx.path_error(F.lit(path))) == want


def test_languages_and_times(spark):
    assert [one(spark, tx.language_of(F.lit(p))) for p in ("a.ts", "b.tsx", "c.zig", "d", "e.md")] == ["typescript", "typescript", "zig", "unknown", "unknown"]
    now = F.lit("2024-05-01").cast("timestamp")
    assert [one(spark, tx.relative_time(F.lit(s), now)) for s in (5, 120, 7300, 90_000)] == ["Just now", "2m ago", "2h ago", "2024-05-01"]
    assert one(spark, tx.base_name(F.lit("a/b/c.x.jsonl"))) == "c.x"
    assert one(spark, tx.project_of(F.lit("/p/left/x"), ("left", "right"))) == "left"


def test_measures(spark):
    text = "import os\n# note\n\ndef f(x):\n    y = 1\n    if y:\n        pass\nclass A:\n"
    m = one(spark, tx.code_measures(F.lit(text), F.lit("python")))
    assert (m["lines_of_code"], m["function_count"], m["variable_count"], m["import_count"]) == (6, 2, 1, 1)
    assert m["complexity_score"] == pytest.approx(1 + 0.5 + 0.7 + 0.3)


def test_vectors(spark):
    a, b, zero = vectors.vector([1, 0, 0]), vectors.vector([1, 1, 0]), vectors.vector([0, 0, 0])
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(a, zero)) == 0.0 and one(spark, vectors.cosine(a, vectors.vector([1]))) == 0.0
    assert one(spark, vectors.euclidean(a, b)) == 1.0 and one(spark, vectors.euclidean(a, vectors.vector([1]))) == float("inf")
    assert one(spark, vectors.truncate(b, 2)) == [1.0, 1.0] and one(spark, vectors.truncate(b, 9)) == [1.0, 1.0, 0.0]
    h = one(spark, vectors.hash_embedding(F.lit("x"), 8))
    assert len(h) == 8 and all(-1 <= x <= 1 for x in h)
    assert len(one(spark, vectors.text_statistics(F.lit("")))) == 7


def clock(**counts):
    return F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])


def test_clocks(spark):
    a, b, c = clock(x=1, y=2), clock(x=1, y=3), clock(x=2)
    assert one(spark, clocks.happens_before(a, b)) and not one(spark, clocks.happens_before(b, a)) and not one(spark, clocks.happens_before(a, a))
    assert one(spark, clocks.concurrent(a, c)) and one(spark, clocks.concurrent(a, a)) and not one(spark, clocks.concurrent(a, b))
    assert one(spark, clocks.tick(clock(x=1), F.lit("x"))) == {"x": 2} and one(spark, clocks.tick(clock(x=1), F.lit("z"))) == {"x": 1, "z": 1}
    assert one(spark, clocks.merge(a, c)) == {"x": 2, "y": 2}


@pytest.mark.parametrize(("kind", "offset", "text", "want"), [("insert", 2, "XY", "abXYcdef"), ("insert", 99, "Z", "abcdefZ"), ("delete", 1, "12", "adef"), ("delete", 5, "123", "abcde"), ("delete", 9, "1", "abcdef"), ("modify", 4, "WXYZ", "abcdWXYZ"), ("modify", 9, "W", "abcdef"), ("cursor_move", 1, "q", "abcdef")])
def test_edits(spark, kind, offset, text, want):
    from weftline.operators.collaboration import apply_edit

    assert one(spark, clocks.edited(F.lit("abcdef"), F.lit(kind), F.lit(offset), F.lit(text))) == want == apply_edit("abcdef", kind, offset, text)
