"""Column functions over source code and prose: tokens, kinds of content, line scans, path checks, code measures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
TOKEN = IDENTIFIER + r"|[0-9][0-9.]*|[^ \t\n\x0B\f\r]"
CAMEL = r"^[^A-Z]+|[A-Z][^A-Z]*"

CONTENT_WEIGHTS = {"function_code": 3.0, "type_definition": 2.5, "variable_declaration": 2.0, "comment_block": 1.0, "mixed_content": 1.0}
PATH_PREFIXES = ("src/", "tests/", "docs/", "data/", "temp/", "user_files/")
LANGUAGES = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "zig": "zig", "c": "c", "cpp": "cpp", "rs": "rust", "go": "go", "java": "java"}


def _any(text: Column, *needles: str) -> Column:
    out = text.contains(needles[0])
    for needle in needles[1:]:
        out = out | text.contains(needle)
    return out


def _starts(text: Column, *prefixes: str) -> Column:
    out = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        out = out | text.startswith(prefix)
    return out


# -- tokens -----


def code_tokens(text: Column) -> Column:
    """Identifiers with their parts, numbers, and every other character that isn't white space.

    An identifier comes first as a whole, then by its underscore parts or else by its camel-case parts, so a
    plain word comes twice. Null gives null.
    """

    def expand(token: Column) -> Column:
        snake = F.filter(F.split(token, "_"), lambda p: p != "")
        camel = F.regexp_extract_all(token, F.lit(CAMEL), F.lit(0))
        return F.when(token.rlike("^[A-Za-z_]"), F.concat(F.array(token), F.when(token.contains("_"), snake).otherwise(camel))).otherwise(F.array(token))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), expand))


def tokens_of(text: str) -> list[str]:
    """The same of one Python string: for queries, which are known when the plan is made."""
    return [part for token in re.findall(TOKEN, text) for part in parts_of(token)]


def parts_of(token: str) -> list[str]:
    """A token and, of an identifier, its parts."""
    if not re.match("[A-Za-z_]", token):
        return [token]
    return [token, *([p for p in token.split("_") if p] if "_" in token else re.findall(CAMEL, token))]


def content_type(text: Column) -> Column:
    """The first of five kinds whose marks the text has."""
    return (
        F.when(_any(text, "function", "def ", "fn "), "function_code")
        .when(_any(text, "interface", "struct", "class"), "type_definition")
        .when(_any(text, "let ", "var ", "const "), "variable_declaration")
        .when(_any(text, "//", "/*", "#"), "comment_block")
        .otherwise("mixed_content")
    )


def content_weight(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in CONTENT_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


# -- transformations of a text -----


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t")))


def function_lines(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: _any(x, "function ", "def ", "fn "))


def import_lines(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: x.contains("import ") | (x.contains("const ") & x.contains("@import")) | x.contains("#include") | (x.contains("from ") & x.contains(" import ")))


def summary(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def preview(text: Column, most: int, cut: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)


def compress(text: Column) -> Column:
    """Runs of spaces, tabs and newlines become one space."""
    return F.regexp_replace(text, "[ \t\n]+", " ")


TRANSFORMS = {
    "parse_functions": lambda x: F.to_json(function_lines(x)),
    "extract_imports": lambda x: F.to_json(import_lines(x)),
    "generate_summary": summary,
    "compress_text": compress,
}
PASSED_THROUGH = ("validate_syntax", "generate_tests", "refactor_code", "analyze_complexity", "extract_documentation")


def transform(operation: str, text: Column) -> Column:
    """One of nine operations; five of them only mark the text with their name."""
    if operation in TRANSFORMS:
        return TRANSFORMS[operation](text)
    if operation not in PASSED_THROUGH:
        raise ValueError(f"unknown operation {operation!r}")
    return F.concat(F.lit(f"[{operation}] "), text)


# -- paths -----


def path_error(path: Column) -> Column:
    """Why a path isn't allowed; null if it is. The checks go from left to right, as a scanner's would."""
    signs = {"traversal": r"\.\.[/\\]|(?<=/)\.\.$", "separator": r"\\", "encoded": "%2[eE]%2[eE]", "null": "\x00"}
    where = {name: F.regexp_instr(path, F.lit(f"(?s){sign}")) for name, sign in signs.items()}
    at = {name: F.when(w > 0, w) for name, w in where.items()}
    first = F.least(*at.values())
    return (
        F.when(path.isNull() | (path == ""), "InvalidPath")
        .when(path.startswith("/") | (F.substring(path, 2, 1) == ":"), "AbsolutePathNotAllowed")
        .when(at["traversal"] == first, "PathTraversalAttempt")
        .when(at["separator"] == first, "InvalidPathSeparator")
        .when(at["encoded"] == first, "EncodedTraversalAttempt")
        .when(at["null"] == first, "NullByteInPath")
        .when(path.contains("/") & ~_starts(path, *PATH_PREFIXES), "PathNotInAllowedDirectory")
    )


def language_of(path: Column) -> Column:
    """The language that a file's extension stands for."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.regexp_extract(path, r"\.([a-z]+)$", 1)], F.lit("unknown"))


def worth_embedding(text: Column) -> Column:
    return (F.length(text) > 50) & _any(text, "function", "class", "import", "const")


def node_of(path: Column) -> Column:
    return F.xxhash64(path)


def project_of(path: Column, projects: tuple[str, ...]) -> Column:
    """The first of the projects that the path names."""
    return F.coalesce(*[F.when(path.contains(p), p) for p in projects], F.lit("unknown")) if projects else F.lit("unknown")


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def relative_time(seconds: Column, at: Column) -> Column:
    """How long ago, in words; the date beyond a day."""
    return (
        F.when(seconds < 60, "Just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


# -- code measures -----


def _line_rules(x: Column, language: Column) -> dict[str, Column]:
    """What a code line counts for, in tenths of complexity, by language."""
    script, python, zig = language.isin("javascript", "typescript"), language == "python", language == "zig"
    n = lambda c: F.when(c, 1).otherwise(0)
    branch = n(_any(x, "if ", "for ", "while ", "switch "))
    js_function = n(x.contains("function ") | (x.contains("const ") & x.contains(" => ")))
    py_def, py_class = n(_starts(x, "def ", "async def ")), n(x.startswith("class "))
    zig_fn, zig_type = n(x.contains("fn ")), n(x.contains("pub const ") & _any(x, "struct", "enum"))
    other = n(x.contains("(") & x.contains(")") & (x.contains("{") | F.rtrim(x).endswith(":")))
    pick = lambda js, py, zg, rest: F.when(script, js).when(python, py).when(zig, zg).otherwise(rest)
    return {
        "functions": pick(js_function, py_def + py_class, zig_fn + zig_type, other),
        "variables": pick(n(_starts(x, "var ", "let ", "const ")), n(x.contains(" = ") & ~_starts(x, "if ", "for ")), n(_starts(x, "var ", "const ") & ~x.contains("@import")), n(x.contains("="))),
        "imports": pick(n(_starts(x, "import ", "require(") | (x.startswith("const ") & x.contains("require("))), n(x.startswith("import ") | (x.startswith("from ") & x.contains(" import "))), n(x.startswith("const ") & x.contains("@import(")), F.lit(0)),
        "tenths": pick(5 * js_function + 3 * branch, 5 * py_def + 7 * py_class + 3 * n(_starts(x, "if ", "for ", "while ", "try:", "except")), 5 * zig_fn + 4 * zig_type + 3 * branch, 3 * other),
    }


def code_measures(text: Column, language: Column) -> Column:
    """A struct of lines of code, functions, variables, imports and complexity. No row leaves its place."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~_starts(x, "#", "//"))

    def total(name: str) -> Column:
        return F.aggregate(lines, F.lit(0), lambda s, x: s + _line_rules(x, language)[name])

    return F.struct(
        F.size(lines).alias("lines_of_code"),
        total("functions").alias("function_count"),
        total("variables").alias("variable_count"),
        total("imports").alias("import_count"),
        (F.lit(1.0) + total("tenths") / 10).alias("complexity_score"),
    )


def message(kind: str, *fields: Column) -> Column:
    """A typed event as JSON: the kind, then the named fields."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *fields))
