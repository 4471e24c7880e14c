"""Queries over texts, vectors, fused scores and graphs, with their SQL."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import fusion, graph, lexical, vectors
from weftline.sources.tables import EDGES_SQL, as_edges, table

from weftline.storage import file_state, materialise

from .registry import query

ASKED = "estion heor atwh"

_TOKENS = r"""flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9.]*|[^ \t\n\x0B\f\r]'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]')
  THEN list_concat([x], CASE WHEN contains(x, '_') THEN list_filter(string_split(x, '_'), lambda p: p <> '') ELSE regexp_extract_all(x, '^[^A-Z]+|[A-Z][^A-Z]*') END) ELSE [x] END))"""
_KIND = """CASE WHEN contains({0}, 'function') OR contains({0}, 'def ') OR contains({0}, 'fn ') THEN 'function_code'
  WHEN contains({0}, 'interface') OR contains({0}, 'struct') OR contains({0}, 'class') THEN 'type_definition'
  WHEN contains({0}, 'let ') OR contains({0}, 'var ') OR contains({0}, 'const ') THEN 'variable_declaration'
  WHEN contains({0}, '//') OR contains({0}, '/*') OR contains({0}, '#') THEN 'comment_block' ELSE 'mixed_content' END"""
_WEIGHT = "CASE {0} WHEN 'function_code' THEN 3.0 WHEN 'type_definition' THEN 2.5 WHEN 'variable_declaration' THEN 2.0 ELSE 1.0 END"
_INDEX = f"""idx AS MATERIALIZED (SELECT doc_id, tokens, len(tokens) AS length, kind, CAST({_WEIGHT.format("kind")} AS DOUBLE) AS weight FROM
  (SELECT doc_id, {_TOKENS.format("text")} AS tokens, {_KIND.format("text")} AS kind FROM documents WHERE text IS NOT NULL))"""


def _lexical_sql(asked: str, n: int) -> str:
    values = ", ".join(f"('{t}', {k})" for t, k in Counter(tx.tokens_of(asked)).items())
    return f"""{_INDEX},
q(term, times) AS (VALUES {values}),
tf AS (SELECT doc_id, length, weight, term, count(*) AS tf FROM (SELECT doc_id, length, weight, unnest(tokens) AS term FROM idx) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM idx),
found AS (SELECT doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * weight), 6) AS score,
  array_to_string(list_sort(list(term)), ',') AS matching_terms FROM tf JOIN df USING (term) JOIN q USING (term), corpus GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {n})"""


_INDEXES: dict[tuple, lexical.Index] = {}


def _index(spark, d) -> lexical.Index:
    """The stored index of a folder's documents: built once an application, and again if the table is another."""
    key = (spark.sparkContext.applicationId, d, file_state(spark, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = lexical.build_index(table(spark, d, "documents"))
    return _INDEXES[key]


@query(f"WITH {_INDEX} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM idx) GROUP BY doc_id, term")
def bm25_postings(spark, d):
    """All postings of the stored index; the first query over it builds it."""
    return _index(spark, d).postings.select("doc_id", "term", "tf")


@query(f"WITH {_lexical_sql(ASKED, 10)} SELECT * FROM found")
def bm25_top10(spark, d):
    return lexical.search_index(_index(spark, d), ASKED, 10).withColumn("matching_terms", F.array_join("matching_terms", ","))


@query(f"""
WITH {_INDEX},
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, length, weight, term, count(*) AS tf FROM (SELECT doc_id, length, weight, unnest(tokens) AS term FROM idx) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM idx),
scored AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * weight), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored QUALIFY rank <= 5""")
def bm25_batch(spark, d):
    return lexical.batch_search(_index(spark, d), table(spark, d, "benchmark"))


@query(f"""
WITH {_INDEX} SELECT count(*) AS n_docs, CAST(sum(length) AS BIGINT) AS total_terms, round(avg(length), 6) AS avg_length,
  (SELECT count(*) FROM (SELECT DISTINCT unnest(tokens) FROM idx)) AS n_terms FROM idx""")
def bm25_stats(spark, d):
    return lexical.corpus_stats(_index(spark, d))


@query(f"WITH {_INDEX} SELECT doc_id, length AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM idx")
def token_counts(spark, d):
    return lexical.term_counts(table(spark, d, "documents")).select("doc_id", F.col("length").alias("n_tokens"), F.col("n_terms").alias("n_distinct"))


@query(f"WITH {_INDEX} SELECT doc_id, kind AS content_type, weight FROM idx")
def content_type(spark, d):
    return lexical.typed(table(spark, d, "documents")).select("doc_id", "content_type", "weight")


_LINES = "list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9)))"


@query(f"""SELECT doc_id, len(lines) AS n_lines, array_to_string(lines, chr(10)) AS lines FROM (SELECT doc_id, list_filter({_LINES},
  lambda l: contains(l, 'function ') OR contains(l, 'def ') OR contains(l, 'fn ')) AS lines FROM documents)""")
def parse_functions(spark, d):
    found = table(spark, d, "documents").select("doc_id", tx.function_lines(F.col("text")).alias("lines"))
    return found.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("lines"))


@query(f"""SELECT doc_id, len(lines) AS n_lines, array_to_string(lines, chr(10)) AS lines FROM (SELECT doc_id, list_filter({_LINES},
  lambda l: contains(l, 'import ') OR (contains(l, 'const ') AND contains(l, '@import')) OR contains(l, '#include') OR (contains(l, 'from ') AND contains(l, ' import '))) AS lines FROM documents)""")
def extract_imports(spark, d):
    found = table(spark, d, "documents").select("doc_id", tx.import_lines(F.col("text")).alias("lines"))
    return found.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("lines"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS summary FROM documents")
def summary200(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, regexp_replace(text, '[ \\t\\n]+', ' ', 'g') AS output, length(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')) AS n_chars FROM documents")
def compress_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.compress(F.col("text")).alias("output")).withColumn("n_chars", F.length("output"))


@query("SELECT doc_id, '[validate_syntax] ' || text AS output FROM documents")
def transform_passthrough(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.transform("validate_syntax", F.col("text")).alias("output"))


_PATHS = ["src/{}.py", "/abs/{}.c", "src/../{}", "docs\\{}.go", "data/%2e%2E/{}.rs", "other/{}.java", "plain{}.tsx", "C:{}", "tests/..", "..", "user_files/{}.zig", "src/a..b/{}.cpp"]


def _path_column():
    return F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))


_PATH_SQL = "replace(list_extract([" + ", ".join(f"'{p}'" for p in _PATHS) + f"], CAST(p_partkey % {len(_PATHS)} + 1 AS INT)), '{{}}', CAST(p_partkey AS VARCHAR))"


@query(f"""SELECT p_partkey, path, CASE WHEN path = '' THEN 'InvalidPath' WHEN path LIKE '/%' OR path LIKE '_:%' THEN 'AbsolutePathNotAllowed'
  WHEN path LIKE '%../%' OR path LIKE '%/..' THEN 'PathTraversalAttempt' WHEN contains(path, chr(92)) THEN 'InvalidPathSeparator' WHEN lower(path) LIKE '%\\%2e\\%2e%' ESCAPE '\\' THEN 'EncodedTraversalAttempt'
  WHEN contains(path, '/') AND NOT regexp_matches(path, '^(src|tests|docs|data|temp|user_files)/') THEN 'PathNotInAllowedDirectory' END AS error
FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part)""")
def validate_path(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.replace(_path_column(), F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"))
    return rows.withColumn("error", tx.path_error(F.col("path")))


@query(f"""SELECT p_partkey, coalesce(CASE regexp_extract(path, '\\.([a-z]+)$', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGES.items())} END, 'unknown') AS language
FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part)""")
def detect_language(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.replace(_path_column(), F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"))
    return rows.select("p_partkey", tx.language_of(F.col("path")).alias("language"))


_HAS = lambda *w: "(" + " OR ".join(f"contains(l, '{x}')" for x in w) + ")"
_BEG = lambda *w: "(" + " OR ".join(f"starts_with(l, '{x}')" for x in w) + ")"
_JS_FN = "(contains(l, 'function ') OR (contains(l, 'const ') AND contains(l, ' => ')))"
_OTHER_FN = "(contains(l, '(') AND contains(l, ')') AND (contains(l, '{') OR ends_with(rtrim(l, ' '), ':')))"


@query(f"""
WITH lines AS (SELECT doc_id, language, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '//'))) AS l
  FROM (SELECT doc_id, text, list_extract(['javascript', 'python', 'zig', 'go'], CAST(doc_id % 4 + 1 AS INT)) AS language FROM documents)),
marked AS (SELECT *, CAST(CASE language WHEN 'javascript' THEN CAST({_JS_FN} AS INT) WHEN 'python' THEN CAST({_BEG("def ", "async def ")} AS INT) + CAST({_BEG("class ")} AS INT)
    WHEN 'zig' THEN CAST(contains(l, 'fn ') AS INT) + CAST(contains(l, 'pub const ') AND {_HAS("struct", "enum")} AS INT) ELSE CAST({_OTHER_FN} AS INT) END AS BIGINT) AS f,
  CAST(CASE language WHEN 'javascript' THEN {_BEG("var ", "let ", "const ")} WHEN 'python' THEN contains(l, ' = ') AND NOT {_BEG("if ", "for ")} WHEN 'zig' THEN {_BEG("var ", "const ")} AND NOT contains(l, '@import') ELSE contains(l, '=') END AS INT) AS v,
  CAST(CASE language WHEN 'javascript' THEN {_BEG("import ", "require(")} OR (starts_with(l, 'const ') AND contains(l, 'require(')) WHEN 'python' THEN starts_with(l, 'import ') OR (starts_with(l, 'from ') AND contains(l, ' import '))
    WHEN 'zig' THEN starts_with(l, 'const ') AND contains(l, '@import(') ELSE false END AS INT) AS i,
  CASE language WHEN 'javascript' THEN 5 * CAST({_JS_FN} AS INT) + 3 * CAST({_HAS("if ", "for ", "while ", "switch ")} AS INT)
    WHEN 'python' THEN 5 * CAST({_BEG("def ", "async def ")} AS INT) + 7 * CAST({_BEG("class ")} AS INT) + 3 * CAST({_BEG("if ", "for ", "while ", "try:", "except")} AS INT)
    WHEN 'zig' THEN 5 * CAST(contains(l, 'fn ') AS INT) + 4 * CAST(contains(l, 'pub const ') AND {_HAS("struct", "enum")} AS INT) + 3 * CAST({_HAS("if ", "for ", "while ", "switch ")} AS INT)
    ELSE 3 * CAST({_OTHER_FN} AS INT) END AS tenths FROM lines)
SELECT d.doc_id, count(l) AS lines_of_code, CAST(coalesce(sum(f), 0) AS BIGINT) AS function_count, CAST(coalesce(sum(v), 0) AS BIGINT) AS variable_count, CAST(coalesce(sum(i), 0) AS BIGINT) AS import_count,
  round(1.0 + coalesce(sum(tenths), 0) / 10.0, 6) AS complexity_score FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id""")
def code_metrics(spark, d):
    language = F.element_at(F.array(*[F.lit(x) for x in ("javascript", "python", "zig", "go")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", tx.code_measures(F.col("text"), language).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("complexity_score", F.round("complexity_score", 6))


@query("SELECT doc_id, length(text) > 50 AND (contains(text, 'function') OR contains(text, 'class') OR contains(text, 'import') OR contains(text, 'const')) AS embed FROM documents")
def embed_candidates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.worth_embedding(F.col("text")).alias("embed"))


# -- vectors -----

_VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0)"


def _with_example(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.crossJoin(F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("example"))))  # one row


@query(f"WITH {_VECTORS} SELECT id, round(list_cosine_similarity(e, qe), 6) AS similarity, round(1 - round(list_cosine_similarity(e, qe), 6), 6) AS distance FROM v, q ORDER BY similarity DESC, id LIMIT 10")
def knn_top10(spark, d):
    return vectors.like(table(spark, d, "embeddings"), 0, 10)


@query(f"WITH {_VECTORS} SELECT id, round(list_distance(e, qe), 6) AS distance FROM v, q ORDER BY distance, id LIMIT 10")
def knn_euclid(spark, d):
    return vectors.nearest_euclidean(_with_example(spark, d), F.col("example"), 10)


@query(f"""WITH {_VECTORS}, coarse AS (SELECT id, e, qe, round(list_cosine_similarity(e[1:16], qe[1:16]), 6) AS coarse FROM v, q ORDER BY coarse DESC, id LIMIT 50)
SELECT id, coarse, round(list_cosine_similarity(e, qe), 6) AS similarity FROM coarse ORDER BY similarity DESC, id LIMIT 10""")
def knn_matryoshka_rerank(spark, d):
    return vectors.coarse_to_fine(_with_example(spark, d), F.col("example"), 10)


_PAIRS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id)"


def _asked(search, spark, d, *args):
    """Every vector whose number is divisible by 50, against all vectors."""
    rows = table(spark, d, "embeddings")
    return search(rows, *args, queries=rows.filter("vec_id % 50 = 0"))


@query(f"WITH {_PAIRS} SELECT src, dst, similarity, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p QUALIFY rank <= 5")
def knn_graph(spark, d):
    return _asked(vectors.neighbour_graph, spark, d, 5)


@query(f"WITH {_PAIRS} SELECT src, dst, similarity, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p WHERE similarity > 0.2 QUALIFY rank <= 20")
def knn_threshold_pairs(spark, d):
    return _asked(vectors.similar_pairs, spark, d, 0.2, 20)


@query(f"""WITH {_VECTORS}, n AS (SELECT count(*) AS total, min(id) AS least FROM v)
SELECT id, round(list_cosine_similarity(e, qe), 6) AS similarity, round(1 - round(list_cosine_similarity(e, qe), 6), 6) AS distance FROM v, q, n
WHERE total <= 1000 OR (id - least) % greatest(CAST(floor(total / (100 + floor(total / 100))) AS BIGINT), 1) = 0 ORDER BY similarity DESC, id LIMIT 10""")
def knn_modulo_sample(spark, d):
    return vectors.modulo_sample(_with_example(spark, d), F.col("example"), 10)


@query(f"""WITH {_PAIRS}, g AS (SELECT src, dst FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5)
SELECT (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS nodes, count(*) AS links, round(count(*) / (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)), 6) AS avg_links FROM g""")
def knn_graph_stats(spark, d):
    return vectors.graph_stats(_asked(vectors.neighbour_graph, spark, d, 5))


# -- graphs -----

_HOPS = """RECURSIVE {edges}, reach(node, depth) AS (SELECT CAST({seed} AS BIGINT), 0 UNION SELECT l.dst, r.depth + 1 FROM reach r JOIN links l ON l.src = r.node WHERE r.depth < {most}),
hops AS (SELECT node, min(depth) AS distance FROM reach GROUP BY node)"""
_SSSP = """RECURSIVE {edges}, reach(node, dist) AS (SELECT CAST({seed} AS BIGINT), 0.0::DOUBLE UNION SELECT l.dst, r.dist + l.weight FROM reach r JOIN links l ON l.src = r.node WHERE r.dist + l.weight <= {bound}),
best AS (SELECT node, min(dist) AS dist FROM reach GROUP BY node),
paths AS (SELECT b.node, b.dist, CASE WHEN b.dist > 0 THEN min(a.node) END AS pred FROM best b LEFT JOIN links l ON l.dst = b.node LEFT JOIN best a ON a.node = l.src AND a.dist + l.weight = b.dist
  WHERE b.dist = 0 OR a.node IS NOT NULL GROUP BY b.node, b.dist)"""
_WALK = """walk(target, dist, path, head) AS (SELECT node, dist, CAST(node AS VARCHAR), pred FROM paths WHERE {goal}
  UNION ALL SELECT w.target, w.dist, CAST(w.head AS VARCHAR) || '>' || w.path, p.pred FROM walk w JOIN paths p ON p.node = w.head WHERE w.head IS NOT NULL)
SELECT target, dist, path FROM walk WHERE head IS NULL"""
SEED, MOST, BOUND = 1, 3, 12


def _edges(spark, d):
    return as_edges(table(spark, d, "lineitem"))


def _node(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def _path_text(df):
    return df.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=MOST)} SELECT node, distance FROM hops")
def bfs_hops(spark, d):
    return graph.hops(_edges(spark, d), _node(spark, SEED), MOST)


@query(f"WITH {_SSSP.format(edges=EDGES_SQL, seed=SEED, bound=BOUND)} SELECT node, dist, pred FROM paths")
def sssp_bounded(spark, d):
    return graph.shortest_paths(_edges(spark, d), _node(spark, SEED), BOUND)


@query(f"WITH {_SSSP.format(edges=EDGES_SQL, seed=SEED, bound=BOUND)}, {_WALK.format(goal='true')}")
def bounded_paths(spark, d):
    """Shortest paths to all nodes within the bound."""
    return _path_text(graph.multi_target(_edges(spark, d), SEED, graph.nodes_of(_edges(spark, d)), BOUND))


@query()
def shortest_path(spark, d):
    """However far the target is. Recursive SQL would list every walk."""
    return _path_text(graph.shortest_path(_edges(spark, d), SEED, 15))


@query()
def multi_target(spark, d):
    """Shortest paths to all nodes of the graph, however far."""
    edges, _ = materialise(_edges(spark, d), "edges")
    return _path_text(graph.multi_target(edges, SEED, graph.nodes_of(edges)))


@query(f"WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=2)} SELECT node, distance FROM hops")
def reachability(spark, d):
    """All nodes of the graph as targets."""
    edges, _ = materialise(_edges(spark, d), "edges")
    return graph.reachable(edges, _node(spark, SEED), graph.nodes_of(edges), 2)


@query(f"WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=1)} SELECT src, dst, weight FROM links WHERE src IN (SELECT node FROM hops) AND dst IN (SELECT node FROM hops)")
def induced_subgraph(spark, d):
    return graph.dependencies(_edges(spark, d), _node(spark, SEED), 1)


@query(f"""WITH RECURSIVE {EDGES_SQL}, f(node, depth) AS (SELECT CAST({SEED} AS BIGINT), 0 UNION SELECT l.dst, r.depth + 1 FROM f r JOIN links l ON l.src = r.node WHERE r.depth < 2),
b(node, depth) AS (SELECT CAST({SEED} AS BIGINT), 0 UNION SELECT l.src, r.depth + 1 FROM b r JOIN links l ON l.dst = r.node WHERE r.depth < 2)
SELECT node, direction, min(depth) AS distance FROM (SELECT *, 'forward' AS direction FROM f UNION ALL SELECT *, 'backward' FROM b) GROUP BY node, direction HAVING min(depth) > 0""")
def impact_radius(spark, d):
    return graph.impact(_edges(spark, d), _node(spark, SEED), 2)


@query(f"""WITH {EDGES_SQL}, c AS (SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM links UNION SELECT dst FROM links)) AS nodes FROM links)
SELECT nodes, edges, round(edges / nodes, 6) AS avg_degree, round(2 * edges / nodes, 6) AS avg_both, greatest(1, CAST(floor(round(log2(nodes) / 3, 9)) AS INT)) AS k, greatest(1, CAST(floor(round(log2(nodes) * 2 / 3, 9)) AS INT)) AS t,
  edges * pow(log2(nodes), 2/3) < edges + nodes * log2(nodes) AS prefers_frontier,
  CASE WHEN nodes < 100 THEN 1 WHEN nodes < 1000 THEN 2 WHEN nodes < 10000 THEN 3 ELSE least(3, greatest(1, CAST(floor(ln(nodes) * 2 / 3) AS INT))) END AS level,
  greatest(1, CAST(floor(log2(nodes) / greatest(1, floor(round(log2(nodes) * 2 / 3, 9)))) AS INT)) AS depth FROM c""")
def graph_stats(spark, d):
    return graph.stats(_edges(spark, d))


@query("""SELECT p_partkey AS n, greatest(1, CAST(floor(round(log2(p_partkey) / 3, 9)) AS INT)) AS k, greatest(1, CAST(floor(round(log2(p_partkey) * 2 / 3, 9)) AS INT)) AS t,
  CASE WHEN p_partkey <= 1 THEN false ELSE 10 * p_partkey * pow(log2(p_partkey), 2/3) < 10 * p_partkey + p_partkey * log2(p_partkey) END AS prefers FROM part WHERE p_partkey > 0""")
def frontier_parameters(spark, d):
    n = F.col("p_partkey")
    k, t = graph.frontier_parameters(n)
    return table(spark, d, "part").filter("p_partkey > 0").select(n.alias("n"), k.alias("k"), t.alias("t"), graph.prefers_frontier(n, 10 * n).alias("prefers"))


@query(f"""WITH {EDGES_SQL}, nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links), b AS (SELECT src AS node, dst AS other FROM links UNION SELECT dst, src FROM links)
SELECT node, count(*) AS neighbours, round(count(*) / (SELECT count(*) - 1 FROM nodes), 6) AS centrality FROM b GROUP BY node""")
def degree_centrality(spark, d):
    return graph.degree_centrality(_edges(spark, d))


@query(f"WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=2)} SELECT least(count(*), 100) AS size FROM hops")
def subtree_size(spark, d):
    return graph.subtree_size(_edges(spark, d), SEED, 2)


@query(f"""WITH {EDGES_SQL}, dated AS (SELECT src, dst, min(o_orderdate) AS valid_from, CASE WHEN count(*) > 1 THEN max(o_orderdate) END AS valid_to FROM
  (SELECT l_orderkey, l_partkey AS src, l_suppkey AS dst FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY src, dst)
SELECT src, dst, valid_from, valid_to FROM dated WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1997-01-01')""")
def temporal_edges_active(spark, d):
    from weftline.operators.temporal import active

    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    dated = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.min("o_orderdate").alias("valid_from"), F.when(F.count("*") > 1, F.max("o_orderdate")).alias("valid_to"))
    return active(dated, F.expr("timestamp_ntz'1997-01-01 00:00:00'"))


@query()
def synthetic_graph(spark, d):
    return graph.synthetic(spark, 1000, 4, "scale_free")


# -- fusion -----

_LEGS = f"""lex AS (SELECT doc_id, score FROM found), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
vec AS (SELECT a.id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE b.id = 0 ORDER BY similarity DESC, doc_id LIMIT 20)"""


def _lexical_leg(spark, d):
    return lexical.search_index(_index(spark, d), ASKED, 20).select("doc_id", "score")


def _vector_leg(spark, d):
    return vectors.like(table(spark, d, "embeddings"), 0, 20).select(F.col("id").alias("doc_id"), "similarity")


def _graph_leg(spark, d):
    return graph.hops(_edges(spark, d), _node(spark, SEED), 1).select(F.col("node").alias("doc_id"), "distance")


@query(f"""WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=1)}, {_lexical_sql(ASKED, 20)}, {_LEGS},
merged AS (SELECT doc_id, max(score) AS s, max(similarity) AS c, max(distance) AS g FROM (SELECT doc_id, score, NULL AS similarity, NULL AS distance FROM lex UNION ALL SELECT doc_id, NULL, similarity, NULL FROM vec
  UNION ALL SELECT node, NULL, NULL, distance FROM hops) GROUP BY doc_id),
norm AS (SELECT doc_id, round(coalesce(s / greatest((SELECT max(s) FROM merged), 1.0), 0), 6) AS bm25_score, round(coalesce(c, 0), 6) AS vector_score,
  round(CASE WHEN g IS NULL THEN 0 ELSE 1 - g / (SELECT max(g) FROM merged) END, 6) AS graph_score FROM merged)
SELECT *, round(0.4 * bm25_score + 0.4 * vector_score + 0.2 * graph_score, 6) AS combined_score FROM norm ORDER BY combined_score DESC, doc_id LIMIT 10""")
def hybrid_fusion(spark, d):
    return fusion.combine(_lexical_leg(spark, d), _vector_leg(spark, d), _graph_leg(spark, d), fusion.Weights(), 10)


@query(f"""WITH {_lexical_sql(ASKED, 20)}, {_LEGS},
merged AS (SELECT doc_id, max(score) AS s, max(similarity) AS c FROM (SELECT doc_id, score, NULL AS similarity FROM lex UNION ALL SELECT doc_id, NULL, similarity FROM vec) GROUP BY doc_id),
norm AS (SELECT doc_id, round(coalesce(s / greatest((SELECT max(s) FROM merged), 1.0), 0), 6) AS bm25_score, round(coalesce(c, 0), 6) AS vector_score, 0.0 AS graph_score FROM merged)
SELECT *, round(0.7 * bm25_score + 0.2 * vector_score + 0.1 * graph_score, 6) AS combined_score FROM norm ORDER BY combined_score DESC, doc_id LIMIT 10""")
def hybrid_routed(spark, d):
    weights = fusion.Weights.preset("exact")
    run = fusion.route(weights, has_vector=True, has_nodes=False)
    legs = [leg(spark, d) if wanted else None for leg, wanted in zip((_lexical_leg, _vector_leg, _graph_leg), run)]
    return fusion.combine(*legs, weights, 10)


@query(f"""WITH {_HOPS.format(edges=EDGES_SQL, seed=SEED, most=1)}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
vec AS (SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE b.id = 0 ORDER BY similarity DESC, a.id LIMIT 20)
SELECT coalesce(id, node) AS id, similarity, distance, round(CASE WHEN distance IS NOT NULL THEN coalesce(similarity, 0) * 0.7 + 0.3 / (distance + 1) ELSE coalesce(similarity, 0) END, 6) AS score
FROM vec FULL JOIN hops ON id = node ORDER BY score DESC, coalesce(id, node) LIMIT 50""")
def hybrid_merge_rank(spark, d):
    return fusion.merge_rank(_vector_leg(spark, d).withColumnRenamed("doc_id", "id"), _graph_leg(spark, d).withColumnRenamed("doc_id", "id"))
