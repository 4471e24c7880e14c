"""Code-aware BM25 over a table of texts: an inverted index that is stored, and searched without the texts.

Texts are tokenised once, a batch at a time, when the index is built. Its postings (term, doc_id, tf, length, weight)
are split by a hash of the term and sorted, so that a query reads the row groups of its own terms and no text; they
carry what a score takes, so that nothing is joined but one row of corpus statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import TOKEN, content_type, content_weight, parts_of, tokens_of
from weftline.storage import drop_path, materialise, new_path

K1, B = 1.2, 0.75
#: Parts of the postings by hash of the term; a frequent term is split further by hash of the document when written.
BUCKETS, SALTS = 64, 8
CACHE_TOKENS = 200_000
#: Postings of a shard and queries of a block, which are scored together.
SHARD, QUERIES = 1_000_000, 256


def idf(n: Column, df: Column, plus_one: bool = False) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)), negative for terms of most documents; 0 for a term of none."""
    odds = (n - df + 0.5) / (df + 0.5)
    return F.when(df == 0, 0.0).otherwise(F.log(odds + 1 if plus_one else odds))


def tf_weight(tf: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def _counted(only: frozenset[str] | None):
    """Rows (id, text, ...) to (length, different terms, terms, times): of all terms, or of some."""
    find, cache = re.compile(TOKEN).findall, {}

    def terms(text: str) -> tuple[int, Counter]:
        length, out = 0, Counter()
        for token, n in Counter(find(text)).items():
            parts = cache.get(token)
            if parts is None:
                if len(cache) > CACHE_TOKENS:
                    cache.clear()
                parts = cache[token] = parts_of(token)
            length += n * len(parts)
            for part in parts:
                out[part] += n
        return length, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                told = [terms(t) for t in batch.column(1).to_pylist()]
                kept = [c if only is None else Counter({t: c[t] for t in only if c[t]}) for _, c in told]
                columns = [*(batch.column(i) for i in (0, 2, 3)), pa.array([n for n, _ in told], pa.int64()), pa.array([len(c) for _, c in told], pa.int64())]
                columns += [pa.array([list(c) for c in kept], pa.list_(pa.string())), pa.array([list(c.values()) for c in kept], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content_type", "weight", "length", "n_terms", "terms", "tfs"])

    return run


def typed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, content_type, weight) of each text."""
    kind = content_type(F.col(text_col))
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), kind.alias("content_type"), content_weight(kind).alias("weight"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, content_type, weight, length, n_terms, terms, tfs) of each text, tokenised once."""
    rows = typed(docs, id_col, text_col)
    return rows.mapInArrow(_counted(only), f"doc_id {dict(rows.dtypes)['doc_id']}, content_type string, weight double, length bigint, n_terms bigint, terms array<string>, tfs array<bigint>")


def _corpus(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))


def _postings(counted: DataFrame) -> DataFrame:
    pair = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return counted.select("doc_id", "length", "weight", pair).select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").alias("tf"), "length", "weight")


@dataclass(frozen=True)
class Index:
    """A stored index: ``documents`` (doc_id, content_type, weight, length, n_terms), ``postings`` and one row of ``corpus``."""

    documents: DataFrame
    postings: DataFrame
    corpus: DataFrame

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their parts of the table are read."""
        parts = [F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)).cast("int") for t in terms]
        return self.postings.filter(F.col("bucket").isin(*parts) & F.col("term").isin(*terms)) if terms else self.postings.limit(0)


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Tokenise all texts and write the index under ``path``, in the shared folder by default."""
    spark = docs.sparkSession
    path = path or new_path(spark, "lexical")
    counted = term_counts(docs, id_col, text_col)
    counted.write.mode("overwrite").parquet(f"{path}/counts")
    counted = spark.read.parquet(f"{path}/counts")
    counted.drop("terms", "tfs").write.mode("overwrite").parquet(f"{path}/documents")
    _corpus(counted).write.mode("overwrite").parquet(f"{path}/corpus")
    placed = _postings(counted).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    parts = placed.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "doc_id")
    parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    drop_path(spark, f"{path}/counts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    documents, corpus = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "corpus"))
    schema = f"term string, doc_id {dict(documents.dtypes)['doc_id']}, tf bigint, length bigint, weight double, bucket int"
    return Index(documents, spark.read.schema(schema).parquet(f"{path}/postings"), corpus)


def corpus_stats(index: Index) -> DataFrame:
    """One row: documents, distinct terms, all terms, mean length."""
    terms = index.postings.groupBy("term").count().agg(F.count("*").alias("n_terms"))
    told = index.documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_terms"), F.round(F.avg("length"), 6).alias("avg_length"))
    return told.crossJoin(F.broadcast(terms))  # one row


def _best(rows: DataFrame, corpus: DataFrame, terms: Counter, n: int, k1: float, b: float, plus_one: bool) -> DataFrame:
    asked = rows.sparkSession.createDataFrame(sorted(terms.items()), "term string, times bigint")
    df = rows.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(asked), "term").crossJoin(F.broadcast(corpus))  # a row a term of the query
    part = idf(F.col("n_docs"), F.col("df"), plus_one) * tf_weight(F.col("tf"), F.col("length"), F.col("mean"), k1, b) * F.col("weight") * F.col("times")
    found = rows.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matching_terms"))
    return found.orderBy(F.desc("score"), "doc_id").limit(n)


def search_index(index: Index, query: str, n: int = 10, k1: float = K1, b: float = B, plus_one: bool = False) -> DataFrame:
    """(doc_id, score, matching_terms): the ``n`` best documents; every occurrence of a query token counts."""
    terms = Counter(tokens_of(query))
    return _best(index.of_terms(list(terms)).select("term", "doc_id", "tf", "length", "weight"), index.corpus, terms, n, k1, b, plus_one)


def search(docs: DataFrame, query: str, n: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, plus_one: bool = False) -> DataFrame:
    """The same without an index: one pass over the texts writes the counts of the query's terms."""
    terms = Counter(tokens_of(query))
    counted, _ = materialise(term_counts(docs, id_col, text_col, frozenset(terms)), "term-counts")
    return _best(_postings(counted), _corpus(counted), terms, n, k1, b, plus_one)


def _round6(scores: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero as Spark's round has it."""
    return np.array([float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in scores.tolist()], float)


def _ranked(n: int):
    """A shard's postings (doc_id, tid, part, weight) and a block of queries (query_id, asked_tid, idf, times) to the ``n`` best of each query."""

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        ids, who = postings["doc_id"].combine_chunks(), asked["query_id"].combine_chunks()
        docs, first, doc = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        tid = postings["tid"].to_numpy()
        order = np.argsort(tid, kind="stable")
        tid, doc, part, weight = tid[order], doc[order], postings["part"].to_numpy()[order], postings["weight"].to_numpy()[order]
        terms, idf, times = (asked[c].to_numpy() for c in ("asked_tid", "idf", "times"))
        lo, hi = np.searchsorted(tid, terms), np.searchsorted(tid, terms, "right")
        _, start, query = np.unique(who.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        told = []
        for q in range(len(start)):
            mine = [t for t in np.flatnonzero(query == q) if hi[t] > lo[t]]
            if not mine:
                continue
            score, some = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for t in mine:  # a document is once in the postings of a term, unless its identifier repeats
                at = slice(lo[t], hi[t])
                np.add.at(score, doc[at], idf[t] * part[at] * weight[at] * times[t])
                some[doc[at]] = True
            found = np.flatnonzero(some)
            if len(found) > n:  # what rounding may bring among the best is kept until it is rounded
                found = found[score[found] >= np.partition(score[found], -n)[-n] - 2e-6]
            values, back = np.unique(score[found], return_inverse=True)
            best = _round6(values)[back]
            top = np.lexsort((found, -best))[:n]
            told.append((np.full(len(top), start[q]), first[found[top]], best[top]))
        q, d, s = (np.concatenate(v) for v in zip(*told)) if told else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": who.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "score": s})

    return run


def batch_search(index: Index, queries: DataFrame, n: int = 5, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the ``n`` best documents of every query.

    Documents are split into shards, queries into blocks; a shard and a block are a task's unit of work, of which only the best leave it.
    """
    asked, _ = materialise(_postings(term_counts(queries, query_id, query_text)).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("times")), "asked")
    terms, _ = materialise(asked.select("term").distinct().withColumn("tid", F.row_number().over(Window.orderBy("term"))), "terms")
    wanted = index.postings.join(F.broadcast(terms), "term")  # a row a query term
    df, _ = materialise(wanted.groupBy("tid").agg(F.count("*").alias("df")), "df")
    shards = (df.agg(F.sum("df")).first()[0] or 0) // SHARD + 1
    blocks = asked.select("query_id").distinct().count() // QUERIES + 1
    corpus = F.broadcast(index.corpus)  # one row
    weighed = asked.join(terms, "term").join(df, "tid").crossJoin(corpus).select("query_id", F.col("tid").alias("asked_tid"), idf(F.col("n_docs"), F.col("df")).alias("idf"), F.col("times").cast("double").alias("times"))
    parts = wanted.crossJoin(corpus).select("doc_id", "tid", tf_weight(F.col("tf"), F.col("length"), F.col("mean")).alias("part"), "weight", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    left = parts.withColumn("block", each(blocks) if blocks > 1 else F.lit(0).cast("bigint"))
    right = weighed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", each(shards))
    units = min(shards * blocks, 10_000)
    left, right = (x.repartition(units, "shard", "block").groupBy("shard", "block") for x in (left, right))
    kinds = dict(asked.dtypes)["query_id"], dict(index.documents.dtypes)["doc_id"]
    scored = left.cogroup(right).applyInArrow(_ranked(n), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.filter(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")
