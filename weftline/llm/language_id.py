"""Language identification by words first, backing off to character n-grams.

A known word counts by its log frequency in each language. An unseen word falls back to its character
4-grams, then 3-grams, 2-grams and single characters: the first length of which any n-gram is known gives
the mean log frequency of the known ones. A document's language is the one with the highest sum; its score
and its margin over the second are means per word, in thousandths of a nat. All scores are whole numbers, so
that sums don't depend on their order.

The model is fitted on a bounded sample of labelled rows: ``train_docs`` documents of each language, those
with the least MD5 of their identifier. The bound fixes the size of the tables sent to the workers.

A document is accepted unless it has no scored words, its margin is below ``min_margin``, or more than half
of its words are foreign: not even a 3-gram of theirs is known.

Nulls and corner cases. A null, empty or wordless text gives ``pred_lang`` 'und' with null scores, not
accepted. Rows with a null language or text teach nothing. Ties go to the first language by name. With one
language the margin is null and does not reject; with no labelled row nothing is accepted. Rows that repeat
an identifier are judged each on its own; null identifiers are carried, and identifiers of any type. Other
columns are carried by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import col, drop_path, materialise

from . import bytewords as bw

TRAIN_DOCS, MIN_COUNT, LONGEST, MIN_MARGIN = 2000, 2, 4, 30
FOREIGN_BELOW = 3
WORD = r"\p{L}+"
CACHE_WORDS = 100_000


def _score(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """Thousandths of a nat, by add-one smoothing. ``count`` is kinds x languages."""
    return np.floor(1000 * np.log((count + 1) / (total + kinds)[None, :]) + 0.5).astype(np.int64)


def _table(counts: pa.Table, key: str, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The keys of (lang, key, n) rows, and their scores in each language."""
    if not counts.num_rows:
        return pa.array([], pa.string()), np.zeros((0, len(langs)), np.int64)
    keys = counts[key].combine_chunks().dictionary_encode()
    lang = pc.index_in(counts["lang"], value_set=pa.array(langs, pa.string()))
    table = np.zeros((len(keys.dictionary), len(langs)), np.int64)
    table[keys.indices.to_numpy(), lang.to_numpy()] = counts["n"].to_numpy()
    return keys.dictionary, _score(table, table.sum(axis=0), len(table))


class Model:
    """Log frequencies of words and of n-grams in each language."""

    def __init__(self, words: pa.Table, grams: pa.Table, longest: int = LONGEST):
        """``words`` has (lang, word, n) of the known words, ``grams`` (lang, g, gram, n) of all training words."""
        self.langs = sorted({*pc.unique(grams["lang"]).to_pylist(), *pc.unique(words["lang"]).to_pylist()})
        self.longest = longest
        self.words, self.word_scores = _table(words, "word", self.langs)
        self.grams: list[dict[str, np.ndarray]] = []
        for g in range(1, longest + 1):
            keys, scores = _table(grams.filter(pc.equal(grams["g"], g)), "gram", self.langs)
            self.grams.append(dict(zip(keys.to_pylist(), scores)))

    def unseen(self, word: str) -> tuple[np.ndarray, int]:
        """(scores, length of the n-grams that gave them) of a word that isn't known; length 0 if none is."""
        padded = f"_{word}_"
        for n in range(self.longest, 0, -1):
            table = self.grams[n - 1]
            known = [s for j in range(len(padded) - n + 1) if (s := table.get(padded[j : j + n])) is not None]
            if known:
                return np.sum(known, axis=0) // len(known), n
        return np.zeros(len(self.langs), np.int64), 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, min_count: int = MIN_COUNT, longest: int = LONGEST) -> Model:
    """Fit on ``train_docs`` labelled documents of each language."""
    named = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("id").cast("string")), "id")
    chosen, path = materialise(named.select("lang", "id").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= train_docs).select("lang", "id").distinct(), "train-ids")
    found = named.join(F.broadcast(chosen), ["lang", "id"], "left_semi").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counts, counts_path = materialise(found.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    known = counts.join(counts.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_count).select("word"), "word", "left_semi")
    padded = counts.select("lang", "n", F.concat(F.lit("_"), "word", F.lit("_")).alias("p"))
    grams = (
        padded.select("lang", "n", "p", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("g"))
        .filter(F.length("p") >= F.col("g"))
        .select("lang", "n", "g", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - F.col("g") + 1), lambda i: F.substring(F.col("p"), i, F.col("g")))).alias("gram"))
        .groupBy("lang", "g", "gram")
        .agg(F.sum("n").alias("n"))
    )
    model = Model(known.select("lang", "word", "n").toArrow(), grams.toArrow(), longest)
    drop_path(docs.sparkSession, path, counts_path)
    return model


def _classify(model: Model):
    known_scores = model.word_scores
    k = len(model.langs)
    cache: dict[str, int] = {}
    rows: list[np.ndarray] = []  # of cached unseen words: scores, then 1 if scored, 1 if foreign

    def lookup(unique: pa.Array) -> np.ndarray:
        """For each word: scores by language, whether it is scored, whether it is foreign."""
        out = np.zeros((len(unique), k + 2), np.int64)
        at = pc.index_in(unique, value_set=model.words)
        hit = np.asarray(at.is_valid())
        out[hit, :k] = known_scores[at.drop_null().to_numpy()]
        out[hit, k] = 1
        if len(cache) > CACHE_WORDS:
            cache.clear()
            rows.clear()
        for i, word in zip(np.flatnonzero(~hit).tolist(), unique.filter(pa.array(~hit)).to_pylist()):
            n = cache.get(word)
            if n is None:
                scores, length = model.unseen(word)
                n = cache[word] = len(rows)
                rows.append(np.concatenate([scores, [length > 0, length < FOREIGN_BELOW]]).astype(np.int64))
            out[i] = rows[n]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lists = batch.column(1)
                count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                encoded = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(batch.num_rows), count)
                table = lookup(encoded.dictionary)
                codes = encoded.indices.to_numpy()
                sums = np.stack([np.bincount(row, weights=table[codes, j], minlength=batch.num_rows) for j in range(k + 2)], axis=1).astype(np.int64)
                scored, foreign = sums[:, k], sums[:, k + 1]
                has = scored > 0
                n = np.maximum(scored, 1)
                best = np.argmax(sums[:, :k], axis=1) if k else np.zeros(batch.num_rows, np.int64)
                top = sums[np.arange(batch.num_rows), best] if k else n
                second = np.partition(sums[:, :k], k - 2, axis=1)[:, k - 2] if k > 1 else top
                langs = pa.array([*model.langs, "und"], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[2:],
                        langs.take(pa.array(np.where(has & (k > 0), best, k))),
                        pa.array(top // n, pa.int64(), mask=~has),
                        pa.array((top - second) // n, pa.int64(), mask=~has | (k < 2)),
                        pa.array(count),
                        pa.array(foreign),
                    ],
                    [*batch.schema.names[2:], "pred", "score", "margin", "words", "foreign"],
                )

    return run


def _judged(docs: DataFrame, model: Model, text_col: str, carried: dict[str, str]) -> DataFrame:
    """``carried`` columns (new name -> name), then pred, score, margin, words, foreign."""
    lists = docs.select(F.lit(0).alias("none"), F.regexp_extract_all(F.lower(col(text_col)), F.lit(WORD), F.lit(0)).alias("list"), *[col(c).alias(new) for new, c in carried.items()])
    types = dict(lists.dtypes)
    schema = ", ".join(f"{new} {types[new]}" for new in carried) + ", pred string, score bigint, margin bigint, words bigint, foreign bigint"
    return lists.mapInArrow(bw.tidied(_classify(model)), schema)


def _accepted(min_margin: int) -> F.Column:
    return (F.col("pred") != "und") & (F.coalesce(F.col("margin"), F.lit(min_margin)) >= min_margin) & (2 * F.col("foreign") <= F.col("words"))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: int = MIN_MARGIN) -> DataFrame:
    """(doc_id, pred_lang, score, margin, n_words, accepted) for every row; fitted on ``docs`` unless a model is given."""
    bw.bound_batches(docs.sparkSession)
    model = model or train(docs, id_col, text_col, lang_col)
    judged = _judged(docs, model, text_col, {"id": id_col})
    return judged.select(F.col("id").alias("doc_id"), F.col("pred").alias("pred_lang"), "score", "margin", F.col("words").alias("n_words"), _accepted(min_margin).alias("accepted"))


def accepted_documents(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: int = MIN_MARGIN) -> DataFrame:
    """``docs`` without those whose language is not recognised; its columns as they are."""
    bw.bound_batches(docs.sparkSession)
    model = model or train(docs, id_col, text_col, lang_col)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    kept = _judged(docs, model, text_col, names).filter(_accepted(min_margin)).select(*names)
    return kept.toDF(*docs.columns)


SQL = rf"""
WITH sampled AS (
  SELECT lang, text FROM (
    SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k
    FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL) WHERE k <= {TRAIN_DOCS}),
counts AS (
  SELECT lang, word, count(*) AS n FROM (
    SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM sampled) GROUP BY lang, word),
langs AS (SELECT DISTINCT lang FROM counts),
known AS (SELECT word FROM counts GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
word_totals AS (SELECT lang, sum(n) AS total FROM counts WHERE word IN (SELECT word FROM known) GROUP BY lang),
word_scores AS (
  SELECT k.word, l.lang, CAST(floor(1000 * ln((coalesce(c.n, 0) + 1) / (t.total + (SELECT count(*) FROM known))) + 0.5) AS BIGINT) AS s
  FROM known k CROSS JOIN langs l JOIN word_totals t ON t.lang = l.lang LEFT JOIN counts c ON c.word = k.word AND c.lang = l.lang),
gram_rows AS (
  SELECT lang, g, substr('_' || word || '_', CAST(i AS BIGINT), CAST(g AS BIGINT)) AS gram, n
  FROM (SELECT lang, word, n, g, unnest(range(1, length(word) + 4 - g)) AS i FROM counts CROSS JOIN range(1, {LONGEST + 1}) AS r(g))),
gram_counts AS (SELECT lang, g, gram, sum(n) AS n FROM gram_rows GROUP BY lang, g, gram),
gram_kinds AS (SELECT g, count(DISTINCT gram) AS kinds FROM gram_counts GROUP BY g),
gram_totals AS (SELECT lang, g, sum(n) AS total FROM gram_counts GROUP BY lang, g),
gram_scores AS (
  SELECT a.g, a.gram, l.lang, CAST(floor(1000 * ln((coalesce(c.n, 0) + 1) / (t.total + k.kinds)) + 0.5) AS BIGINT) AS s
  FROM (SELECT DISTINCT g, gram FROM gram_counts) a CROSS JOIN langs l
  JOIN gram_totals t ON t.lang = l.lang AND t.g = a.g JOIN gram_kinds k ON k.g = a.g
  LEFT JOIN gram_counts c ON c.lang = l.lang AND c.g = a.g AND c.gram = a.gram),
doc_words AS (
  SELECT row, word, count(*) AS n FROM (
    SELECT row, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM (SELECT row_number() OVER () AS row, text FROM documents))
  GROUP BY row, word),
unseen AS (SELECT DISTINCT word FROM doc_words WHERE word NOT IN (SELECT word FROM known)),
unseen_grams AS (
  SELECT word, g, substr('_' || word || '_', CAST(i AS BIGINT), CAST(g AS BIGINT)) AS gram
  FROM (SELECT word, g, unnest(range(1, length(word) + 4 - g)) AS i FROM unseen CROSS JOIN range(1, {LONGEST + 1}) AS r(g))),
backed AS (
  SELECT u.word, s.lang, u.g, CAST(floor(sum(s.s) / count(*)) AS BIGINT) AS s
  FROM unseen_grams u JOIN gram_scores s ON s.g = u.g AND s.gram = u.gram GROUP BY u.word, s.lang, u.g),
scores AS (
  SELECT word, lang, s, {LONGEST} AS g FROM word_scores
  UNION ALL
  SELECT word, lang, s, g FROM backed QUALIFY g = max(g) OVER (PARTITION BY word)),
sums AS (
  SELECT row, lang, sum(d.n * s.s) AS total, sum(d.n) AS scored, sum(CASE WHEN s.g < {FOREIGN_BELOW} THEN d.n ELSE 0 END) AS foreign_words
  FROM doc_words d JOIN scores s ON s.word = d.word GROUP BY row, lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY total DESC, lang) AS r FROM sums),
best AS (
  SELECT a.row, a.lang, a.total, a.scored, b.total AS second FROM ranked a LEFT JOIN ranked b ON b.row = a.row AND b.r = 2 WHERE a.r = 1),
counted AS (SELECT row, sum(n) AS words FROM doc_words GROUP BY row),
foreigners AS (
  SELECT d.row, sum(d.n) AS foreign_words FROM doc_words d LEFT JOIN (SELECT DISTINCT word, g FROM scores) s ON s.word = d.word
  WHERE s.word IS NULL OR s.g < {FOREIGN_BELOW} GROUP BY d.row),
told AS (
  SELECT d.doc_id, coalesce(b.lang, 'und') AS pred_lang, CAST(floor(b.total / b.scored) AS BIGINT) AS score,
         CAST(floor((b.total - b.second) / b.scored) AS BIGINT) AS margin, CAST(coalesce(c.words, 0) AS BIGINT) AS n_words, coalesce(f.foreign_words, 0) AS fw
  FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d
  LEFT JOIN best b ON b.row = d.row LEFT JOIN counted c ON c.row = d.row LEFT JOIN foreigners f ON f.row = d.row)
SELECT doc_id, pred_lang, score, margin, n_words,
       pred_lang <> 'und' AND coalesce(margin, {MIN_MARGIN}) >= {MIN_MARGIN} AND 2 * fw <= n_words AS accepted
FROM told
"""
