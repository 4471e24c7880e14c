"""Substring deduplication with a log-structured index of window hashes.

A passage of at least ``min_words`` words that also stands in an earlier document (one with a lesser
identifier) is a repeat. Documents come in batches of growing identifiers:

1. Hashes of a batch's windows of ``window`` words are taken where they are least among ``min_words - window
   + 1`` neighbours, so that every passage of ``min_words`` words holds one that is taken, wherever it
   stands. Of each hash the first holder goes into a sorted, bucketed, immutable run (an aggregate with a map-side part).
2. The run is merge-joined with each run of the history (both sides are bucketed and sorted alike: no
   exchange, no sort), which tells which hashes documents share, and with whom first.
3. Of documents that share hashes, all runs of ``min_words`` words around a shared hash are hashed whole, those of an
   earlier document once, when a second one comes; each is matched with its own first occurrence, by a second set of such runs in the index. Matches on the same diagonal,
   i.e. at the same distance between their places in both documents, become one candidate segment.
4. Candidates are verified word by word against the text of the document that they name; only common runs of at least
   ``min_words`` words stay.
5. Then the batch's runs join the history; ``fan_in`` runs are compacted into one, which keeps first occurrences.

An index with a path can be opened again by a later session. The work is linear in the windows: a passage that
thousands of documents share is compared with its first occurrence alone, and of that document only the blocks of words
that are asked for move. The result doesn't depend on the number of batches.

Nulls and corner cases. Identifiers are whole numbers (others are an error of the cast). Words are separated by ASCII
white space and compared as they are. Null, empty and short texts (fewer than ``min_words`` words) have no repeats. Rows
with a null identifier neither are nor have repeats. Of rows that repeat an identifier, one text (the least) stands for
the document; rows with that very text are treated alike, others are left as they are. Repeats within one document don't
count. A passage that joins several earlier ones is found piece by piece, each with the document that has it: pieces may
overlap. Windows of a run of one single word repeated are all equal: one stands for them with their number, so that the
whole run is found. An empty table gives an empty result. Other columns are carried when repeats are cut.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import col, drop_path, materialise, new_path, read_text, write_text

from . import bytewords as bw

#: More batches than ``FAN_IN``: the last ones are matched with a compacted run.
MIN_WORDS, WINDOW, BATCHES, FAN_IN = 50, 40, 4, 3
#: Words of a block of an earlier document's text that moves to those who repeat it.
BLOCK_WORDS = 64
WORD = r"[^ \t\n\x0B\f\r]+"


def _anchors(window: int, min_words: int):
    span = min_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in bw.pieces(batch.column(1)):
                starts, ends, first = bw.words(buf, offs)
                at, h = bw.window_hashes(bw.hash_spans(buf, starts, ends), first, window)
                n = len(h) - span + 1
                if n <= 0:
                    continue
                rows = bw.rows_of(first, at)
                least = h[:n].copy()
                for j in range(1, span):
                    np.minimum(least, h[j : j + n], out=least)
                whole = rows[:n] == rows[span - 1 :]
                taken = np.zeros(len(h), bool)
                for j in range(span):
                    taken[j : j + n] |= whole & (least == h[j : j + n])
                taken[1:] &= (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                h, rows = h[taken], rows[taken]
                ids = batch.column(0).take(pa.array(rows + lo))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids], ["h", "id"])

    return run


def _whole(window: int, min_words: int):
    """Rows (id, text, shared hashes) to all runs of ``min_words`` words whose least window hash is a shared one.

    ``n`` equal runs at neighbouring places are one row.
    """
    span = min_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in bw.pieces(batch.column(1)):
                starts, ends, first = bw.words(buf, offs)
                hashes = bw.hash_spans(buf, starts, ends)
                inner_at, inner = bw.window_hashes(hashes, first, window)
                at, h = bw.window_hashes(hashes, first, min_words)
                if not len(at):
                    continue
                begin = np.searchsorted(inner_at, at)
                least = inner[begin]
                for j in range(1, span):
                    np.minimum(least, inner[begin + j], out=least)
                rows = bw.rows_of(first, at)
                lists = batch.column(2).slice(lo, hi - lo)
                shared = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())
                taken = np.isin(bw.mix(least + bw.mix(rows.astype(np.uint64))), bw.mix(shared + bw.mix(owner.astype(np.uint64))))
                at, h, rows = at[taken], h[taken], rows[taken]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
                n = np.diff(np.append(np.flatnonzero(new), len(h)))
                at, h, rows = at[new], h[new], rows[new]
                ids = batch.column(0).take(pa.array(rows + lo))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array((at - first[rows]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "id", "pos", "n"])

    return run


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """While it lasts, scans of bucketed tables with one file a bucket are known to be sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class FingerprintIndex:
    """Sorted immutable runs, oldest first: of window hashes with their first holders, and of whole runs of words.

    With a ``path`` in the shared folder the index stays there and is opened again under it.
    """

    SCHEMAS = {"anchors": "h BIGINT, id BIGINT, hashed BOOLEAN", "whole": "h BIGINT, id BIGINT, pos INT"}

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, min_words: int = MIN_WORDS, fan_in: int = FAN_IN):
        if not 4 < window <= min_words:
            raise ValueError("window must be over 4 and at most min_words")
        self.spark, self.path, self.window, self.min_words, self.fan_in = spark, path, window, min_words, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[tuple[str, str]]] = {"anchors": [], "whole": []}
        self.last: int | None = None
        written = read_text(spark, f"{path}/manifest.json") if path else None
        if written:
            known = json.loads(written)
            if (known["window"], known["min_words"]) != (window, min_words):
                raise ValueError(f"the index under {path} has other windows")
            self.buckets, self.last = known["buckets"], known["last"]
            self.runs = {kind: [(self._opened(kind, p), p) for p in paths] for kind, paths in known["runs"].items()}

    def _opened(self, kind: str, path: str) -> str:
        name = f"weftline_run_{uuid.uuid4().hex}"
        keys = self.SCHEMAS[kind].replace(" BIGINT", "").replace(" INT", "").replace(", hashed BOOLEAN", "")
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMAS[kind]}) USING parquet CLUSTERED BY (h) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, kind: str, first: DataFrame) -> tuple[str, str]:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}" if self.path else new_path(self.spark, "run")
        name, order = f"weftline_run_{uuid.uuid4().hex}", ["h", "id"] if kind == "anchors" else ["h", "id", "pos"]
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:  # else the aggregate has put each bucket in one task
            first = first.repartition(self.buckets, "h")
        first.write.bucketBy(self.buckets, "h").sortBy(*order).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, *runs: tuple[str, str], files: bool = True) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if files:
                drop_path(self.spark, path)

    def add(self, batch: DataFrame, texts: DataFrame) -> tuple[DataFrame, str]:
        """Repeats of a batch of (id, text) rows, and the path where they are written; the batch is in the index then.

        ``texts`` has the batch and all documents before it; where it is bucketed by id, as ``bucketed`` makes it, no text
        moves. An identifier stands once, and is greater than those before.
        """
        least, most = batch.agg(F.min("id"), F.max("id")).first()
        if self.last is not None and least is not None and least <= self.last:
            raise ValueError(f"identifiers of a batch must be greater than {self.last}")
        made: list[str] = []
        names: list[str] = []
        fresh_runs: list[tuple[str, str]] = []

        def kept(df: DataFrame, label: str) -> DataFrame:
            table, path = materialise(df, label)
            made.append(path)
            return table

        def placed(df: DataFrame, *order: str) -> DataFrame:
            """Rows in the buckets of the runs: they move once for all that is done by hash."""
            table, name, path = bucketed(df, *order, n=self.buckets)
            names.append(name)
            made.append(path)
            return table

        try:
            postings = placed(batch.mapInArrow(bw.tidied(_anchors(self.window, self.min_words)), "h bigint, id bigint"), "h", "id")
            with _sorted_buckets(self.spark):
                anchors = self._write("anchors", postings.groupBy("h").agg(F.min("id").alias("id"), (F.min("id") < F.max("id")).alias("hashed")))
                fresh_runs.append(anchors)
                seen = self.spark.table(anchors[0])
                for n, old in enumerate(self.runs["anchors"]):
                    seen = seen.join(self.spark.table(old[0]).select("h", F.col("id").alias(f"o{n}"), F.col("hashed").alias(f"hashed{n}")).hint("merge"), "h", "left")
                before = [F.col(f"o{n}") for n in range(len(self.runs["anchors"]))]
                # the index has the first holder's whole runs since its second holder came
                holders = sum((c.isNotNull().cast("int") for c in before), F.lit(0))
                known = F.coalesce(*[F.when(F.col(f"hashed{n}"), True) for n in range(len(before))], holders > 1)
                shared = kept(seen.filter((holders > 0) | F.col("hashed")).select("h", F.coalesce(*before, F.col("id")).alias("first"), known.alias("known")), "shared")
            asked = postings.join(shared.select("h"), "h", "left_semi").unionByName(shared.filter("NOT known").select("h", F.col("first").alias("id")))
            lists = asked.groupBy("id").agg(F.collect_set("h").alias("hashes"))
            involved = texts.join(lists, "id").select("id", "text", "hashes")
            with _sorted_buckets(self.spark):
                runs = placed(involved.mapInArrow(bw.tidied(_whole(self.window, self.min_words)), "h bigint, id bigint, pos int, n int"), "h", "id", "pos")
                whole = self._write("whole", runs.groupBy("h").agg(F.min(F.struct("id", "pos")).alias("o")).select("h", "o.id", "o.pos"))
                fresh_runs.append(whole)
                seen = self.spark.table(whole[0]).select("h", F.struct("id", "pos").alias("own"))
                for n, old in enumerate(self.runs["whole"]):
                    seen = seen.join(self.spark.table(old[0]).select("h", F.struct("id", "pos").alias(f"o{n}")).hint("merge"), "h", "left")
                first = seen.select("h", F.array_min(F.array_compact(F.array("own", *[f"o{n}" for n in range(len(self.runs["whole"]))]))).alias("o"))
                mine = runs.filter(F.col("id") >= least) if least is not None else runs
                segments = kept(_segments(mine.join(first, "h").filter("o.id < id")), "segments")
                found = materialise(verify(segments, texts, self.min_words), "repeats")
        except BaseException:
            self._drop(*fresh_runs)
            raise
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, *made)
        self.runs["anchors"].append(anchors)
        self.runs["whole"].append(whole)
        self.last = most if most is not None else self.last
        for kind in self.runs:
            if len(self.runs[kind]) >= self.fan_in:
                self.compact(kind)
        self._save()
        return found

    def compact(self, kind: str) -> None:
        """Merge all runs of a kind into one that keeps each hash's first occurrence.

        By merge joins: an aggregate of a union of bucketed tables may be planned without the exchange that it needs, and
        then keeps a row a run.
        """
        old = self.runs[kind]
        value = F.struct("id", "hashed") if kind == "anchors" else F.struct("id", "pos")
        with _sorted_buckets(self.spark):
            merged = self.spark.table(old[0][0]).select("h", value.alias("o0"))
            for n, run in enumerate(old[1:], 1):
                merged = merged.join(self.spark.table(run[0]).select("h", value.alias(f"o{n}")).hint("merge"), "h", "full")
            each = F.array_compact(F.array(*[f"o{n}" for n in range(len(old))]))
            if kind == "anchors":
                hashed = F.exists(each, lambda o: F.coalesce(o["hashed"], F.lit(False))) | (F.size(each) > 1)
                merged = merged.select("h", F.array_min(each)["id"].alias("id"), hashed.alias("hashed"))
            else:
                merged = merged.select("h", F.array_min(each).alias("o")).select("h", "o.id", "o.pos")
            new = self._write(kind, merged)
        self.runs[kind] = [new]
        self._save()
        self._drop(*old)

    def _save(self) -> None:
        if self.path:
            write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"window": self.window, "min_words": self.min_words, "buckets": self.buckets, "last": self.last, "runs": {k: [p for _, p in v] for k, v in self.runs.items()}}))

    def close(self) -> None:
        """Leave the index; its files stay if it has a path."""
        for runs in self.runs.values():
            self._drop(*runs, files=not self.path)
        self.runs = {"anchors": [], "whole": []}


def bucketed(rows: DataFrame, *order: str, n: int | None = None) -> tuple[DataFrame, str, str]:
    """Rows written in sorted buckets by the first column of ``order``, the table's name and path: joins by it move the other side alone."""
    spark = rows.sparkSession
    name, path, n = f"weftline_rows_{uuid.uuid4().hex}", new_path(spark, "buckets"), n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, order[0]).write.bucketBy(n, order[0]).sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def _segments(matched: DataFrame) -> DataFrame:
    """Candidate segments (id, first, diagonal, n, low, high) of matched runs of words."""
    alone = F.when(F.col("n") > 1, F.col("pos")).alias("alone")  # a run of one word is a segment of its own
    return matched.groupBy("id", F.col("o.id").alias("first"), (F.col("pos") - F.col("o.pos")).alias("diagonal"), "n", alone).agg(F.min("pos").alias("low"), F.max("pos").alias("high")).drop("alone")


def _common(own: list[str], theirs: list[str], begin: int, least: int) -> Iterator[tuple[int, int]]:
    """Runs of at least ``least`` equal words of own[begin:] and theirs, as places in own."""
    n = 0
    for j, (x, y) in enumerate(zip(own[begin : begin + len(theirs)], theirs), begin):
        if x == y:
            n += 1
        else:
            if n >= least:
                yield j - n, j
            n = 0
    if n >= least:
        end = min(begin + len(theirs), len(own))
        yield end - n, end


def _verify(min_words: int):
    """Rows (id, text hash, text, blocks of the other documents' words) to verified runs."""
    word = re.compile(WORD)
    key = lambda s: (s["first"], s["diagonal"], s["low"], s["n"])

    def told(row: dict) -> Iterator[tuple]:
        spans = [m.span() for m in word.finditer(row["text"])]
        own = [row["text"][a:b] for a, b in spans]
        runs: list[tuple[int, int, int]] = []  # first document, start, end
        for (first, diagonal, low, n), blocks in itertools.groupby(sorted(row["blocks"], key=lambda s: (*key(s), s["block"])), key):
            blocks = list(blocks)
            theirs = [w for b in blocks for w in b["words"].split(" ")]
            skip = low - diagonal - BLOCK_WORDS * blocks[0]["block"]
            theirs = theirs[skip : skip + blocks[0]["high"] - low + min_words]
            if n > 1 and len(set(theirs)) == 1:
                theirs = [theirs[0]] * (min_words + n - 1)
            runs += [(first, a, b) for a, b in _common(own, theirs, low, min_words)]
        merged: list[list[int]] = []
        for first, a, b in sorted(runs):
            if merged and merged[-1][0] == first and a <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([first, a, b])
        for first, a, b in merged:
            yield row["id"], row["text_hash"], first, a, b, spans[a][0], spans[b - 1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = [x for row in batch.slice(lo, 200).to_pylist() for x in told(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["id", "text_hash", "first", "start_word", "end_word", "start_char", "end_char"])

    return run


def verify(segments: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Verified repeats of candidate segments: (id, text_hash, first, start_word, end_word, start_char, end_char).

    ``texts`` has (id, text), an id once, of all documents named. Blocks of an earlier document's words are cut out
    once and joined with the segments that ask for them, then compared with the words of the later one.
    """
    begin, end = F.col("low") - F.col("diagonal"), F.col("high") - F.col("diagonal") + min_words - 1
    block = lambda c: F.floor(c / BLOCK_WORDS).cast("int")
    asked = segments.withColumn("block", F.explode(F.sequence(block(begin), block(end))))
    needed = asked.groupBy("first").agg(F.array_sort(F.collect_set("block")).alias("needed")).withColumnRenamed("first", "id")
    words = texts.join(needed, "id").select("id", "needed", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    cut = F.transform("needed", lambda b: F.struct(b.alias("block"), F.array_join(F.slice("w", b * BLOCK_WORDS + 1, BLOCK_WORDS), " ").alias("words")))
    blocks = words.select(F.col("id").alias("first"), F.explode(cut).alias("b")).select("first", "b.block", "b.words")
    told = asked.join(blocks, ["first", "block"])
    per_doc = told.groupBy("id").agg(F.collect_list(F.struct("first", "diagonal", "low", "high", "n", "block", "words")).alias("blocks"))
    later = texts.join(per_doc, "id").select("id", F.xxhash64("text").alias("text_hash"), "text", "blocks")
    return later.mapInArrow(bw.tidied(_verify(min_words)), "id bigint, text_hash bigint, first bigint, start_word bigint, end_word bigint, start_char bigint, end_char bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_words: int = MIN_WORDS, window: int = WINDOW, fan_in: int = FAN_IN, placed: bool = False) -> DataFrame:
    """All repeats, documents being added in ``batches`` batches of about equal size in the order of their identifiers.

    ``placed``: ``docs`` is a table in buckets by its identifiers, which are whole numbers; it is read as it is.
    """
    bw.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    number = col(id_col) if placed else col(id_col).cast("bigint")
    texts = docs.select(number.alias("id"), col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    ids = texts.groupBy("id").count()
    low, high, most, inner = ids.agg(F.min("id"), F.max("id"), F.max("count"), F.percentile_approx("id", [(n + 1) / batches for n in range(batches - 1)] or [1.0])).first()
    if (most or 0) > 1:
        placed = False
        often = ids.filter("count > 1").select("id")
        texts = texts.join(often, "id", "left_anti").unionByName(texts.join(often, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    if low is None:
        return spark.createDataFrame([], "id bigint, text_hash bigint, first bigint, start_word bigint, end_word bigint, start_char bigint, end_char bigint")
    cuts = sorted({*(inner if batches > 1 else []), high})
    index = FingerprintIndex(spark, None, window, min_words, fan_in)
    name = path = None
    if not placed:
        texts, name, path = bucketed(texts, "id")
    parts = []
    try:
        for before, upto in zip([low - 1, *cuts], cuts):
            parts.append(index.add(texts.filter((F.col("id") > before) & (F.col("id") <= upto)), texts.filter(F.col("id") <= upto)))
    finally:
        index.close()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(spark, path)
    found = parts[0][0]
    for part, _ in parts[1:]:
        found = found.unionByName(part)
    return found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, first_doc_id, start_word, end_word, n_words): stretches of words in passages that the earlier document has.

    Each passage names the first document that has it; stretches of different documents may overlap.
    """
    found = repeats(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias("doc_id"), F.col("first").alias("first_doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _cut(names: list[str], text: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            done = []
            for t, spans in zip(columns[text].to_pylist(), batch.column(len(names)).to_pylist()):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["start_char"]):
                    if s["start_char"] > at:
                        parts.append(t[at : s["start_char"]])
                    at = max(at, s["end_char"])
                done.append("".join([*parts, t[at:]]).strip())
            columns[text] = pa.array(done, pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in done], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([bool(t) for t in done], pa.bool_()))

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options: int) -> DataFrame:
    """``docs`` with repeats cut out of the later texts; a document of which nothing is left goes. Its columns as they are.

    Documents move once, into buckets by their identifiers, which the search and the result read. Those without an identifier don't move.
    """
    bw.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    rows = docs.select(col(id_col).cast("bigint").alias("id"), *[col(c).alias(n) for c, n in zip(docs.columns, names)])
    kept, name, _ = bucketed(rows.filter("id IS NOT NULL"), "id")
    found = repeats(kept, "id", names[text], placed=True, **options)
    lists, _ = materialise(found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start_char", "end_char")).alias("spans")), "cuts")
    joined = kept.join(lists.hint("shuffle_hash"), "id", "left")  # whatever the size of the lists, no document moves
    spark.sql(f"DROP TABLE {name}")  # its files stay: the result reads them
    cut = F.coalesce(F.xxhash64(names[text]) == F.col("text_hash"), F.lit(False))
    touched = joined.filter(cut).select(*names, "spans")
    after = touched.mapInArrow(bw.tidied(_cut(names, text, chars)), touched.drop("spans").schema)
    whole = joined.filter(~cut).select(*names).unionByName(rows.filter("id IS NULL").select(*names))
    return whole.unionByName(after).toDF(*docs.columns)
