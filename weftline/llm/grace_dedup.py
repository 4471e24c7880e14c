"""Exact deduplication by Grace hashing.

1. A pass over 64-bit content hashes finds those that occur more than once. Where their list is small
   (``BROADCAST_KEYS``, counted first) it is broadcast and only records with such a hash are moved;
   otherwise all records are. Either way the result is the same.
2. The moved records are partitioned by their hash, in the order of their identifiers. Hashes of ``hot_copies`` records or
   more are first partitioned by hash and salt, and one record of each content in each part goes on.
3. In each partition complete contents are entered into an open-addressing table. Once the table holds
   ``budget`` bytes it takes no new contents: records that it doesn't hold go to one of 16 spill files by
   further bits of the hash, and each file is treated in the same way, recursively, until all fit. Every
   level takes some contents, so the recursion ends even if all hashes are equal. Spill files lie in the
   shared folder (of a kind that Arrow's file systems can write: file, hdfs, s3, gs) and are deleted once read; a task that is
   run again writes its own.

Nulls and corner cases. A null text has no content: such rows are kept and are duplicates of nothing. Empty
texts are contents like any other. Of rows with equal content the one with the least identifier is kept
(nulls last; among rows that repeat an identifier too, one row). Texts of any length are compared whole.
Identifiers are whole numbers; ``drop_exact_duplicates`` takes any that have an order. An empty
table gives an empty result. Columns beside the identifier and the text are carried, whatever their names, and not compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.storage import col, fresh, materialise, shared_dir

from . import bytewords as bw

BROADCAST_KEYS = 500_000
BUDGET = 64 << 20
HOT_COPIES = 20_000
FAN_OUT = 16


class ContentTable:
    """An open-addressing table with linear probing: content -> number, by hash and then by comparison."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.mask = (1 << 10) - 1
        self.slots = [-1] * (self.mask + 1)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, h: int, content: bytes, may_add: bool = True) -> tuple[int, bool]:
        """(number of the content, whether it is new); number -1 if it is neither there nor may be added."""
        slots, mask = self.slots, self.mask
        at = h & mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return n, False
            at = (at + 1) & mask
        if not may_add or (self.used + len(content) > self.budget and self.contents):
            return -1, False
        n = slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.used += len(content) + 64
        if 2 * len(self.contents) > mask:
            self._grow()
        return n, True

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = slots = [-1] * (self.mask + 1)
        for n, h in enumerate(self.hashes):
            at = h & self.mask
            while slots[at] >= 0:
                at = (at + 1) & self.mask
            slots[at] = n


def _grace(spill_to: str, budget: int, keep_rows: bool):
    """Columns in: hash, content, identifier, then any. Out: the first of each content, or (id, keep id, duplicate)."""

    def child_of(h: np.ndarray, depth: int) -> np.ndarray:
        return (bw.mix(h.view(np.uint64) + np.uint64(depth + 1)) & np.uint64(FAN_OUT - 1)).astype(np.int64)

    def level(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
        table, kept_ids, full = ContentTable(budget), [], False
        files: dict[int, tuple[str, object, object]] = {}
        store, root = None, ""  # opened when the first record is spilled
        try:
            for batch in batches:
                hashes, contents, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                found = np.empty(batch.num_rows, np.int64)
                new = np.zeros(batch.num_rows, bool)
                id_list = ids.to_pylist()
                for i, (h, c) in enumerate(zip(hashes.tolist(), contents)):
                    found[i], new[i] = table.find(h, c.as_buffer().to_pybytes(), not full)
                    if new[i]:
                        kept_ids.append(id_list[i])
                    elif found[i] < 0:
                        full = True
                here = found >= 0
                if keep_rows:
                    out = batch.filter(pa.array(new))
                    yield pa.RecordBatch.from_arrays(out.columns[3:], out.schema.names[3:])
                else:
                    at = np.flatnonzero(here)
                    keeps = pa.array([kept_ids[n] for n in found[at].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(pa.int64()), keeps, pa.array(~new[at]), pa.array(hashes[at])], ["id", "keep_id", "dup", "h"])
                if not here.all():
                    child = np.where(here, -1, child_of(hashes, depth))
                    for c in np.unique(child[~here]).tolist():
                        if store is None:
                            store, root = fs.FileSystem.from_uri(spill_to)
                            store.create_dir(root, recursive=True)
                        if c not in files:
                            path = f"{root}/grace-{uuid.uuid4().hex}"
                            stream = store.open_output_stream(path)
                            files[c] = (path, stream, pa.ipc.new_stream(stream, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                        files[c][2].write_batch(batch.take(pa.array(np.flatnonzero(child == c))))
            del table, kept_ids
            for path, stream, writer in files.values():
                writer.close()
                stream.close()
            for path, _, _ in files.values():
                with store.open_input_stream(path) as stream:
                    yield from level(pa.ipc.open_stream(stream), depth + 1)
                store.delete_file(path)
        except BaseException:  # also when the task is stopped
            for path, stream, _ in files.values():
                try:
                    stream.close()
                    store.delete_file(path)
                except OSError:
                    pass
            raise

    return lambda batches: level(batches, 0)


def _split(docs: DataFrame, id_col: str, text_col: str, broadcast_keys: int, hot_copies: int):
    """(name of the hash, rows that need not move, rows that move, rows of hot hashes with a column salt or None)."""
    h, n, salt = fresh(docs, "content_hash", "copies", "salt")
    hashed = docs.withColumn(h, F.xxhash64(col(text_col)))
    repeated, _ = materialise(hashed.filter(col(text_col).isNotNull()).groupBy(h).agg(F.count("*").alias(n)).filter(F.col(n) > 1), "repeated")
    total, most = repeated.agg(F.count("*"), F.max(n)).first()
    alone, moved = hashed.filter(col(text_col).isNull()), hashed.filter(col(text_col).isNotNull())
    if total <= broadcast_keys:  # 16 bytes each
        alone = alone.unionByName(moved.join(F.broadcast(repeated.select(h)), h, "left_anti"))
        moved = moved.join(F.broadcast(repeated.select(h)), h, "left_semi")
    hot = None
    if (most or 0) >= hot_copies:
        few = repeated.filter(F.col(n) >= hot_copies)
        hot = moved.join(few, h).withColumn(salt, F.pmod(F.xxhash64(col(id_col)), F.ceil(F.col(n) / hot_copies))).drop(n)
        moved = moved.join(few, h, "left_anti")
    return h, alone, moved, hot, salt


def _partitioned(moved: DataFrame, keys: list[str], id_col: str, text_col: str, others: list[str]) -> DataFrame:
    return moved.select(F.col(keys[0]), col(text_col).cast("binary").alias("content"), col(id_col).alias("id"), *[col(c).alias(f"c{i}") for i, c in enumerate(others)], *[F.col(k).alias("salt") for k in keys[1:]]).repartition(F.col(keys[0]), *[F.col("salt") for _ in keys[1:]]).sortWithinPartitions(F.col("id").asc_nulls_last()).drop("salt")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, broadcast_keys: int = BROADCAST_KEYS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(doc_id, keep_id, is_duplicate) for every row: the row kept of those with its content, and whether this is another."""
    bw.bound_batches(docs.sparkSession)
    spill, schema = shared_dir(docs.sparkSession), "id bigint, keep_id bigint, dup boolean, h bigint"
    h, alone, moved, hot, salt = _split(docs, id_col, text_col, broadcast_keys, hot_copies)
    own = col(id_col).cast("bigint")
    whole = alone.select(own.alias("id"), own.alias("keep_id"), F.lit(False).alias("dup"))
    told = _partitioned(moved, [h], id_col, text_col, []).mapInArrow(bw.tidied(_grace(spill, budget, False)), schema)
    whole = whole.unionByName(told.drop("h"))
    if hot is not None:
        parted = _partitioned(hot, [h, salt], id_col, text_col, [])
        local, _ = materialise(parted.mapInArrow(bw.tidied(_grace(spill, budget, False)), schema), "hot-rows")
        firsts = _partitioned(hot, [h, salt], id_col, text_col, [id_col, text_col]).mapInArrow(bw.tidied(_grace(spill, budget, True)), f"c0 {dict(hot.dtypes)[id_col]}, c1 string")
        again = firsts.withColumn("h", F.xxhash64("c1"))
        best = _partitioned(again, ["h"], "c0", "c1", []).mapInArrow(bw.tidied(_grace(spill, budget, False)), schema).select(F.col("h").alias("fh"), F.col("id").alias("fid"), F.col("keep_id").alias("best"), F.col("dup").alias("later"))
        joined = local.join(best, (F.col("h") == F.col("fh")) & F.col("keep_id").eqNullSafe(F.col("fid")))
        whole = whole.unionByName(joined.select("id", F.col("best").alias("keep_id"), (F.col("dup") | F.col("later")).alias("dup")))
    return whole.select(F.col("id").alias("doc_id"), "keep_id", F.col("dup").alias("is_duplicate"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, broadcast_keys: int = BROADCAST_KEYS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``docs`` with one row of each content; its columns as they are."""
    bw.bound_batches(docs.sparkSession)
    spill = shared_dir(docs.sparkSession)
    h, alone, moved, hot, salt = _split(docs, id_col, text_col, broadcast_keys, hot_copies)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    if hot is not None:
        firsts = _partitioned(hot, [h, salt], id_col, text_col, docs.columns).mapInArrow(bw.tidied(_grace(spill, budget, True)), schema)
        moved = moved.unionByName(firsts.toDF(*docs.columns).withColumn(h, F.xxhash64(col(text_col))))
    kept = _partitioned(moved, [h], id_col, text_col, docs.columns).mapInArrow(bw.tidied(_grace(spill, budget, True)), schema)
    return alone.drop(h).union(kept.toDF(*docs.columns))


SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents
"""
