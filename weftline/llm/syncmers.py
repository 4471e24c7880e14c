"""Document fingerprints: closed syncmers of words.

A run of ``k`` words is chosen if the least hash of its runs of ``s`` words is that of the first or the last
of them. Whether it is chosen depends on its own words alone, so a passage has the same anchors wherever it
stands, and anchors at the same distance in two documents match them by position. Every ``k - s + 1``
consecutive runs hold a chosen one, about 2 in ``k - s + 1`` are.

Words are runs of letters and digits, in lower case. One pass over the texts; no row moves.

Nulls and corner cases. Null, empty and short texts (fewer than ``k`` words) have no anchors: empty lists. Of
equal least hashes any counts, so all runs of one repeated word are chosen. Null identifiers, rows that repeat
one and other columns don't matter: rows are looked at each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col

from . import bytewords as bw

K, S = 12, 4


def _sketch(k: int, s: int):
    inner = k - s + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in bw.pieces(batch.column(1)):
                starts, ends, first = bw.words(buf, offs, bw.ALNUM)
                h = bw.hash_spans(buf, starts, ends)
                at, anchor = bw.window_hashes(h, first, k)
                _, small = bw.window_hashes(h, np.array([0, len(h)]), s)
                n = len(small) - inner + 1
                if n > 0:
                    least = small[:n].copy()
                    for j in range(1, inner):
                        np.minimum(least, small[j : j + n], out=least)
                    taken = (least[at] == small[at]) | (least[at] == small[at + inner - 1])
                    at, anchor = at[taken], anchor[taken]
                ends_of = pa.array(np.searchsorted(at, first).astype(np.int32))
                position = (at - first[bw.rows_of(first, at)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends_of, pa.array(x)) for x in (position, anchor.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), *lists], ["id", "n", "positions", "anchors"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, n_words, positions, anchors) for every row: the first words of its closed syncmers, and their hashes."""
    if not 0 < s < k or k <= 4:
        raise ValueError("k must be over 4 and s from 1 to k - 1")
    bw.bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), F.lower(col(text_col)).alias("text"))
    return rows.mapInArrow(bw.tidied(_sketch(k, s)), f"id {dict(rows.dtypes)['id']}, n bigint, positions array<int>, anchors array<bigint>").toDF("doc_id", "n_words", "positions", "anchors")


def positional_matches(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(left_id, right_id, shift, n_anchors, first_pos, last_pos): ``least`` or more anchors at one distance.

    Both sides are fingerprints; positions are those of the left side.
    """

    def exploded(side: DataFrame, name: str) -> DataFrame:
        return side.select(F.col("doc_id").alias(f"{name}_id"), F.explode(F.arrays_zip("positions", "anchors")).alias("x")).select(f"{name}_id", F.col("x.positions").alias(f"{name}_pos"), F.col("x.anchors").alias("anchor"))

    shared = exploded(left, "left").join(exploded(right, "right"), "anchor")
    lines = shared.groupBy("left_id", "right_id", (F.col("right_pos") - F.col("left_pos")).alias("shift"))
    return lines.agg(F.count("*").alias("n_anchors"), F.min("left_pos").alias("first_pos"), F.max("left_pos").alias("last_pos")).filter(F.col("n_anchors") >= least)
