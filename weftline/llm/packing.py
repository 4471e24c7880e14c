"""Sequence packing: shortest-pack-first over the length histogram.

A document's length is its number of byte-level BPE tokens, or any other column. Documents are cut into pieces of at
most ``max_len`` tokens (no token is dropped). The histogram of piece lengths is worked through from the longest to the
shortest: a length goes into the packs that have most room left, the shortest packs, as long as it fits there, and into
new packs otherwise. What is kept of the packs is only how many there are of each pattern (the lengths in a pack, and the
room left), so the work on the driver depends on ``max_len`` alone and not on the corpus. Then each piece is ranked among
those of its length, rank intervals lead to the packs, and the pieces of each pack are brought together. Ranks are
counted within (length, bucket of the identifier's hash) and shifted by a running sum of bucket sizes, so that a frequent length is
not one task's work.

A length makes at most three new patterns, and a pattern has at most sqrt(2 ``max_len``) different lengths, so that there
are at most 3 ``max_len`` sqrt(2 ``max_len``) rank intervals of 40 bytes, 16 MB for 2048: they are broadcast.

Nulls and corner cases. Identifiers are whole numbers (others are an error of the cast). A null, empty or tokenless text:
its document gets a row of its own without a pack, with a piece of length 0. Null identifiers and rows that repeat one are
pieces like others. Ties: equal lengths are ranked by bucket, identifier and piece; of rows that repeat an identifier the
order is not defined, their pack sizes are. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import col, materialise

from . import byte_bpe

MAX_LEN = 2048
BUCKETS = 64


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of packs of it); a pattern lists its lengths from the longest."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    roomy: list[int] = []  # a heap of rooms, the largest first
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done.append((pattern, count))
            return
        if not open_packs[room]:
            heapq.heappush(roomy, -room)
        open_packs[room].append((pattern, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        if not 0 < length <= max_len:
            raise ValueError(f"a length of {length} doesn't fit packs of {max_len}")
        left = histogram[length]
        while left:
            if not roomy or -roomy[0] < length:  # none has room: open packs, each filled before the next
                each = max_len // length
                if left >= each:
                    put((length,) * each, left // each, max_len - length * each)
                if left % each:
                    put((length,) * (left % each), 1, max_len - length * (left % each))
                break
            room = -roomy[0]
            pattern, count = open_packs[room].pop()
            taken = min(count, left)
            if count > taken:
                open_packs[room].append((pattern, count - taken))
            if not open_packs[room]:
                heapq.heappop(roomy)
            put((*pattern, length), taken, room - length)
            left -= taken
    return sorted(done + [x for packs in open_packs.values() for x in packs], reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end rank, first pack, packs, slot, offset in the pack): intervals of ranks among equal lengths.

    Equal lengths of a pattern are one interval: its ranks go round the packs.
    """
    out, placed, packs = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = slot = 0
        for length, equal in itertools.groupby(pattern):
            times = len(list(equal))
            out.append((length, placed[length], placed[length] + count * times, packs, count, slot, offset))
            placed[length] += count * times
            offset += length * times
            slot += times
        packs += count
    return out


def _tokens(docs: DataFrame, id_col: str, text_col: str, tokens: F.Column | None) -> DataFrame:
    """(doc_id, n) of every row."""
    if tokens is None:
        counted = byte_bpe.token_counts(docs, id_col, text_col).toDF("doc_id", "n")
    else:
        counted = docs.select(col(id_col).alias("doc_id"), tokens.alias("n"))
    return counted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n").cast("bigint"), F.lit(0).cast("bigint")).alias("n"))


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, tokens: F.Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, pack_id, slot, pack_offset): where each piece of each document goes.

    ``tokens`` gives a document's length; by default its number of byte-level BPE tokens.
    """
    counted = _tokens(docs, id_col, text_col, tokens)
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_len).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces, _ = materialise(cut.select("doc_id", "piece", (F.col("piece").cast("bigint") * max_len).alias("start"), F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("int").alias("length")), "pieces")

    placed = pieces.filter("length > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    counts, _ = materialise(placed.groupBy("length", "bucket").count(), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = _slots(shortest_pack_first(histogram, max_len))
    table = F.broadcast(docs.sparkSession.createDataFrame(slots, "of int, rank_from bigint, rank_to bigint, pack_from bigint, packs bigint, first_slot int, first_offset int"))

    before = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = placed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    sent = ranked.join(table, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    at = F.col("rank") - F.col("rank_from")
    turn = F.floor(at / F.col("packs")).cast("int")
    packed = sent.select("doc_id", "piece", "start", "length", (F.col("pack_from") + at % F.col("packs")).alias("pack_id"), (F.col("first_slot") + turn).alias("slot"), (F.col("first_offset") + turn * F.col("length")).alias("pack_offset"))
    none = pieces.filter("length <= 0").select("doc_id", "piece", "start", F.lit(0).alias("length"), F.lit(None).cast("bigint").alias("pack_id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("pack_offset"))
    return packed.unionByName(none)


PIECE = ("slot", "pack_offset", "doc_id", "piece", "start", "length")


def assemble(placed: DataFrame) -> DataFrame:
    """(pack_id, n_tokens, doc_ids, pieces): each pack with its pieces in order; a row of its own for a document without tokens.

    A pack has at most ``max_len`` pieces.
    """
    piece = F.struct(*PIECE)
    packs = placed.filter("pack_id IS NOT NULL").groupBy("pack_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    none = placed.filter("pack_id IS NULL").select("pack_id", F.lit(0).cast("bigint").alias("n_tokens"), F.array(piece).alias("pieces"))
    return packs.unionByName(none).select("pack_id", "n_tokens", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"), "pieces")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, tokens: F.Column | None = None) -> DataFrame:
    """The packs of all documents: (pack_id, n_tokens, doc_ids, pieces)."""
    return assemble(place(docs, id_col, text_col, max_len, tokens))
