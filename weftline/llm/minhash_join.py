"""MinHash near-duplicate search by an inverted join on signature coordinates.

A text's signature has ``coords`` coordinates: the least value of as many hash functions over its word
``shingle``-grams. Documents are posted under their (coordinate, value) pairs and two of them are near
duplicates if they collide in at least ``matches`` coordinates.

* Documents with equal signatures are a class, brought together first by aggregates with a map-side part;
  its least-numbered document stands for all, with their number.
* Prefix merging. Coordinate-value pairs have one global order, the rarest first. Two documents with
  ``matches`` collisions share a pair among the first ``coords - matches + 1`` of each, so only these are
  posted; the order keeps documents out of the lists of pairs that very many share.
* Skip merging. What a document's prefix leaves out, its ``matches - 1`` longest lists, is never merged;
  whether they collide there is looked up in the signatures of the candidates.
* A list of over ``BLOCK`` documents is split by hash into blocks, and each two blocks are a unit of work of
  their own. Within a unit collisions are counted by bit operations on what sets each signature apart from
  the unit's most frequent values. A unit tells for each document how many partners it has there and which
  of them hang together: a row a document, whatever the number of pairs.

The join is exact for the signatures: no list, partner or candidate is dropped. Signatures approximate
Jaccard similarity: a pair is kept if at least ``matches / coords`` of its coordinates agree.

Nulls and corner cases. Identifiers are whole numbers (others are an error of the cast). A null, empty or
wordless text has no signature, no near duplicate, and is a group of its own. Rows with a null identifier
cannot be named and take no part; deduplication keeps them. Of rows that repeat an identifier the least text
stands for the document; deduplication treats rows with that very text alike and keeps the others. Texts of
fewer words than a shingle make one shingle of all their words. Case, punctuation and white space are ignored.
Ties: groups are named after their least identifier. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col, drop_path, fresh, materialise

from . import bytewords as bw

COORDS, MATCHES, SHINGLE = 64, 36, 3
#: Lists of at least HOT documents are ordered by their length; at most HOT_TABLE such lengths are sent to
#: the workers (the least length counted as hot rises with the data). This only orders pairs; it drops none.
HOT, HOT_TABLE = 32, 100_000
#: Lists of more documents are split into blocks of about so many. Pairs at once in NumPy.
BLOCK, PAIRS = 8192, 1 << 18

_MULT = bw.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _signatures(coords: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in bw.pieces(batch.column(1)):
                starts, ends, first = bw.words(buf, offs, bw.ALNUM)
                h = bw.hash_spans(buf, starts, ends)
                at, grams = bw.window_hashes(h, first, shingle)
                count = np.diff(first)
                short = np.flatnonzero((count > 0) & (count < shingle))
                if len(short):  # all their words make one shingle
                    own = np.array([bw.mix(np.array([np.bitwise_xor.reduce(bw.mix(h[first[r] : first[r + 1]] + np.arange(first[r + 1] - first[r], dtype=np.uint64)))]))[0] for r in short], np.uint64)
                    at, grams = np.concatenate([at, first[short]]), np.concatenate([grams, own])
                    order = np.argsort(at, kind="stable")
                    at, grams = at[order], grams[order]
                rows = bw.rows_of(first, at)
                has, begin = np.unique(rows, return_index=True)
                if not len(has):
                    continue
                sig = np.empty((len(has), coords), np.uint32)
                tmp = np.empty_like(grams)
                for c in range(coords):
                    np.multiply(grams, _MULT[c], out=tmp)
                    least = np.minimum.reduceat(tmp, begin)
                    sig[:, c] = (bw.mix(least + np.uint64(c)) >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(has + lo)), _binary(sig)], ["id", "sig"])

    return run


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, coords: int) -> np.ndarray:
    raw = column.buffers()
    start = np.frombuffer(raw[1], np.int32)[column.offset]
    return np.frombuffer(raw[2], np.uint32, offset=int(start), count=len(column) * coords).reshape(len(column), coords)


def _tokens(sig: np.ndarray) -> np.ndarray:
    """Coordinate and value in one number."""
    return (np.arange(sig.shape[1], dtype=np.int64) << 32)[None, :] | sig.astype(np.int64)


def _list_lengths(coords: int):
    """Counts of coordinate-value pairs within a batch, of those that occur twice in it: lists that matter for the order show there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = np.unique(_tokens(_matrix(batch.column(0), coords)), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(n[often])], ["token", "n"])

    return run


def _hot_lists(reps: DataFrame, coords: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest lists: (pairs, class of their length). Only the order of pairs depends on it."""
    lengths, path = materialise(
        reps.select("sig").mapInArrow(bw.tidied(_list_lengths(coords)), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT).select("token", F.floor(F.log2("n")).cast("int").alias("level")),
        "lists",
    )
    by_level = sorted(((r["level"], r["count"]) for r in lengths.groupBy("level").count().collect()), reverse=True)
    least, total = 99, 0
    for level, n in by_level:
        if total + n > HOT_TABLE:
            break
        least, total = level, total + n
    rows = lengths.filter(F.col("level") >= least).toPandas().sort_values("token")
    drop_path(reps.sparkSession, path)
    return rows["token"].to_numpy(np.int64), rows["level"].to_numpy(np.int64)


def _prefix(sig: np.ndarray, matches: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which coordinates of each signature are posted: the first by (length class of the list, coordinate)."""
    n, coords = sig.shape
    keep = coords - matches + 1
    key = np.tile(np.arange(coords, dtype=np.int64), (n, 1))
    tokens, levels = hot
    if len(tokens):
        own = _tokens(sig)
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        key += np.where(tokens[at] == own, levels[at], 0) * coords
    chosen = np.zeros((n, coords), bool)
    np.put_along_axis(chosen, np.argpartition(key, keep - 1, axis=1)[:, :keep], True, axis=1)
    return chosen


def _bits(chosen: np.ndarray) -> np.ndarray:
    return np.packbits(chosen, axis=1, bitorder="little").view(np.int64).reshape(-1)


def _post(coords: int, matches: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = _matrix(part.column(1), coords)
                chosen = _prefix(sig, matches, hot)
                row, _ = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(_tokens(sig)[chosen]), part.column(0).take(pa.array(row))], ["token", "id"])

    return run


def _with_mask(coords: int, matches: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = _bits(_prefix(_matrix(batch.column(1), coords), matches, hot))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask), batch.column(2)], ["id", "sig", "mask", "copies"])

    return run


def _small(sig: np.ndarray, mask: np.ndarray, own: np.ndarray, begin: np.ndarray, size: np.ndarray, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, matches) of the near pairs of many short lists at once: rows begin[k] .. begin[k] + size[k] - 1 are list k."""
    later = np.repeat(begin + size, size) - 1 - _ragged(begin, size)  # how many come after each row in its list
    left = np.repeat(_ragged(begin, size), later)
    right = left + 1 + _ragged(np.zeros(len(later), np.int64), later)
    for lo in range(0, len(left), PAIRS // 16):
        i, j = left[lo : lo + PAIRS // 16], right[lo : lo + PAIRS // 16]
        same = sig[i] == sig[j]
        n = same.sum(axis=1)
        near = n >= matches
        i, j, n, same = i[near], j[near], n[near], same[near]
        first = (_bits(same) & mask[i] & mask[j] & ((np.int64(1) << own[i]) - 1)) == 0
        yield i[first], j[first], n[first]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[k] .. begin[k] + size[k] - 1, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _long(sig: np.ndarray, mask: np.ndarray, own: int, other: np.ndarray, diagonal: bool, matches: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, near pairs) by rows: a matrix of rows of the unit's left block against its right block.

    ``other`` marks the right block; a unit of one block compares rows with later ones. Signatures differ from
    the most frequent value of each coordinate in a few bits. Two that both have it there agree; where both
    lack it they may: only pairs of which that decides are looked up in full.
    """
    coords = sig.shape[1]
    order = np.sort(sig, axis=0)
    fresh_run = np.concatenate([np.ones((1, coords), bool), order[1:] != order[:-1]])
    base = np.empty(coords, sig.dtype)
    for c in range(coords):
        at = np.flatnonzero(fresh_run[:, c])
        base[c] = order[at[np.argmax(np.diff(np.append(at, len(order))))], c]
    apart = _bits(sig != base).view(np.uint64)
    below = mask.view(np.uint64) & np.uint64((1 << own) - 1)
    whole = np.uint64((1 << coords) - 1)
    a, b = (np.arange(len(sig)),) * 2 if diagonal else (np.flatnonzero(~other), np.flatnonzero(other))
    sig_b, apart_b, below_b = sig[b], apart[b], below[b]
    step = max(1, PAIRS // max(1, len(b)))
    for lo in range(0, len(a), step):
        i = a[lo : lo + step]
        either = apart[i][:, None] | apart_b[None, :]
        both = apart[i][:, None] & apart_b[None, :]
        prefix = below[i][:, None] & below_b[None, :]
        sure = coords - np.bitwise_count(either)
        near = (sure + np.bitwise_count(both) >= matches) & (~either & whole & prefix == 0)
        if diagonal:
            near &= np.arange(len(b))[None, :] > i[:, None]
        unsure = near & ((sure < matches) | (both & prefix != 0))
        x, y = np.nonzero(unsure)
        for k in range(0, len(x), PAIRS // 16):
            xs, ys = x[k : k + PAIRS // 16], y[k : k + PAIRS // 16]
            same = sig[i[xs]] == sig_b[ys]
            near[xs, ys] = (same.sum(axis=1) >= matches) & (_bits(same).view(np.uint64) & prefix[xs, ys] == 0)
        yield lo, near


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Labels become the least row of what the pairs connect."""
    while len(i):
        while (label[label] != label).any():
            label[:] = label[label]
        one, two = label[i], label[j]
        apart = one != two
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])  # pairs whose root went elsewhere come again


def _merge_lists(coords: int, matches: int, pairs: bool):
    """Sorted rows (token, unit, side, id, sig, mask, n) to (id, label, links), or to pairs (id, label, collisions).

    A pair counts in the first list only that the prefixes of both share. ``links`` counts partners with their
    copies; ``label`` is the least identifier that the document hangs together with in its unit.
    """
    names = ["id", "label", "links"]

    def told(ids: np.ndarray, label: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        has = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[label[has]]), pa.array(links[has])], names)

    def paired(ids, i, j, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(n.astype(np.int64))], names)

    def short(token, side, ids, sig, mask, copies, begin, size) -> Iterator[pa.RecordBatch]:
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i, j, n in _small(sig, mask, token >> 32, begin, size, matches):
            if pairs:
                yield paired(ids, i, j, n)
                continue
            links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
            _unite(label, i, j)
        if not pairs:
            yield told(ids, label, links)

    def long(token, side, ids, sig, mask, copies) -> Iterator[pa.RecordBatch]:
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        diagonal = not side.any()
        a, b = (np.arange(len(ids)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for lo, near in _long(sig, mask, int(token[0]) >> 32, side == 1, diagonal, matches):
            rows = a[lo : lo + len(near)]
            if pairs:
                x, y = np.nonzero(near)
                for k in range(0, len(x), PAIRS // 16):
                    i, j = rows[x[k : k + PAIRS // 16]], b[y[k : k + PAIRS // 16]]
                    yield paired(ids, i, j, (sig[i] == sig[j]).sum(axis=1))
                continue
            has = np.flatnonzero(near.any(axis=1))
            if not len(has):
                continue
            near = near[has]
            links[rows[has]] += near @ copies[b]
            links[b] += copies[rows[has]] @ near
            head = np.argmax(near, axis=1)
            _unite(label, rows[has], b[head])  # then whatever is not with its row's head yet
            x, y = np.nonzero(near & (label[b][None, :] != label[rows[has]][:, None]))
            _unite(label, rows[has][x], b[y])
        if not pairs:
            yield told(ids, label, links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(t: tuple) -> Iterator[pa.RecordBatch]:
            token, unit = t[0], t[1]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(unit) != 0)) + 1, [len(token)]])
            begin, size = cuts[:-1], np.diff(cuts)
            rest = (t[0], *t[2:])
            few = (size > 1) & (size <= 64)
            if few.any():
                yield from short(*rest, begin[few], size[few])
            for k in np.flatnonzero(size > 64):
                yield from long(*(x[cuts[k] : cuts[k + 1]] for x in rest))

        held: list[tuple] = []  # rows of the list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            token, unit, side, ids, mask, copies = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5, 6))
            rows = (token, unit, side, ids, _matrix(batch.column(4), coords), mask, copies)
            change = np.flatnonzero((np.diff(token) != 0) | (np.diff(unit) != 0))
            if held and (held[0][0][0], held[0][1][0]) == (token[0], unit[0]) and not len(change):
                held.append(tuple(x.copy() for x in rows))
                continue
            cut = int(change[-1]) + 1 if len(change) else 0
            held.append(tuple(x[:cut] for x in rows))
            yield from merged(tuple(np.concatenate(x) for x in zip(*held)))
            held = [tuple(x[cut:].copy() for x in rows)]
        if held:
            yield from merged(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def _one_text_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of named documents with a text; of several texts of an identifier the least."""
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    often = rows.groupBy("id").count().filter("count > 1").select("id")
    return rows.join(often, "id", "left_anti").unionByName(rows.join(often, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def _linked(docs: DataFrame, id_col: str, text_col: str, coords: int, matches: int, shingle: int, pairs: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(links of class representatives, (id, rep, copies) of all signed documents, written tables to be deleted)."""
    bw.bound_batches(docs.sparkSession)
    texts = _one_text_each(docs, id_col, text_col).select("id", F.lower("text").alias("text"))
    signed, p0 = materialise(texts.mapInArrow(bw.tidied(_signatures(coords, shingle)), "id bigint, sig binary").select("id", "sig", F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(1), "sig").alias("h2")), "signatures")
    keys = signed.select("id", "h1", "h2")  # 128 bits stand for a signature
    classes = keys.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members, p1 = materialise(keys.join(classes, ["h1", "h2"]).select("id", "rep", "copies"), "classes")
    reps, p2 = materialise(signed.select("id", "sig").join(members.filter("id = rep").select("id", "copies"), "id"), "representatives")
    hot = _hot_lists(reps, coords)
    posted = reps.select("id", "sig").mapInArrow(bw.tidied(_post(coords, matches, hot)), "token bigint, id bigint")
    lengths = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posted.join(lengths, "token")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("bigint")).cast("int")
    units = shared.select("token", "id", blocks.alias("blocks"), own.alias("own")).select("token", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"), "blocks")
    units = units.select("token", "id", (F.least("own", "with").cast("bigint") * F.col("blocks") + F.greatest("own", "with")).alias("unit"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"))
    signatures = reps.mapInArrow(bw.tidied(_with_mask(coords, matches, hot)), "id bigint, sig binary, mask bigint, copies bigint")
    lists = units.join(signatures.hint("merge"), "id").select("token", "unit", "side", "id", "sig", "mask", "copies")
    links = lists.repartition(F.col("token"), F.col("unit")).sortWithinPartitions("token", "unit").mapInArrow(bw.tidied(_merge_lists(coords, matches, pairs)), "id bigint, label bigint, links bigint")
    return links, members, [p0, p1, p2]


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coords: int = COORDS, matches: int = MATCHES, shingle: int = SHINGLE) -> DataFrame:
    """Near pairs of class representatives, and of each with its copies: (doc_a, doc_b, matches), doc_a < doc_b.

    n documents of one signature give n - 1 rows; a document's other pairs are those of its representative.
    For groups and numbers of links no pair need be written: ``near_groups``.
    """
    links, members, paths = _linked(docs, id_col, text_col, coords, matches, shingle, True)
    equal = members.filter("id <> rep").select(F.col("rep").alias("id"), F.col("id").alias("label"), F.lit(coords).cast("bigint").alias("links"))
    found, _ = materialise(links.unionByName(equal).toDF("doc_a", "doc_b", "matches"), "pairs")
    drop_path(docs.sparkSession, *paths)
    return found


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(id, group_id): the connected components of the pairs; a group is named after its least member.

    Large-star and small-star rounds alternate until a round changes nothing; the edges are written in the
    shared folder each round, and the number of rounds grows with the logarithm of the size of a component.
    A node's least neighbour is aggregated map-side and joined back, so that a node with many neighbours is
    many tasks' work.
    """
    spark = pairs.sparkSession
    edges, path = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.select("u", F.col("m").alias("v")).unionByName(large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after, fresh_path = materialise(joined, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        edges, path = after, fresh_path
        if tuple(now) == size:
            break
        size = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str, coords: int = COORDS, matches: int = MATCHES, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(links, members, groups of class representatives that have links, written tables)."""
    links, members, paths = _linked(docs, id_col, text_col, coords, matches, shingle, False)
    told, path = materialise(links.groupBy("id", "label").agg(F.sum("links").alias("links")), "links")
    return told, members, components(told, "id", "label"), [*paths, path]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, class_id, group_id, n_links) of every document.

    ``class_id`` is the least document with the same signature, ``group_id`` the least one that near-duplicate links lead to,
    ``n_links`` the number of documents that are near duplicates of this one, copies included.
    """
    told, members, groups, paths = _grouped(docs, id_col, text_col, **options)
    degree = told.groupBy("id").agg(F.sum("links").alias("links"))
    ids = docs.select(col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    linked = degree.join(groups, "id", "full").withColumnRenamed("id", "rep")
    rows = ids.join(members, "id", "left").join(linked, "rep", "left")
    found, _ = materialise(
        rows.select(
            F.col("id").alias("doc_id"),
            F.coalesce("rep", "id").alias("class_id"),
            F.coalesce("group_id", "rep", "id").alias("group_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        ),
        "groups",
    )
    drop_path(docs.sparkSession, *paths)
    return found


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` without all but the least-numbered document of each near-duplicate group; its columns as they are."""
    told, members, groups, paths = _grouped(docs, id_col, text_col, **options)
    gone, text = fresh(docs, "gone_id", "gone_text")
    lost = members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").filter("id <> coalesce(group_id, rep)").select("id")
    # the very text that stood for the document: others under its identifier stay
    texts = docs.select(col(id_col).cast("bigint").alias("id"), F.xxhash64(col(text_col)).alias("t"), col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    often = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if often.isEmpty():
        losers, _ = materialise(lost.select(F.col("id").alias(gone)), "losers")
        on = col(id_col).cast("bigint") == F.col(gone)
    else:
        stood = _one_text_each(docs, id_col, text_col).select("id", F.xxhash64("text").alias(text))
        losers, _ = materialise(stood.join(lost, "id", "left_semi").select(F.col("id").alias(gone), text), "losers")
        on = (col(id_col).cast("bigint") == F.col(gone)) & (F.xxhash64(col(text_col)) == F.col(text))
    drop_path(docs.sparkSession, *paths)
    return docs.join(losers, on, "left_anti")
