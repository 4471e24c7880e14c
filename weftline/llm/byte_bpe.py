"""Byte-level BPE encoding and decoding by recursive SQL in a DuckDB of each partition.

A text is split by the vocabulary's pattern. Of a partition's distinct words (bounded slices at a time) the
bytes become token-position rows; a recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of minimum rank until no pair of any word is in the table. Words that the worker has met
before, up to ``CACHE_WORDS`` of them, are not encoded again. Decoding joins token rows to the vocabulary and aggregates the bytes in
order.

A sequence of tokens is a text's encoding if every token and its neighbour are the encoding of their own bytes:
the first contraction across a boundary would take place in the two alone as well. So a word is cut into pieces of
``PIECE`` bytes, which the query encodes like words; what meets at a seam is checked by encoding the two tokens, and
where that gives something else the text around the seam is encoded anew from a boundary that holds, on until a
boundary of the old pieces holds too. The work is linear in a word's length, and equal pieces are encoded once.

DuckDB runs in the Python worker with one thread, within ``memory``, over a bounded number of bytes or tokens at a
time, and never writes to disk.

Nulls and corner cases. A null text gives null tokens and a null count, an empty one no tokens. Strings of
special tokens are ordinary text. Rows that repeat an identifier, null identifiers and other columns don't
matter: rows are encoded each on its own. An empty table gives an empty result. Token numbers outside the
vocabulary are an error; null token lists decode to null. Identifiers of any type are carried.
"""

from __future__ import annotations

import base64
import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import col

from . import bytewords as bw

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's own tokenizer splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES, CACHE_WORDS = 4 << 20, 600_000
#: Bytes of a piece, and of its end that may change with what follows; bytes and tokens of one query.
PIECE, TAIL, QUERY_BYTES, QUERY_TOKENS = 64, 16, 150_000, 1 << 18
MEMORY = "400MB"

_ENCODE_SQL = """
WITH RECURSIVE s(k, tok, done) AS (
  SELECT k, tok, false FROM begun
  UNION ALL (
    WITH live AS (
      SELECT k, tok, lead(tok) OVER w AS next_tok, lead(k) OVER w AS next_k, lag(k) OVER w AS prev_k
      FROM s WHERE NOT done WINDOW w AS (ORDER BY k)),
    best AS (
      SELECT k >> 32 AS word, min((m << 32) | (k & 4294967295)) AS b
      FROM live JOIN merges ON pair = ((tok << 17) | next_tok) WHERE next_k >> 32 = k >> 32 GROUP BY 1),
    told AS (SELECT k, tok, prev_k, b, (word << 32) | (b & 4294967295) AS spot FROM live LEFT JOIN best ON word = k >> 32)
    SELECT k, CASE WHEN k = spot THEN b >> 32 ELSE tok END, b IS NULL FROM told WHERE b IS NULL OR prev_k IS NULL OR prev_k <> spot))
SELECT k, tok FROM s WHERE done ORDER BY k
"""

_DECODE_SQL = """
SELECT k >> 32 AS row, unhex(string_agg(hex, '' ORDER BY k)) AS raw
FROM given JOIN vocabulary USING (tok) GROUP BY 1 ORDER BY 1
"""


class Vocabulary:
    """A rank file: (token bytes in base64, rank) lines; ranks are token numbers."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        if self.ids.max() >= 1 << 17:
            raise ValueError("token numbers must be below 2 ** 17")
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:n]] << 17 | ranks[t[n:]], rank) for t, rank in ranks.items() for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks]
        self.pairs, self.merged = (np.array(x, np.int64) for x in zip(*pairs))


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + size[i] - 1, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Known(dict):
    """Numbers of words; a word that isn't known gets the next one and is listed as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Coder:
    """Encodes and decodes in this process."""

    CACHE_PIECES = 100_000

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, memory: str = MEMORY):
        import duckdb
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._table("merges", pair=vocabulary.pairs, m=vocabulary.merged)
        self._table("vocabulary", tok=vocabulary.ids, hex=[t.hex() for t in vocabulary.tokens])
        self.bytes_of = dict(zip(vocabulary.ids.tolist(), vocabulary.tokens))
        self._forget()

    def _table(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _forget(self) -> None:
        self.known = Known()
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, their number in each)."""
        length = np.array([len(w) for w in words], np.int64)
        batch = np.cumsum(length) // QUERY_BYTES
        tokens, own = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(words)] if words else []):
            size = length[lo:hi]
            k = (np.repeat(np.arange(hi - lo, dtype=np.int64), size) << 32) | _ragged(np.zeros(hi - lo, np.int64), size)
            self.con.register("begun", pa.table({"k": k, "tok": self.vocabulary.byte_ids[np.frombuffer(b"".join(words[lo:hi]), np.uint8)]}))
            found = self.con.sql(_ENCODE_SQL).to_arrow_table()
            self.con.unregister("begun")
            tokens.append(found["tok"].to_numpy().astype(np.int32))
            own.append(np.bincount(found["k"].to_numpy() >> 32, minlength=hi - lo))
        return np.concatenate(tokens), np.concatenate(own)

    def _encode_pieces(self, raw: set[bytes]) -> None:
        words = sorted(raw - self.pieces.keys(), key=len)
        tokens, own = self._contract(words)
        ends = np.cumsum(own)
        for word, lo, hi in zip(words, (ends - own).tolist(), ends.tolist()):
            self.pieces[word] = tuple(tokens[lo:hi].tolist())

    def _encode_long(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of words of any length, by pieces."""
        if len(self.pieces) > self.CACHE_PIECES:
            self.pieces.clear()
        cuts = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        self._encode_pieces({x for c in cuts for x in c})
        done: dict[int, list[int]] = {}
        while len(done) < len(words):
            wanted: set[bytes] = set()
            for i, word in enumerate(words):
                if i not in done and (tokens := self._joined(word, cuts[i], wanted)) is not None:
                    done[i] = tokens
            self._encode_pieces(wanted)
        return [np.array(done[i], np.int32) for i in range(len(words))]

    def _joined(self, word: bytes, cuts: list[bytes], wanted: set[bytes]) -> list[int] | None:
        """The word's tokens; None if encodings that it takes aren't known yet: these are added to ``wanted``."""
        pieces, bytes_of = self.pieces, self.bytes_of
        base = [t for c in cuts for t in pieces[c]]
        starts = [0, *itertools.accumulate(len(bytes_of[t]) for t in base)]
        seams = list(itertools.accumulate(len(pieces[c]) for c in cuts))[:-1]
        out: list[int] = []
        at: list[int] = []
        complete = True

        def holds(left: int, right: int) -> bool | None:
            raw = bytes_of[left] + bytes_of[right]
            found = pieces.get(raw)
            if found is None:
                wanted.add(raw)
                return None
            return found == (left, right)

        def mended(seam: int) -> int | None:
            """Encode anew around a seam; where to go on in the old tokens. None if that must wait."""
            back, k, least = 2, min(2, len(out)), starts[seam]
            p = at[-k]
            while True:
                begin = p
                size = PIECE + max(0, least - begin)
                found = pieces.get(raw := word[begin : begin + size])
                if found is None:
                    wanted.add(raw)
                    return None
                if k < len(out):
                    if (ok := holds(out[-k - 1], found[0])) is None:
                        return None
                    if not ok:
                        back, k = 2 * back, min(len(out), k + back)
                        p = at[-k]
                        continue
                if k:
                    del out[-k:], at[-k:]
                most = len(word) if begin + size >= len(word) else begin + size - TAIL
                for n, token in enumerate(found):
                    after = p + len(bytes_of[token])
                    if n and after > most:
                        break
                    out.append(token)
                    at.append(p)
                    p = after
                if p >= len(word):
                    return len(base)
                j = bisect.bisect_left(starts, p)
                if starts[j] == p:
                    if (ok := holds(out[-1], base[j])) is None:
                        return None
                    if ok:
                        return j
                k, least = 0, p

        i = 0
        for seam in seams:
            if seam <= i and i:
                continue
            if (ok := holds(base[seam - 1], base[seam])) is None:
                complete = False
            if ok is not False:
                continue
            if complete or len(wanted) < QUERY_TOKENS:
                out += base[i:seam]
                at += starts[i:seam]
                i = seam
                if (j := mended(seam)) is None:
                    complete = False
                    out, at = base[max(0, seam - 64) : seam], starts[max(0, seam - 64) : seam]  # go on as if it were mended, to learn what else is wanted
                else:
                    i = j
        return out + base[i:] if complete else None

    def _learn(self) -> None:
        """Encode the words that are new."""
        raw = [w.encode() for w in self.known.new]
        self.known.new = []
        begin, size = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        length = np.array([len(b) for b in raw], np.int64)
        short, long = np.flatnonzero(length <= PIECE), np.flatnonzero(length > PIECE)  # a short word is one piece
        tokens, size[short] = self._contract([raw[i] for i in short.tolist()])
        whole = self._encode_long([raw[i] for i in long.tolist()])
        size[long] = [len(t) for t in whole]
        order = np.concatenate([short, long])
        begin[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.begin, self.size, self.flat = np.concatenate([self.begin, begin]), np.concatenate([self.size, size]), np.concatenate([self.flat, tokens, *whole])

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, how many each text has); all words are known then."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        number_of, split = self.known.__getitem__, self.pattern.findall
        numbers: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                numbers.extend(map(number_of, split(text)))
            count[i] = len(numbers)
        count = np.diff(count, prepend=0)
        self._learn()
        return np.array(numbers, np.int64), count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, their number in each)."""
        number, count = self._numbered(texts)
        size = self.size[number]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[np.cumsum(count)] if len(count) else count
        return self.flat[_ragged(self.begin[number], size)], np.diff(np.concatenate([[0], ends]))

    def decode(self, tokens: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts of token lists laid end to end, ``size`` tokens each."""
        if len(tokens) and not np.isin(tokens, self.vocabulary.ids).all():
            raise ValueError("a token isn't in the vocabulary")
        k = (np.repeat(np.arange(len(size), dtype=np.int64), size) << 32) | _ragged(np.zeros(len(size), np.int64), size)
        parts: list[list[bytes]] = [[] for _ in range(len(size))]
        for lo in range(0, len(k), QUERY_TOKENS):
            self.con.register("given", pa.table({"k": k[lo : lo + QUERY_TOKENS], "tok": tokens[lo : lo + QUERY_TOKENS].astype(np.int64)}))
            found = self.con.sql(_DECODE_SQL).to_arrow_table()
            self.con.unregister("given")
            for row, raw in zip(found["row"].to_pylist(), found["raw"].to_pylist()):
                parts[row].append(raw)
        return [b"".join(p).decode() for p in parts]


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def _lists(tokens: np.ndarray, size: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.concatenate([null, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32()))


_CODERS: dict[tuple, Coder] = {}


def _coder(vocabulary: Vocabulary, pattern: str) -> Coder:
    """This worker's coder: the partitions that it handles share the words that it knows, up to ``CACHE_WORDS``."""
    key = (hash(vocabulary.merged.tobytes()), hash(vocabulary.pairs.tobytes()), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(vocabulary, pattern)
    return _CODERS[key]


def _encode(vocabulary: Vocabulary, pattern: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _coder(vocabulary, pattern)
            for lo, hi in _slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                null = np.asarray(part.column(1).is_null())
                texts = part.column(1).to_pylist()
                tokens, size = coder.encode(texts)
                columns = [part.column(0), _lists(tokens, size, null), pa.array(size, pa.int64(), mask=null)]
                if check:
                    same = [a == (b or "") for a, b in zip(coder.decode(tokens, size), texts)]
                    columns.append(pa.array(same, pa.bool_(), mask=null))
                yield pa.RecordBatch.from_arrays(columns, ["id", "tokens", "n", "same"][: len(columns)])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids, n_tokens) for every row."""
    bw.bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = rows.mapInArrow(bw.tidied(_encode(Vocabulary(vocabulary), pattern, False)), f"id {dict(rows.dtypes)['id']}, tokens array<int>, n bigint")
    return out.toDF("doc_id", "token_ids", "n_tokens")


#: Runs without a break, of which the compiled tokenizer's time grows with the square: such texts are encoded by pieces.
_UNBROKEN = r"\S{2000}|\s{2000}"


def _count(vocabulary: Vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        unbroken = regex.compile(_UNBROKEN)
        quick = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=dict(zip(vocabulary.tokens, vocabulary.ids.tolist())), special_tokens={})

        def length(text: str | None) -> int:
            if not text:
                return 0
            return int(_coder(vocabulary, pattern).encode([text])[1][0]) if unbroken.search(text) else len(quick.encode_ordinary(text))

        for batch in batches:
            for lo, hi in _slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                n = [length(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64(), mask=np.asarray(part.column(1).is_null()))], ["id", "n"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) for every row; null for a null text. No tokens are needed here, so a compiled tokenizer counts them."""
    bw.bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(bw.tidied(_count(Vocabulary(vocabulary), pattern)), f"id {dict(rows.dtypes)['id']}, n bigint").toDF("doc_id", "n_tokens")


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) for every row of token lists."""
    bw.bound_batches(encoded.sparkSession)
    words = Vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(words)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(1)
                null = np.asarray(lists.is_null())
                size = np.where(null, 0, np.asarray(lists.fill_null([]).value_lengths())).astype(np.int64)
                texts = coder.decode(lists.flatten().to_numpy(), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string(), mask=null)], ["id", "text"])

    rows = encoded.select(col(id_col).alias("id"), col(tokens_col).cast("array<int>").alias("tokens"))
    return rows.mapInArrow(bw.tidied(run), f"id {dict(rows.dtypes)['id']}, text string").toDF("doc_id", "text")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decodes) for every row: encoded, decoded again, and compared with the text."""
    bw.bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = rows.mapInArrow(bw.tidied(_encode(Vocabulary(vocabulary), pattern, True)), f"id {dict(rows.dtypes)['id']}, tokens array<int>, n bigint, same boolean")
    return out.toDF("doc_id", "token_ids", "n_tokens", "decodes")
