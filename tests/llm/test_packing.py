import random
from collections import Counter, defaultdict

import pytest
import tiktoken
from edge_cases import EDGES
from oracle import SMALL
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, packing, queries
from weftline.llm.packing import pack, place, shortest_pack_first

words_column = lambda: F.regexp_count("text", F.lit(r"\S+"))


def brute(lengths, limit):
    """Longest first, each into the pack with most room if it fits, else into a new one: sizes of the packs, sorted."""
    packs = []
    for n in sorted(lengths, reverse=True):
        if packs and min(packs) + n <= limit:
            i = packs.index(min(packs))
            packs[i] += n
        else:
            packs.append(n)
    return sorted(packs)


@pytest.mark.parametrize("seed", range(8))
def test_patterns_hold_every_length_once(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 50, 300])
    lengths = [rng.randint(1, limit) for _ in range(rng.randint(1, 400))]
    patterns = shortest_pack_first(dict(Counter(lengths)), limit)
    held = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= limit
        for x in pattern:
            held[x] += n
    assert held == Counter(lengths)
    sizes = sorted(sum(pattern) for pattern, n in patterns for _ in range(n))
    assert sizes == brute(lengths, limit)
    slots = packing._slots(patterns)
    assert len(slots) <= 3 * limit * (2 * limit) ** 0.5


def words_of(text):
    return len((text or "").split())


def check(rows, texts, limit, count=words_of):
    """Every word of every document in one place, no pack overfull, no overlap."""
    packs, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["pack_id"] is not None:
            packs[r["pack_id"]].append((r["pack_offset"], r["length"], r["slot"]))
            covered[r["doc_id"]].append((r["start"], r["length"]))
    for items in packs.values():
        at = 0
        for slot, (offset, length, s) in enumerate(sorted(items)):
            assert (offset, s) == (at, slot)
            at += length
        assert at <= limit
    assert set(packs) == set(range(len(packs)))
    for doc, text in texts:
        if doc is not None and len([d for d, _ in texts if d == doc]) == 1:
            at = 0
            for start, length in sorted(covered.get(doc, [])):
                assert start == at
                at += length
            assert at == count(text)
    return packs


@pytest.mark.parametrize("limit", [7, 64])
def test_documents(make, limit):
    rng = random.Random(limit)
    texts = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 5, 5, 20, 200])))) for i in range(300)]
    rows = place(make(texts), max_len=limit, tokens=words_column()).collect()
    packs = check(rows, texts, limit)
    pieces = [min(limit, n - at) for _, t in texts if (n := len(t.split())) for at in range(0, n, limit)]
    assert sorted(sum(x[1] for x in items) for items in packs.values()) == brute(pieces, limit)


def test_edges(edges, nothing):
    rows = place(edges, max_len=2048, tokens=words_column()).collect()
    check(rows, [(r[0], r[1]) for r in EDGES], 2048)
    assert sum(r["length"] for r in rows) == sum(len((r[1] or "").split()) for r in EDGES)
    assert {r["doc_id"] for r in rows if r["pack_id"] is None} >= {3, 4, 5}
    packs = pack(edges).collect()
    assert all(r["n_tokens"] == sum(p["length"] for p in r["pieces"]) <= 2048 and [p["slot"] for p in r["pieces"]] == list(range(len(r["pieces"]))) for r in packs if r["pack_id"] is not None)
    assert {d for r in packs if r["pack_id"] is None for d in r["doc_ids"]} == {3, 4, None}
    assert pack(nothing).count() == 0


def test_query_is_brute_force(spark):
    """Every token of every document in one place, and the pack sizes of a plain version."""
    v = byte_bpe.Vocabulary()
    tokenizer = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ids.tolist())), special_tokens={})
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    n = {i: len(tokenizer.encode_ordinary(t)) if t else 0 for i, t in docs}
    found = queries.op2_packing(spark, SMALL)
    rows = found.selectExpr("pack_id", "inline(pieces)").collect()
    check(rows, [(i, i) for i in n], 2048, n.get)
    pieces = [min(2048, k - at) for k in n.values() for at in range(0, k, 2048)]
    assert sorted(r["n_tokens"] for r in found.collect() if r["pack_id"] is not None) == brute(pieces, 2048)
