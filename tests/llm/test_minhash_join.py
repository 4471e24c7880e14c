import random
import re

import numpy as np
import pytest

from oracle import SMALL

from weftline.llm import minhash_join as mj
from weftline.llm import queries
from weftline.llm.minhash_join import components, drop_near_duplicates, near_groups, near_pairs


def shingles(text, n=3):
    words = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 12, 40])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


MASK = (1 << 64) - 1
C1, C2, C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x):
    x = ((x ^ (x >> 30)) * C2) & MASK
    x = ((x ^ (x >> 27)) * C3) & MASK
    return x ^ (x >> 31)


def word_hash(raw):
    h = len(raw) * C1 & MASK
    for i in range(0, len(raw), 8):
        h = mixed(h ^ int.from_bytes(raw[i : i + 8], "little"))
    return mixed((h + C1) & MASK)


def signature(text, coords=mj.COORDS, n=mj.SHINGLE):
    """The signature in plain Python, without the module's own code."""
    words = [word_hash(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())]
    if not words:
        return None
    grams = []
    for i in range(len(words) - n + 1):
        out = 0
        for h in words[i : i + n]:
            out = mixed((out + h + C1) & MASK)
        grams.append(out)
    if not grams:
        out = 0
        for j, h in enumerate(words):
            out ^= mixed((h + j) & MASK)
        grams = [mixed(out)]
    factors = [mixed((c + 1) * 0xA24BAED4963EE407 & MASK) | 1 for c in range(64)]
    return tuple(mixed((min(g * factors[c] & MASK for g in grams) + c) & MASK) >> 32 for c in range(coords))


def agree(a, b):
    return sum(x == y for x, y in zip(a, b))


def hot_corpus(seed=3):
    """A group of many different near copies, their exact copies, and rows that repeat an identifier."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for _ in range(260):
        copy = list(base)
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, rows[k % 7][1]) for k in range(40)]
    rows += [(1000 + i, t) for i, t in corpus(seed)[:60]]
    rng.shuffle(rows)
    return rows


def brute(rows):
    """{id: (class, group, links)} from all pairs of signatures."""
    sig = {i: signature(t) for i, t in rows}
    ids = sorted(sig)
    links, group = {i: 0 for i in ids}, {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sig[a] is not None and sig[b] is not None and agree(sig[a], sig[b]) >= mj.MATCHES:
                links[a] += 1
                links[b] += 1
                if group[a] != group[b]:
                    low, high = sorted((group[a], group[b]))
                    group = {x: low if g == high else g for x, g in group.items()}
    first = {}
    for i in ids:
        first.setdefault(sig[i] or i, i)
    return {i: (first[sig[i] or i], group[i], links[i]) for i in ids}


@pytest.mark.parametrize(("hot", "block"), [(2, 60), (32, 8192)])
def test_is_all_pairs_of_signatures(make, hot, block, monkeypatch):
    monkeypatch.setattr(mj, "HOT", hot)
    monkeypatch.setattr(mj, "BLOCK", block)
    rows = hot_corpus() if block == 60 else corpus()
    sig = {i: signature(t) for i, t in rows}
    ids = sorted(sig)
    first = {}
    for i in ids:
        first.setdefault(sig[i], i)
    reps = sorted(first.values())
    want = {(a, b): n for k, a in enumerate(reps) for b in reps[k + 1 :] if (n := agree(sig[a], sig[b])) >= mj.MATCHES}
    want |= {(first[sig[i]], i): mj.COORDS for i in ids if first[sig[i]] != i}
    found = [tuple(r) for r in near_pairs(make(rows).repartition(6)).collect()]
    assert len(found) == len(want) and {(a, b): n for a, b, n in found} == want and len(want) > 50
    told = [tuple(r) for r in near_groups(make(rows).repartition(6)).collect()]
    assert len(told) == len(rows) and {r[0]: r[1:] for r in told} == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_long_lists_are_short_lists(seed):
    """Bit operations on what sets signatures apart against comparing whole signatures."""
    rng = np.random.default_rng(seed)
    n, own = 150, 4
    sig = np.tile(rng.integers(0, 5, mj.COORDS, np.uint32), (n, 1))
    away = rng.random((n, mj.COORDS)) < rng.random((n, 1)) * 0.9
    sig[away] = rng.integers(0, 6, int(away.sum()), np.uint32)
    mask = np.array([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)], np.int64)
    same = sig[:, None, :] == sig[None, :, :]
    bit = np.array([[bool(int(m) >> c & 1) for c in range(mj.COORDS)] for m in mask])
    want = (same.sum(axis=2) >= mj.MATCHES) & ~(same & bit[:, None] & bit[None, :])[:, :, :own].any(axis=2)
    later = np.triu(np.ones((n, n), bool), 1)
    got = np.concatenate([m for _, m in mj._long(sig, mask, own, np.zeros(n, bool), True, mj.MATCHES)])
    assert (got == (want & later)).all() and got.any()
    i, j, _ = (np.concatenate(x) for x in zip(*mj._small(sig, mask, np.full(n, own), np.array([0]), np.array([n]), mj.MATCHES)))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want & later))))
    other = np.arange(n) % 3 == 0
    across = np.concatenate([m for _, m in mj._long(sig, mask, own, other, False, mj.MATCHES)])
    assert (across == want[np.ix_(~other, other)]).all()


def test_labels_are_components():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    label = np.arange(400)
    mj._unite(label, i, j)
    want = np.arange(400)
    while True:
        low = np.minimum(want[i], want[j])
        before = want.copy()
        np.minimum.at(want, i, low)
        np.minimum.at(want, j, low)
        if (want == before).all():
            break
    assert (label == want).all()


def test_repeated_identifiers_are_one_document(make):
    """Different near texts under one identifier: the least text stands for it, each pair comes once."""
    base = [f"w{i}" for i in range(80)]
    text = lambda k: " ".join([f"a{k}", *base, f"z{k}"])
    rows = [(1, text(3)), (1, text(1)), (1, text(2)), (2, text(5)), (2, text(4)), (3, text(6)), (9, "other words entirely")]
    least = {1: text(1), 2: text(4), 3: text(6), 9: rows[-1][1]}
    want = {(a, b): n for a in least for b in least if a < b and (n := agree(signature(least[a]), signature(least[b]))) >= mj.MATCHES}
    got = [tuple(r) for r in near_pairs(make(rows)).collect()]
    assert len(got) == len(want) == 3 and {(a, b): n for a, b, n in got} == want
    assert {r["doc_id"]: tuple(r)[1:] for r in near_groups(make(rows)).collect()} == brute(list(least.items()))
    kept = sorted((r["doc_id"], r["text"]) for r in drop_near_duplicates(make(rows)).collect())
    assert kept == sorted([(1, text(1)), (1, text(2)), (1, text(3)), (2, text(5)), rows[-1]])


def test_query_is_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_minhash_near_dedup(spark, SMALL).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows) and any(links for _, _, links in got.values())


def test_recall_against_jaccard(make):
    rows = corpus(2)
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    true = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    far = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) < 0.3 * len(sets[a] | sets[b])]
    group = {}
    for r in near_groups(make(rows)).collect():
        group[r["doc_id"]] = r["group_id"]
    hit = sum(group.get(a, -1) == group.get(b, -2) for a, b in true)
    assert len(true) > 50 and hit >= 0.9 * len(true)
    pairs = {(r["doc_a"], r["doc_b"]) for r in near_pairs(make(rows)).collect()}
    assert not pairs & set(far)


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(edges, "doc_a bigint, doc_b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_edges(edges, nothing):
    pairs = {(r["doc_a"], r["doc_b"]) for r in near_pairs(edges).collect()}
    assert (1, 2) in pairs and (6, 7) in pairs
    assert not {3, 4, 5, 10} & {x for p in pairs for x in p}
    kept = drop_near_duplicates(edges)
    assert kept.dtypes == edges.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 3, 4, 5, 6, 8, 10} <= set(ids) and ids.count(None) == 2 and not {2, 7} & set(ids) and ids.count(8) == 2
    groups = {r["doc_id"]: tuple(r)[1:] for r in near_groups(edges).collect()}
    assert set(groups) == set(range(1, 13)) and groups[3] == (3, 3, 0) and groups[2][:2] == (1, 1) and groups[8] == (8, 8, 0)
    assert near_groups(nothing).count() == 0
    assert near_pairs(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0
