import random
import re

import numpy as np
import pytest
from edge_cases import EDGES

from weftline.llm import bytewords as bw
from weftline.llm.syncmers import K, S, fingerprints, positional_matches


def hashed(words, width):
    """Hashes of the runs of ``width`` words, one by one."""
    out = []
    for i in range(len(words) - width + 1):
        raw = " ".join(words[i : i + width]).encode()
        buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
        starts, ends, first = bw.words(buf, np.array([0, len(raw)]), bw.ALNUM)
        out.append(int(bw.window_hashes(bw.hash_spans(buf, starts, ends), first, width)[1].view(np.int64)[0]))
    return out


def brute(text, k, s):
    words = [w for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", (text or "").lower().encode()) if w]
    words = [w.decode() for w in words]
    big, small = hashed(words, k), [h % (1 << 64) for h in hashed(words, s)]
    chosen = [i for i in range(len(big)) if min(small[i : i + k - s + 1]) in (small[i], small[i + k - s])]
    return len(words), chosen, [big[i] for i in chosen]


@pytest.mark.parametrize(("k", "s"), [(K, S), (5, 1), (8, 3)])
def test_is_brute_force(make, k, s):
    rng = random.Random(k)
    rows = [(i, " ".join(rng.choice(["Aa", "b", "c1", "été", "dd,", "(e)"]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    got = {r["doc_id"]: (r["n_words"], r["positions"], r["anchors"]) for r in fingerprints(make(rows).repartition(3), k=k, s=s).collect()}
    assert got == {i: brute(t, k, s) for i, t in rows}


def test_anchors_are_free_of_context_and_dense(make):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage = [word() for _ in range(60)]
    docs = make([(1, " ".join([word() for _ in range(33)] + passage)), (2, " ".join(passage + [word() for _ in range(50)])), (3, " ".join(word() for _ in range(100)))])
    found = fingerprints(docs)
    for r in found.collect():
        gaps = np.diff([-1, *r["positions"], r["n_words"] - K + 1])
        assert gaps.max() <= K - S + 1
    pairs = positional_matches(found.filter("doc_id = 1"), found.filter("doc_id > 1")).collect()
    assert [(r["left_id"], r["right_id"], r["shift"]) for r in pairs] == [(1, 2, -33)] and pairs[0]["n_anchors"] >= 4


def test_edges(edges, nothing):
    rows = fingerprints(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[i]["positions"] == [] and by[i]["anchors"] == [] for i in (3, 4, 5, 8, 10, 12))
    assert by[6]["anchors"] == by[7]["anchors"] and by[6]["n_words"] == 60_000 and by[3]["n_words"] == 0
    assert fingerprints(nothing).count() == 0


def test_parameters(edges):
    for k, s in ((4, 2), (8, 8), (8, 0)):
        with pytest.raises(ValueError):
            fingerprints(edges, k=k, s=s)
