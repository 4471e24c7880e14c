import random

import oracle
from oracle import SMALL
import pytest


from weftline.llm import grace_dedup, queries
from weftline.llm.grace_dedup import ContentTable, drop_exact_duplicates, exact_groups


def test_matches_sql(spark):
    got, want = oracle.compare(spark, queries.op3_exact_dedup, grace_dedup.SQL, SMALL)
    assert got == want and got


@pytest.mark.parametrize(("budget", "broadcast_keys", "hot"), [(1, 0, 1000), (500, 1000, 1000), (1 << 20, 1000, 15), (500, 0, 3)])
def test_is_brute_force_however_often_it_spills(make, budget, broadcast_keys, hot):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "", "y" * 300, f"z{rng.randint(0, 40)}", None])) for i in range(400)]
    first = {}
    for i, t in rows:
        if t is not None:
            first.setdefault(t, i)
    want = sorted((i, i if t is None else first[t], t is not None and first[t] != i) for i, t in rows)
    docs = make(rows).repartition(5)
    got = exact_groups(docs, budget=budget, broadcast_keys=broadcast_keys, hot_copies=hot)
    assert sorted(tuple(r) for r in got.collect()) == want
    kept = drop_exact_duplicates(docs, budget=budget, broadcast_keys=broadcast_keys, hot_copies=hot)
    assert kept.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, k, dup in want if not dup]


def test_equal_hashes_are_compared():
    table = ContentTable(10)
    assert table.find(7, b"aaaa") == (0, True) and table.find(7, b"bbbb", False) == (-1, False)
    assert table.find(7, b"aaaa") == (0, False)
    big = ContentTable(1 << 30)
    assert [big.find(i % 3, str(i).encode())[0] for i in range(5000)] == list(range(5000))
    assert all(big.find(i % 3, str(i).encode()) == (i, False) for i in range(5000))


def test_edges(edges, nothing):
    told = exact_groups(edges).collect()
    assert len(told) == edges.count()
    dup = [r["doc_id"] for r in told if r["is_duplicate"]]
    assert sorted(dup, key=repr) == sorted([2, 7, 8, None], key=repr)
    kept = drop_exact_duplicates(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 4
    assert sorted(map(tuple, exact_groups(edges, hot_copies=2).collect()), key=repr) == sorted(map(tuple, told), key=repr)
    assert drop_exact_duplicates(edges, hot_copies=2).count() == edges.count() - 4
    assert exact_groups(nothing).count() == 0 and drop_exact_duplicates(nothing).count() == 0
