import random

import pytest

from oracle import SMALL

from weftline.llm import queries
from weftline.llm.fingerprint_lsm import FingerprintIndex, cut_repeats, repeated_spans

MIN = 50


def brute(rows, least=MIN):
    """For each document the words that lie in a run of ``least`` words which an earlier document has."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = text.split()
        marked = set()
        for j in range(len(words) - least + 1):
            if tuple(words[j : j + least]) in seen:
                marked.update(range(j, j + least))
        out[i] = marked
        seen.update(tuple(words[j : j + least]) for j in range(len(words) - least + 1))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (50, 51, 60, 80, 200, 49, 30)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 80))]
            if rng.random() < 0.5:
                parts += rng.choice(shared)
        rows.append((i, " ".join(parts)))
    return rows


def marked(found):
    out = {}
    for r in found:
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


@pytest.mark.parametrize("options", [{"batches": 1}, {"batches": 5, "fan_in": 2}])
def test_is_brute_force(make, options):
    rows = corpus()
    want = {i: m for i, m in brute(rows).items() if m}
    found = repeated_spans(make(rows).repartition(5), **options).collect()
    assert marked(found) == want and len(want) > 30
    texts = dict(rows)
    for r in found:  # the document that is named has these very words
        words, held = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]], f" {texts[r['first_doc_id']]} "
        runs = [j for j in range(len(words) - MIN + 1) if f" {' '.join(words[j : j + MIN])} " in held]
        assert r["first_doc_id"] < r["doc_id"] and {k for j in runs for k in range(j, j + MIN)} == set(range(r["n_words"]))


def test_a_stored_index_goes_on(spark, tmp_path):
    """Batches in indexes that are opened anew find what one run finds."""
    rows = corpus(6)
    texts = spark.createDataFrame(rows, "id bigint, text string")
    want = {i: m for i, m in brute(rows).items() if m}
    got = {}
    for low, high in ((0, 40), (40, 90), (90, 150)):
        index = FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=2)
        found, _ = index.add(texts.filter(f"id >= {low} AND id < {high}"), texts.filter(f"id < {high}"))
        for r in found.collect():
            got.setdefault(r["id"], set()).update(range(r["start_word"], r["end_word"]))
        index.close()
    assert got == want
    again = FingerprintIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError):
        again.add(texts.filter("id = 7"), texts)
    again.close()
    with pytest.raises(ValueError):
        FingerprintIndex(spark, f"file://{tmp_path}/index", window=30)


def test_a_passage_of_very_many(spark):
    """A hundred thousand documents share one passage: each is compared with the first alone."""
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.range(100_000).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} z', id) AS text")
    told = repeated_spans(docs).selectExpr("count(*) AS n", "min(first_doc_id) AS a", "max(first_doc_id) AS b", "min(n_words) AS c", "max(n_words) AS d", "count(DISTINCT doc_id) AS ids").first()
    assert tuple(told) == (99_999, 0, 0, 55, 55, 99_999)


def test_names_the_document_that_has_the_words(make):
    """The first document has 50 of the words, the second all 60: each piece names one that has it."""
    words = [f"q{i}" for i in range(60)]
    rows = [(1, " ".join(words[:50])), (2, " ".join(["x", *words])), (3, " ".join(words))]
    got = {(r["doc_id"], r["first_doc_id"], r["start_word"], r["end_word"]) for r in repeated_spans(make(rows)).collect()}
    assert got == {(2, 1, 1, 51), (3, 1, 0, 50), (3, 2, 1, 60)}


def test_finds_a_passage_of_which_the_first_holder_has_a_part(make):
    """The earliest document has 45 of the 50 words: too few for a repeat, yet it holds their windows first."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 120, 3):
        p = [f"p{i}-{j}" for j in range(50)]
        own = lambda k: [f"o{i + k}-{rng.randrange(10**6)}" for _ in range(30)]
        at = rng.randrange(6)
        rows += [(i, " ".join(own(0) + p[at : at + 45] + own(0))), (i + 1, " ".join(own(1) + p + own(1))), (i + 2, " ".join(own(2) + p + own(2)))]
    want = {i: m for i, m in brute(rows).items() if m}
    assert len(want) == 40 and marked(repeated_spans(make(rows).repartition(5)).collect()) == want


def test_finds_the_whole_of_a_run_of_one_word(make):
    zeros = lambda n: ["0"] * n
    tail = [f"t{i}" for i in range(30)]
    rows = [(1, ["a", *zeros(3000), *tail]), (2, ["b", "c", *zeros(2000), *tail, "d"]), (3, [*zeros(60), "x", *zeros(3500), *tail[:20], "y"]), (4, [*zeros(49), "z"] * 3), (5, ["-", "="] * 400), (6, ["q", *["-", "="] * 300, "q"])]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = {i: m for i, m in brute(rows).items() if m}
    assert set(want) == {2, 3, 6} and len(want[2]) == 2030
    assert marked(repeated_spans(make(rows)).collect()) == want


def test_names_the_first_document(make):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(5, f"start {passage}"), (9, f"{passage} end"), (2, f"a b c {passage} d"), (30, "nothing here")]
    got = sorted((r["doc_id"], r["first_doc_id"], r["start_word"], r["end_word"], r["n_words"]) for r in repeated_spans(make(rows)).collect())
    assert got == [(5, 2, 1, 71, 70), (9, 2, 0, 70, 70)]


def test_cut(make):
    passage = "\n".join(f"p{i}" for i in range(70))
    docs = make([(1, f"one {passage} tail"), (2, f"two {passage} rest"), (3, passage), (4, "short text"), (5, None), (6, "")])
    kept = cut_repeats(docs)
    assert kept.dtypes == docs.dtypes
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert texts == {1: (f"one {passage} tail", len(passage) + 9), 2: ("two  rest", 9), 4: ("short text", 10), 5: (None, None), 6: ("", 0)}


def test_cutting_moves_no_document_again(spark, make):
    """Where lists of cuts are too large to broadcast, they move to the documents, and rows of one identifier and of none stay."""
    passage = " ".join(f"p{i}" for i in range(60))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = cut_repeats(make([(1, f"a {passage}"), (2, f"b {passage}"), (2, f"c {passage}"), (None, f"d {passage}"), (None, None)]))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not [x for x in plan.split("\n") if "Exchange" in x and "xxhash64" in x]
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, f"d {passage}"), (1, f"a {passage}"), (2, "b"), (2, f"c {passage}")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges(edges, nothing):
    found = repeated_spans(edges).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in found} == {(7, 6)}
    assert sum(r["n_words"] for r in found) == 60_000
    ids = [r["doc_id"] for r in cut_repeats(edges).collect()]
    assert sorted(ids, key=repr) == sorted([1, 2, 3, 4, 5, 6, 8, 8, None, None, 9, 10, 11, 12], key=repr)
    assert repeated_spans(nothing).count() == 0 and cut_repeats(nothing).count() == 0


def test_query_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert marked(queries.op7_substring_dedup(spark, SMALL).collect()) == {i: m for i, m in brute(docs).items() if m}


def test_the_query_compacts(spark, monkeypatch):
    """As registered, later batches are matched with a compacted run, and no earlier document's runs are hashed once more."""
    compacted, compact = [], FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self, kind: (compacted.append((kind, self.last)), compact(self, kind))[1])
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op7_substring_dedup(spark, SMALL).collect()
    assert {kind for kind, _ in compacted} == {"anchors", "whole"} and max(last for _, last in compacted) < max(i for i, _ in docs)
    assert marked(found) == {i: m for i, m in brute(docs).items() if m}


@pytest.mark.parametrize("fan_in", [2, 3, 9])
def test_holders_in_every_order_of_batches(spark, tmp_path, fan_in):
    """First holders that are alone, joined in their own batch, joined later, and joined once more after compactions."""
    rng = random.Random(fan_in)
    passages = [[f"p{k}-{j}" for j in range(rng.choice((45, 50, 58)))] for k in range(40)]
    rows = []
    for i in range(120):
        words = []
        for p in rng.sample(passages, 2):
            words += [f"o{i}-{rng.randrange(10**6)}" for _ in range(rng.randint(0, 20))] + p[: rng.choice((45, 50, 58))]
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "id bigint, text string")
    got, index = {}, FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=fan_in)
    for low in range(0, 120, 20):
        for r in index.add(texts.filter(f"id >= {low} AND id < {low + 20}"), texts.filter(f"id < {low + 20}"))[0].collect():
            got.setdefault(r["id"], set()).update(range(r["start_word"], r["end_word"]))
    index.close()
    assert got == {i: m for i, m in brute(rows).items() if m}


def test_compaction_keeps_a_row_a_hash(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    texts = spark.range(600).selectExpr("id", f"concat('a', id, ' {passage} z', id) AS text")
    index = FingerprintIndex(spark, fan_in=3)
    for low in (0, 200, 400):
        index.add(texts.filter(f"id >= {low} AND id < {low + 200}"), texts.filter(f"id < {low + 200}"))
    for runs in index.runs.values():
        assert len(runs) == 1
        table = spark.table(runs[0][0])
        assert table.count() == table.select("h").distinct().count()
    index.close()
