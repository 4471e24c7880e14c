import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import MIDDLE, SMALL
from pyspark.sql import functions as F

from test_minhash_join import word_hash

from weftline.llm import ordinal_toxicity as ot
from weftline.llm import pu_quality as pu
from weftline.llm import queries

LABELS = "doc_id bigint, quality int, toxic int"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    truth = np.asarray(truth, bool)
    return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


@pytest.fixture(scope="module")
def split(spark):
    """(documents, labels to fit on, labels held out)."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    return docs, labels.filter(part > 0), labels.filter(part == 0)


INSULTS = ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid")


def test_toxicity_on_held_out_documents(split):
    """A fifth of the toxic documents have no word of this list but rare words of other languages, hard to learn from so few."""
    docs, known, held = split
    rows = ot.severity(docs, known).join(held, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert auc([r["expected_severity"] for r in rows], [r["toxic"] for r in rows]) > 0.85
    insults = {r["doc_id"]: sum(w in r["text"].lower() for w in INSULTS) for r in rows}
    hard, none = [r for r in rows if insults[r["doc_id"]] >= 3], [r for r in rows if not r["toxic"]]
    assert len(hard) >= 8 and np.mean([r["is_toxic"] for r in hard]) >= 0.9
    assert np.mean([r["is_toxic"] for r in none]) <= 0.02
    assert all(0 <= r["expected_severity"] <= ot.GRADES - 1 for r in rows)


def test_ordinal_gradient():
    rng = np.random.default_rng(3)
    row, feature = np.sort(rng.integers(0, 50, 160)), rng.integers(0, 9, 160)
    grade = rng.integers(0, 4, 50)
    params = rng.normal(scale=0.5, size=9 + 3)
    value, grad = ot.likelihood(params, row, feature, grade, 9)
    total = 0.0
    theta = [params[9], params[9] + math.exp(params[10]), params[9] + math.exp(params[10]) + math.exp(params[11])]
    for i in range(50):
        z = sum(params[f] for r, f in zip(row, feature) if r == i)
        upto = [0.0, *(sigmoid(t - z) for t in theta), 1.0]
        total -= math.log(upto[grade[i] + 1] - upto[grade[i]]) / 50
    assert value == pytest.approx(total + 0.5 * ot.L2 * (params[:9] @ params[:9]), abs=1e-10)
    for j in range(12):
        step = np.zeros(12)
        step[j] = 1e-6
        assert (ot.likelihood(params + step, row, feature, grade, 9)[0] - ot.likelihood(params - step, row, feature, grade, 9)[0]) / 2e-6 == pytest.approx(grad[j], abs=1e-6)


def test_toxicity_query_is_brute_force(spark):
    """Scores of all documents from the fitted weights, word by word in plain Python."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = ot.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SMALL).collect()}
    rows = docs.select("doc_id", F.lower("text").alias("text")).collect()
    assert len(got) == len(rows)
    for r in rows:
        words = {word_hash(w) >> (64 - ot.BITS) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r["text"] or "").encode())}
        z = sum(float(model.weights[f]) for f in words)
        above = [sigmoid(z - t) for t in model.thresholds]
        assert got[r["doc_id"]]["expected_severity"] == pytest.approx(sum(above), abs=2e-6)
        assert got[r["doc_id"]]["grade"] == sum(x >= 0.5 for x in above)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    strength = rng.normal(size=600)
    grade = np.digitize(strength + rng.normal(scale=0.3, size=600), [-0.5, 0.5, 1.2])
    bins = np.digitize(strength, np.linspace(-2, 2, 9))
    model = ot.fit_ordinal(np.arange(600), bins, grade, 10)
    assert (np.diff(model.thresholds) > 0).all()
    expected = (1 / (1 + np.exp(-(model.weights[bins][:, None] - model.thresholds)))).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


def test_quality_on_held_out_documents(split):
    docs, known, held = split
    rows = pu.quality(docs, known).join(held.filter("toxic = 0"), "doc_id").collect()
    assert auc([r["quality_score"] for r in rows], [r["quality"] == 1 for r in rows]) > 0.85
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) > 0.85


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (3000, 2))
    u = np.concatenate([rng.normal(2, 1, (1200, 2)), bad[:1800]])
    model = pu.train_on(good, u)
    assert 0.3 < model.prior < 0.5
    assert (model.score(good) > 0).mean() > 0.95 and (model.score(bad) > 0).mean() < 0.1


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_is_brute_force(spark, prior):
    """The risk and its gradient over a table, against plain loops over its rows and against differences."""
    rng = np.random.default_rng(5)
    bins, p = rng.integers(0, pu.BINS, (300, pu.N_FEATURES)), pu._places(rng.integers(0, pu.BINS, (40, pu.N_FEATURES)))
    params = rng.normal(scale=0.4, size=pu.N_FEATURES * pu.BINS + 1) - 0.1
    rows = spark.createDataFrame([(i % 2, bytes(b.astype(np.uint8))) for i, b in enumerate(bins)], "fold int, bins binary").repartition(3)
    table, local = pu.TableRows(rows), pu.Rows(pu._places(bins), np.arange(300) % 2)
    score = lambda b: sum(params[j] for j in b) + params[-1]
    positive = [score(b) for b in p]
    unlabelled = [score(b) for b in pu._places(bins)]
    mean = lambda xs: sum(xs) / len(xs)
    ridge = 0.5 * pu.L2 * sum(w * w for w in params[:-1])
    want = prior * mean([sigmoid(-z) for z in positive]) + max(0.0, mean([sigmoid(z) for z in unlabelled]) - prior * mean([sigmoid(z) for z in positive])) + ridge
    for u in (table, local):
        value, grad = pu.non_negative_risk(p, u, prior)(params)
        assert value == pytest.approx(want, abs=1e-12)
        assert pu.telling_risk(p, u, 1)(params)[0] == pytest.approx(mean([math.log1p(math.exp(-z)) for z in positive]) + mean([math.log1p(math.exp(z)) for z in unlabelled[1::2]]) + ridge, abs=1e-12)
    for risk in (pu.non_negative_risk(p, local, prior), pu.telling_risk(p, local, 0)):
        value, grad = risk(params)
        for j in (0, 17, 100, 207, 208):
            step = np.zeros_like(params)
            step[j] = 1e-5
            assert (risk(params + step)[0] - risk(params - step)[0]) / 2e-5 == pytest.approx(grad[j], abs=1e-7)
    cuts = np.unique(positive)
    assert table.passed(params, cuts, 0).tolist() == local.passed(params, cuts, 0).tolist() == np.bincount([sum(z >= c for c in cuts) for z in unlabelled[::2]], minlength=len(cuts) + 1).tolist()


def test_quality_query_is_a_fit_on_all_unlabelled_documents(spark):
    """The registered query against a fit in this process on every document without a label."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")).collect()
    x = pu.text_features(pa.array([r["text"] for r in rows], pa.string()))
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    known = {r["doc_id"] for r in labels.filter("quality IS NOT NULL").collect()}
    ids = [r["doc_id"] for r in rows]
    p, u = np.array([i in good for i in ids]), np.array([i not in known for i in ids])
    order = np.lexsort((*x[p].T, np.array(ids)[p]))
    edges = pu.bin_edges(spark.createDataFrame([(v.tobytes(),) for v in x[p | u]], "x binary"))
    model = pu.train_on(x[p][order], x[u], edges, np.array([r["fold"] for r in rows])[u])
    want = dict(zip(ids, 1 / (1 + np.exp(-model.score(x)))))
    got = {r["doc_id"]: r["quality_score"] for r in queries.op8_quality(spark, SMALL).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in ids) < 1e-4 and u.sum() > 50


def test_bin_edges_are_quantiles(spark):
    x = np.random.default_rng(2).lognormal(size=(3000, pu.N_FEATURES))
    x[::3, 4] = 0
    rows = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").repartition(3)
    want = np.quantile(x, np.linspace(0, 1, pu.BINS + 1)[1:-1], axis=0).T
    assert np.allclose(pu.bin_edges(rows), want, rtol=0.01)


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_edges(spark, edges, nothing, operator):
    run = ot.severity if operator == "toxicity" else pu.quality
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (6, 0, 0), (9, 1, 0), (77, 1, 1)], LABELS)
    empty = spark.createDataFrame([], LABELS)
    for known in (labels, empty):
        rows = run(edges, known).collect()
        assert len(rows) == edges.count()
        assert all(r[1] is not None and 0 <= r[1] <= 3 for r in rows)
    assert run(nothing, labels).count() == 0 and run(nothing, empty).count() == 0
    same = {r[1] for r in run(edges, labels).collect() if r["doc_id"] == 8}
    assert len(same) == 1
    assert {r[1] for r in run(edges, empty).collect()} == ({0.0} if operator == "toxicity" else {1.0})


def test_severity_grows_with_marked_words(make, spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        words[: rng.choice([1, 4, 12]) if bad else 0] = [rng.choice(["vile", "foul", "nasty"]) for _ in range(3)] if bad else []
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    told = {r["doc_id"]: r for r in ot.severity(make([*rows, (9000, "w1 w2 w3"), (9001, "vile foul nasty w1")]), spark.createDataFrame(labels, LABELS)).collect()}
    assert told[9001]["expected_severity"] > told[9000]["expected_severity"] and told[9001]["is_toxic"] and not told[9000]["is_toxic"]
