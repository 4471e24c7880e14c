"""The pipeline against a version of each stage by brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from test_fingerprint_lsm import brute as brute_repeats
from test_packing import check

import corpus_pipeline
from weftline.llm import byte_bpe
from weftline.llm import minhash_join as mj
from weftline.llm.language_id import identify

EN, FR = "the of and to in is that with for was on are as at be this have from".split(), "le la les de des et un une dans pour que qui sur avec est pas par au".split()


def corpus(seed=8):
    rng = random.Random(seed)
    stems = {"en": EN + [f"{a}{b}" for a in ("wor", "think", "great", "light") for b in ("ing", "ness", "ly", "ed")], "fr": FR + [f"{a}{b}" for a in ("mang", "parl", "fin", "beau") for b in ("eaux", "ment", "tion", "aient")]}
    prose = lambda lang, n: [rng.choice(stems[lang]) + (f"{rng.choice('bcdf')}{rng.choice(stems[lang])}" if rng.random() < 0.5 else "") for _ in range(n)]
    passage = prose("en", 70)
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "fr"])
        rows.append([" ".join(prose(lang, rng.randint(60, 160))), lang])
    for i in range(0, 12):
        rows.append(list(rows[i]))  # exact copies
    for i in range(20, 32):
        words = rows[i][0].split()
        words[len(words) // 2] = "changed"
        rows.append([" ".join(words), rows[i][1]])  # near copies
    for i in range(40, 46):
        rows.append([" ".join(prose("en", 90) + passage + prose("en", 40)), "en"])  # a shared passage
    rows += [["zqxj kvvx qqzz wxkq vqjz xxzq", "en"], ["", "en"], [None, "en"]]
    rng.shuffle(rows)
    return [(i, t, k) for i, (t, k) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, k, "s", None if t is None else len(t)) for i, t, k in corpus()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_is_the_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    accepted = {r["doc_id"] for r in identify(docs).filter("accepted").collect()}
    assert len(texts) - 12 <= len(accepted) < len(texts)
    first = {}
    for i in sorted(accepted):
        first.setdefault(texts[i], i)
    kept = sorted(first.values())
    table = pa.array([texts[i].lower() for i in kept])
    sig = {}
    for batch in mj._signatures(mj.COORDS, mj.SHINGLE)([pa.RecordBatch.from_arrays([pa.array(kept), table], ["id", "text"])]):
        for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sig[i] = np.frombuffer(s, np.uint32)
    group = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if a < b and (sig[a] == sig[b]).sum() >= mj.MATCHES:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    alone = [i for i in kept if group[i] == i]
    assert len(kept) - 14 <= len(alone) <= len(kept) - 8
    cut = brute_repeats([(i, texts[i]) for i in alone])
    left = {i: " ".join(w for j, w in enumerate(texts[i].split()) if j not in cut[i]) for i in alone}
    assert sum(map(bool, cut.values())) >= 5
    found = corpus_pipeline.run(spark, folder)
    rows = found.selectExpr("pack_id", "inline(pieces)").collect()
    v = byte_bpe.Vocabulary()
    tokenizer = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ids.tolist())), special_tokens={})
    check(rows, [(i, cut_text(texts[i], cut[i])) for i, t in left.items() if t], 2048, lambda t: len(tokenizer.encode_ordinary(t)))
    assert {r["doc_id"] for r in rows} == {i for i, t in left.items() if t}


def cut_text(text, gone):
    """The text without the words at these places, as the stage leaves it."""
    out, at = [], 0
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    for j, run in itertools.groupby(range(len(spans)), lambda k: k in gone):
        places = list(run)
        if j:
            out.append(text[at : spans[places[0]][0]])
            at = spans[places[-1]][1]
    return "".join([*out, text[at:]]).strip()


def test_stages_take_awkward_rows(spark, edges, nothing):
    """Each stage on what the one before left of null, empty and very long texts, repeated identifiers and clashing columns."""
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.dtypes == edges.dtypes
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {d for r in packs.collect() for d in r["doc_ids"]} == {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in edges.collect()}


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
