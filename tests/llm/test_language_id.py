import oracle
from oracle import SMALL
import pytest


from weftline.llm import language_id, queries
from weftline.llm.language_id import accepted_documents, identify, train

TEXTS = {"en": "the cat and the dog sat on the mat with the other animals", "fr": "le chat et le chien sont assis sur le tapis avec les animaux", "de": "der hund und die katze sitzen auf der matte mit den tieren"}


def _rows():
    return [(i, f"{TEXTS[k]} {TEXTS[k]}", k) for i, k in enumerate(list(TEXTS) * 5)]


def test_matches_sql(spark):
    got, want = oracle.compare(spark, queries.op1_language_id, language_id.SQL, SMALL)
    assert got == want and got


def test_tells_languages_and_rejects_strange_texts(make):
    model = train(make(_rows()))
    asked = make([(100, "the dog and the cat", "xx"), (101, "le chien et le chat", "xx"), (102, "zzqx wvkj qqqq zxzx", "en"), (103, "12345 --- !!", "en")])
    told = {r["doc_id"]: r for r in identify(asked, model).collect()}
    assert (told[100]["pred_lang"], told[101]["pred_lang"]) == ("en", "fr")
    assert told[100]["accepted"] and told[101]["accepted"] and not told[102]["accepted"] and not told[103]["accepted"]
    assert told[103]["pred_lang"] == "und" and told[103]["score"] is None


def test_backoff_is_that_of_brute_force(make):
    model = train(make(_rows()))
    for word in ("catx", "chienne", "q", "tiere"):
        scores, n = model.unseen(word)
        padded = f"_{word}_"
        for g in range(model.longest, 0, -1):
            grams = [padded[i : i + g] for i in range(len(padded) - g + 1)]
            known = [model.grams[g - 1][x] for x in grams if x in model.grams[g - 1]]
            if known:
                assert n == g and (scores == sum(known) // len(known)).all()
                break
        else:
            assert n == 0


def test_edges(edges, nothing, make):
    rows = identify(edges).collect()
    assert len(rows) == edges.count()
    assert all(r["pred_lang"] == "und" and not r["accepted"] for r in rows if r["doc_id"] in (3, 4, 5, 10))
    kept = accepted_documents(edges)
    assert kept.columns == edges.columns and kept.dtypes == edges.dtypes
    assert identify(nothing).count() == 0 and accepted_documents(nothing).count() == 0
    unlabelled = make([(1, "some words here", None), (2, None, None)])
    assert [r["accepted"] for r in identify(unlabelled).collect()] == [False, False]


@pytest.mark.parametrize("lang", ["en"])
def test_one_language(make, lang):
    rows = identify(make([(1, TEXTS[lang], lang), (2, TEXTS[lang], lang)])).collect()
    assert all(r["margin"] is None and r["accepted"] for r in rows)
