import base64
import random
import time

import pytest
import tiktoken
from edge_cases import EDGES

from weftline.llm import byte_bpe, queries
from weftline.llm.byte_bpe import Coder, Vocabulary, decode, encode, round_trip, token_counts
from oracle import SMALL


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=dict(zip(vocabulary.tokens, vocabulary.ids.tolist())), special_tokens={})


def encoded(coder, texts):
    tokens, size = coder.encode(texts)
    out, at = [], 0
    for n in size.tolist():
        out.append(tokens[at : at + n].tolist())
        at += n
    assert coder.decode(tokens, size) == [t or "" for t in texts]
    return out


def test_is_the_tokenizer(vocabulary, reference, monkeypatch):
    rng = random.Random(2)
    letters = "etaoin shrdluéñü'日😀\n\t019-=#"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["a" * 999, "ab" * 500, "aaab" * 200, "-" * 3000, " " * 700, "".join(rng.choice("etaoin") for _ in range(2500)), "<|endoftext|> it's", "", None]
    want = [reference.encode_ordinary(t) if t else [] for t in texts]
    texts += ["../" * 400, "=-" * 333, "abcabcd" * 100, "0" * 1000, "é" * 500, "x" + "na" * 300]
    want = [reference.encode_ordinary(t) if t else [] for t in texts]
    for piece, tail in ((64, 16), (100, 40)):
        monkeypatch.setattr(byte_bpe, "PIECE", piece)
        monkeypatch.setattr(byte_bpe, "TAIL", tail)
        coder = Coder(vocabulary)
        assert encoded(coder, texts) == want
        assert encoded(coder, texts) == want  # words known by now


@pytest.mark.parametrize("kind", ["letter", "letters", "base64", "dots", "spaces"])
def test_very_long_words(vocabulary, reference, kind):
    """Words without a break of 1 to 5 MB, within the memory bound and a minute."""
    rng = random.Random(4)
    text = {
        "letter": lambda: "a" * 5_000_000,
        "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)),
        "base64": lambda: base64.b64encode(rng.randbytes(750_000)).decode(),
        "dots": lambda: "../" * 700_001,
        "spaces": lambda: "x" + " " * 1_000_003,
    }[kind]()
    began = time.perf_counter()
    (tokens,) = encoded(Coder(vocabulary), [text])
    assert time.perf_counter() - began < 60
    some = text[:60_000]
    want = reference.encode_ordinary(some)
    assert tokens[: len(want) - 200] == want[:-200]
    assert encoded(Coder(vocabulary), [some]) == [want]


def test_another_vocabulary(reference):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    v = Vocabulary(path)
    ref = tiktoken.Encoding("multi", pat_str=byte_bpe.PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ids.tolist())), special_tokens={})
    text = "Où est l'été? Straße 1234 これは"
    assert encoded(Coder(v), [text]) == [ref.encode_ordinary(text)]


def test_query_round_trips(spark):
    rows = queries.op5_byte_bpe(spark, SMALL).collect()
    assert rows and all(r["decodes"] in (True, None) and (r["n_tokens"] or 0) == len(r["token_ids"] or []) for r in rows)


def test_edges(edges, nothing, reference):
    rows = encode(edges).collect()
    want = [None if t is None else reference.encode_ordinary(t) for _, t, *_ in EDGES]
    assert sorted((repr((r["doc_id"], r["token_ids"])) for r in rows)) == sorted(repr((e[0], w)) for e, w in zip(EDGES, want))
    back = decode(encode(edges)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in back) == sorted(repr((e[0], e[1])) for e in EDGES)
    counted = {repr((r["doc_id"], r["n_tokens"])) for r in token_counts(edges).collect()}
    assert counted == {repr((e[0], None if w is None else len(w))) for e, w in zip(EDGES, want)}
    assert encode(nothing).count() == 0 and decode(encode(nothing)).count() == 0 and round_trip(nothing).count() == 0


def test_unknown_tokens_are_an_error(vocabulary):
    import numpy as np

    with pytest.raises(ValueError):
        Coder(vocabulary).decode(np.array([99_999]), np.array([1]))
