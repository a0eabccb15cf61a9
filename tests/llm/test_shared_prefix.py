from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from galley.llm import shared_prefix as X

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def texts():
    rnd = random.Random(3)
    letters = "abcdeéß ▁\n\t  .,x1ñ学\U0001f600THEthe \x00​"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    out += [" " * n for n in range(40)] + [" " * n + "the" for n in range(40)] + [" " * n + "é x" for n in range(9)]
    return [*out, "a" * 3000, "the end" * 50, "internationalisation of the internationals", " " * 5000 + "x"]


def test_ids_equal_the_library(library):
    known = X.vocabulary(MODEL)
    for ids, text in zip(known.encode(texts()), texts()):
        assert ids == library.encode(text), text
        assert known.decode(ids) == text.replace(X.MARK, " ")


def test_forgetting_does_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 50)
    monkeypatch.setattr(X, "REMEMBERED_PAIRS", 20)
    known = X.Vocabulary(*[getattr(X.vocabulary(MODEL), n) for n in ("pieces", "scores", "byte_ids", "unknown")])
    some = texts()[:300]
    for k in range(0, 300, 60):
        assert known.encode(some[k : k + 60]) == [library.encode(t) for t in some[k : k + 60]]


def test_states_of_shared_prefixes_are_reused(monkeypatch):
    known = X.Vocabulary(*[getattr(X.vocabulary(MODEL), n) for n in ("pieces", "scores", "byte_ids", "unknown")])
    steps = []
    plain = X.Vocabulary._extend
    monkeypatch.setattr(X.Vocabulary, "_extend", lambda self, w, last, starts: (steps.append(len(w) + 1 - len(last)), plain(self, w, last, starts))[1])
    known.learn(["interna", "internal", "internals", "internally", "zoo"])
    assert sum(steps) == len("internals") + len("ly") + len("zoo")


def test_documents(spark, library):
    rows = [*enumerate(texts()[:200]), (7, None), (None, "x"), (3, texts()[3]), (999, "long text " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, ids int, n_pieces string").repartition(3)
    want = sorted([(i, len(e), zlib.crc32(np.array(e, "<u4").tobytes()), True) for i, t in rows for e in [library.encode(t or "")]], key=str)
    encoded = X.encode_documents(docs)
    assert sorted(map(tuple, encoded.drop("ids").collect()), key=str) == want
    back = sorted(map(tuple, X.decode_documents(encoded).collect()), key=str)
    assert back == sorted([(i, (t or "").replace(X.MARK, " ")) for i, t in rows], key=str)


def test_empty_table(spark):
    assert X.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
