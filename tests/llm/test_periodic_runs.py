from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from galley.llm import periodic_runs as P


def brute_runs(words):
    """Every (start, length, period), by trying all periods at all places."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def row_by_hand(doc_id, text, rewrite=True):
    w = words_of(text)
    if rewrite and w and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def found(words):
    return [(s, e - s, q) for s, e, q in P.runs_of_texts([[w.encode() for w in words]])[0]]


def texts(seed):
    rnd = random.Random(seed)
    word = lambda k: rnd.choice("abcdefghijklmnopqrstuvwxyz"[:k])
    for k in (1, 2, 3, 5, 26):
        for n in (0, 5, 11, 12, 13, 30, 90, 200):
            yield [word(k) for _ in range(n)]
    for _ in range(60):
        out = [word(26) for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(1, 5)):  # periods with errors, next to and inside one another
            block = [word(rnd.choice((2, 26))) for _ in range(rnd.randrange(1, 40))]
            n = rnd.randrange(len(block), 5 * len(block) + 14)
            part = [block[i % len(block)] for i in range(n)]
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "x"
            out += part * rnd.choice((1, 1, 2)) + [word(26) for _ in range(rnd.randrange(20))]
        yield out
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    thue = "0"
    for _ in range(9):
        thue += thue.translate({48: 49, 49: 48})
    yield list(thue)
    # every phrase and every junction comes twice in a period: the next equal words are nearer than the period
    p, q, r = (["%s%d" % (c, i) for i in range(20)] for c in "pqr")
    yield (p + q + r + p + q + r + p + r + q + p + r + q) * 3


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    for words in texts(seed):
        assert found(words) == brute_runs(words), words


def test_documents_are_searched_apart():
    lists = [[w.encode() for w in t] for t in texts(9)]
    assert [[(s, e - s, q) for s, e, q in r] for r in P.runs_of_texts(lists)] == [brute_runs(t) for t in texts(9)]


def test_pieces_that_survive():
    codes = lambda s: np.array([ord(c) for c in s], np.int64)
    one = lambda s: P.surviving(codes(s), np.zeros(len(s), np.int64), 4)
    assert one("ababxcdcdyacacbdbd") == [(0, 4), (5, 9), (10, 18)]
    assert one("abcdefgh") == [] and one("") == []
    # both words come twice in the text, but once in the piece that the others leave
    assert one("mnxxxxumnvyyyym") == [(2, 6), (10, 14)]


def test_long_texts_take_time_in_proportion():
    rnd = random.Random(3)
    for make in (
        lambda n: [b"a"] * n,
        lambda n: [rnd.choice((b"a", b"b")) for _ in range(n)],
        lambda n: ([str(i).encode() for i in range(n // 3)] * 4)[:n],
        lambda n: [b"ab"[c : c + 1] for c in (bin(i).count("1") % 2 for i in range(n))],
    ):
        took = []
        for n in (50_000, 400_000):
            t = time.time()
            P.runs_of_texts([make(n)])
            took.append(time.time() - t)
        assert took[1] < 30 * took[0] + 3, took


ROWS = [
    None, "", " \t\n", "a", "a " * 40, "x y " * 30 + "z", "Ab ab " * 9, "  " * 14, "é😀 b\x0bc\x0cd " * 5, "end",
    "one two three four five six " * 2, "one two three four five " * 2,
]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, ROWS[i % len(ROWS)]) for i in range(80)]
    rows += [(100 + i, " ".join(t)) for i, t in enumerate(texts(4))] + [(7, ROWS[5]), (7, ROWS[5]), (None, ROWS[5])]
    rows += [(1000 + i, " ".join(rnd.choice(["lorem", "ipsum", "dolor", str(j)]) for j in range(rnd.randrange(150)))) for i in range(100)]
    schema = "doc_id bigint, text string, runs string, start int, period int"
    spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op12_query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((row_by_hand(*r) for r in rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op12_query(spark, str(tmp_path)).collect() == []


def test_runs_and_texts_without_rewriting(spark):
    docs = spark.createDataFrame([(10, "k a b a b a b a b a b a b a k"), (20, None)], "id bigint, body string")
    got = {r.doc_id: (r.runs, r.collapsed) for r in P.periodic_runs(docs, "id", "body").collect()}
    assert [tuple(r) for r in got[10][0]] == [(1, 13, 2)] and got[10][1] == "k a b k" and got[20] == ([], "")
