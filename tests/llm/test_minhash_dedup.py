from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from test_near_duplicates_stage import grams_of
from test_ngram_join import corpus

from galley.llm import minhash_dedup as M

SCHEMA = "doc_id bigint, text string, node bigint, key string, signature int, label bigint"


def brute(rows, percent=85, width=5):
    sets = [grams_of(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    named = lambda i, d: (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else d
    return sorted(((d, len(sets[i]), named(i, d), d == named(i, d)) for i, (d, _) in enumerate(rows)), key=str)


def query(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "k", 7, 3) for r in rows], SCHEMA)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, M.op13_query(spark, str(tmp_path)).collect()), key=str)


def test_signatures_estimate_likeness_and_bands_meet():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 64, 5000, np.uint64)
    for share in (0.0, 0.5, 0.9, 1.0):
        b = np.concatenate([a[: int(5000 * share)], rnd.integers(0, 1 << 64, 5000 - int(5000 * share), np.uint64)])
        jaccard = share / (2 - share)
        agreed = int((M.signature(a) == M.signature(b)).sum())
        assert abs(agreed / M.MINIMA - jaccard) < 0.14
    assert (M.signature(a) == M.signature(np.concatenate([a, a])[::-1])).all()
    bands = M.MINIMA // M.ROWS
    assert (1 - 0.85**M.ROWS) ** bands < 1e-8 and 1 - (1 - 0.2**M.ROWS) ** bands < 0.011
    assert 90 < M.least_agreement(85) < 120 < M.least_agreement(85, missed=0.01)


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force(spark, tmp_path, seed):
    texts = [t for _, t in corpus(seed)]
    rows = [*zip(random.Random(seed).sample(range(2000), len(texts)), texts, strict=True)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_links_at_the_threshold(spark, tmp_path):
    rows, at = [], 0
    for n in (6, 7, 20, 100, 101):  # shingles; a tail of k words takes k of them
        for k in range(n // 4):
            words = [f"w{at}_{i}" for i in range(n + 4)]
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[: len(words) - k])), (at + 2, " ".join([*words, *(f"z{at}_{i}" for i in range(k))]))]
            at += 10
    assert query(spark, rows, tmp_path) == brute(rows)


def test_large_group_of_near_copies_that_form_a_chain(spark, tmp_path):
    rnd = random.Random(8)
    words, rows = [f"a{i}" for i in range(300)], []
    for i in range(400):  # each differs from the one before in a few words
        words = words[:]
        words[rnd.randrange(300)] = f"b{i}"
        rows.append((i * 3, " ".join(words)))
    rnd.shuffle(rows)
    rows += [(5000 + i, rows[0][1]) for i in range(300)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    one = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (1, ""), (2, " \t"), (3, "a"), (4, "A"), (5, "a b c d"), (6, "a\tB\nc  d"), (7, one), (7, one + " x"), (None, one), (None, "alone here"), (8, "alone  here"),
            (None, "no id at all"), (9, one * 3_000)]
    assert query(spark, rows, tmp_path) == brute(rows)
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
