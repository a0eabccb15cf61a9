from __future__ import annotations

import numpy as np
import pytest

from galley.llm import prefix_forest as P

SCHEMA = "vec_id bigint, embedding array<float>, rank int, shard int, block string, vector string"


def exact(rows, queries, k=10):
    out = {}
    for q in queries:
        own = [np.array(v, np.float32).astype(float) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            v = np.array(v, np.float32).astype(float)
            for o in own:
                if i != q and len(o) == len(v):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - o) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def run(spark, rows, queries, **how):
    points = spark.createDataFrame([(i, v, 1, 2, "c", "d") for i, v in rows], SCHEMA).repartition(3)
    asked = points.where(P.F.col("vec_id").isin(list(queries)))
    got = {}
    for r in P.search(points, asked, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_few_rows_are_all_found_in_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (19, rows[3][1]), (3, rows[3][1]), (3, rows[5][1])]
    bad = [(30, None), (31, []), (32, [0.0] * 8), (33, [float("nan")] + [1.0] * 7), (34, [float("inf")] + [1.0] * 7), (35, [None] + [1.0] * 7), (None, [1.0] * 8)]
    other = [(40, [1.0, 2.0]), (41, [2.0, 2.0])]
    got = run(spark, rows + bad + other, [0, 3, 20, 30, 32, 33, 40], share=1.0)
    want = exact(rows + other, [0, 3, 20, 40])
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [(r, i) for r, i, _ in found] == [(n + 1, i) for n, (_, i) in enumerate(want[q])]
        assert [s for *_, s in found] == pytest.approx([d for d, _ in want[q]], abs=1e-12)


def test_recall_over_shards_and_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32)) * 0.5
    vectors = centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000 + i, vectors[0].tolist()) for i in range(1000)]
    queries = list(range(0, 3000, 100))
    got, want = run(spark, rows, queries, shard_rows=700, query_rows=11), exact(rows, queries)
    hits = [len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in queries]
    assert sum(hits) >= 0.9 * 10 * len(queries)
    assert [i for _, i, _ in got[0]] == list(range(5000, 5010))  # ties go to smaller ids


def test_descent_takes_the_longest_prefixes():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 16))
    forest = P.Forest(vectors, trees=5, bits=20)
    codes = forest.hash_strings(vectors)
    for q in range(0, 400, 40):
        for least in (1, 20, 150, 400):
            for depth in range(20, -1, -1):
                want = np.flatnonzero((codes >> (20 - depth) == codes[q] >> (20 - depth)).any(axis=1))
                if len(want) >= least:
                    break
            assert np.array_equal(forest.candidates(codes[q], least, np.arange(400)), want)


def test_an_id_that_fills_the_table_does_not_hide_others(spark):
    rng = np.random.default_rng(4)
    rows = [(7, (np.ones(16) + 0.01 * rng.standard_normal(16)).tolist()) for _ in range(12)]
    rows += [(100 + i, rng.standard_normal(16).tolist()) for i in range(12)] + [(0, np.ones(16).tolist())]
    assert [len(found) for found in run(spark, rows, [0], share=0.1).values()] == [10]


def test_empty_table(spark):
    assert run(spark, [], [1]) == {}
