"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree has hash strings of ``BITS`` bits, signs of random projections,
kept as sorted arrays. A query descends in each tree to the rows with the
longest common prefix, wherever that ends; then all trees ascend together, one
bit at a time, until the rows below their common depth are ``share`` of all.
These candidates are ranked by their exact distance.

Rows are dealt at random (by a hash of their contents) to shards of about
``SHARD_ROWS``, and queries to blocks of about ``QUERY_ROWS``; each pair of a
block and a shard is one group, a forest over the shard that answers the
block. So no task holds more than one shard and one block, a vector that is
very common is spread over all shards, and nothing is broadcast. The best k of
each shard meet in a window per query.

Ascending to a share of the rows, not to a fixed number, keeps the recall the
same at every size. Vectors without structure, as in the test tables, need a
large share; see the README for measured recall.

Defined results: vectors that are null, empty or zero, or hold a null or
non-finite component, take no part, nor do null ids; vectors are compared only
with vectors of as many components; a row is no neighbour of a query of its
own id; rows that repeat id and vector count once; columns other than id and
vector are not read; queries without any candidate have no row in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.session import cut_lineage

TREES = 64
BITS = 30
#: Part of the rows of a shard at which the ascent ends.
SHARE = 0.45
#: Rows a shard and queries a block have about.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
NEAREST = 10
SEED = 20
SCHEMA = "query_id bigint, vec_id bigint, score double"


class Forest:
    """Sorted hash strings of some vectors: one array per tree, laid end to end."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, single: bool = True):
        self.vectors, self.trees, self.bits, self.single = vectors, trees, bits, single
        self.planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], trees * bits))
        self.centre = vectors.mean(axis=0)
        self.squares = (vectors * vectors).sum(axis=1)
        self.first = np.arange(trees, dtype=np.int64) << bits  # the tree's number stands before the string
        keys = (self.hash_strings(vectors) + self.first).T
        order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, order, axis=1).ravel()
        self.order = order.ravel()

    def hash_strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash string of each vector in each tree, its first bit the highest."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for at in range(0, len(vectors), 1024):
            signs = ((vectors[at : at + 1024] - self.centre) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[at : at + 1024] = (out[at : at + 1024] << 1) | signs[:, :, b]
        return out

    def ranges(self, code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree, the stretch of its array whose first ``depth`` bits are those of ``code``."""
        below = self.bits - depth
        low = ((code + self.first) >> below) << below
        return np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + (1 << below))

    def candidates(self, code: np.ndarray, least: int, ids: np.ndarray) -> np.ndarray:
        """Rows found by descending to the longest prefixes and ascending until they have ``least`` ids.

        Depths whose stretches together are shorter than ``least`` are passed
        without looking at their rows.
        """
        found = np.count_nonzero if self.single else lambda seen: len(np.unique(ids[seen]))
        seen = np.zeros(len(self.vectors), bool)
        for depth in range(self.bits, -1, -1):
            low, high = self.ranges(code, depth)
            if depth and (high - low).sum() < least:
                continue
            for a, b in zip(low.tolist(), high.tolist()):
                seen[self.order[a:b]] = True
            if depth == 0 or found(seen) >= least:
                break
        return np.flatnonzero(seen)


def nearest(forest: Forest, ids: np.ndarray, query: np.ndarray, query_id: int, code: np.ndarray, least: int, k: int):
    """The k nearest candidates: (ids, distances), ties to smaller ids."""
    found = forest.candidates(code, least, ids)
    found = found[ids[found] != query_id]
    if forest.single and len(found) > 4 * k:
        # all that may be among the nearest by a product that rounds otherwise; exact distances follow
        near = forest.squares[found] - 2.0 * (forest.vectors[found] @ query)
        bound = np.partition(near, k - 1)[k - 1]
        slack = 1e-9 * (1.0 + forest.squares.max() + query @ query)
        found = found[near <= bound + slack]
    gap = forest.vectors[found] - query
    distance = np.sqrt((gap * gap).sum(axis=1))
    best = np.lexsort((ids[found], distance))
    if not forest.single:  # an id may have several vectors: its nearest counts
        best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])]
    return ids[found][best[:k]], distance[best[:k]]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) that can be compared, once each."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        rows.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector"))
        .where("vec_id is not null and size(vector) > 0")
        .where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
        .dropDuplicates(["vec_id", "vector"])
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks()
    return np.asarray(values.flatten()).reshape(-1, width)


def search(
    points: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
    trees: int = TREES, bits: int = BITS, share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        width = len(left["vector"][0])
        ids, vectors = left["vec_id"].to_numpy(), _matrix(left["vector"], width)
        query_ids, asked = right["query_id"].to_numpy(), _matrix(right["vector"], width)
        distinct = len(np.unique(ids))
        forest = Forest(vectors, trees, bits, single=distinct == len(ids))
        least = max(k + 1, int(np.ceil(share * distinct)))
        out = [
            (np.full(len(found), q), found, distance)
            for q, v, code in zip(query_ids, asked, forest.hash_strings(asked))
            for found, distance in [nearest(forest, ids, v, q, code, least, k)]
        ]
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    rows = cut_lineage(usable(points, id_col, vector_col))
    asked = usable(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    left = rows.withColumns(
        {"shard": deal(shards, "vec_id", "vector"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "width": F.size("vector")}
    )
    right = asked.withColumns(
        {"block": deal(blocks, "query_id", "vector"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "width": F.size("vector")}
    )
    keys = ["shard", "block", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, SCHEMA)
    # a query that repeats its id with other vectors takes the nearest of all
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))
