"""Near copies by MinHash: many universal hash minima, bands, verified signatures, star components.

*Signatures.* A document's shingles (64-bit hashes of word n-grams) go through
``MINIMA`` multiply-add functions; the smallest value of each is one number of
the signature, and two documents agree on a number with a probability equal to
their Jaccard similarity.

*Bands.* ``ROWS`` numbers in a row make a band; documents that agree on a whole
band meet. A pair at the threshold of 0.85 misses all bands once in 10^8, a
pair of similarity 0.2 meets once in a hundred. The shuffle carries a band's
hash and the document's set, and a partial aggregate finds the few hashes that
two sets share.

*Verification.* A pair is counted in full only if its signatures agree on as many
numbers as a linked pair does but once in 10^12; links are confirmed on the full
sets.

*Components.* The members of a band are compared with its most central one
instead of with each other; as long as they lie in several components they meet
again on what makes each differ from it (``ngram_join.resolved``). Components
come from alternating large-star and small-star steps.

Defined results: words are separated by ASCII white space, A-Z are lowered; a
text of fewer than n words is one shingle as a whole; a null, empty or blank
text has no shingle and is linked with nothing, not even with its copies;
documents of equal sets are one node and always linked; a null id never names a
component unless it has no other; rows that repeat an id count as documents of
their own; a text of any length is hashed in whole, a bounded number of
shingles at once; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.ngram_join import REMEMBERED, by_node, gram_set, named_components, node_of, resolved, sets_of, stored
from galley.operators.scale import fits
from galley.session import cut_lineage

WIDTH = 5
PERCENT = 85
#: Numbers of a signature, and of a band.
MINIMA = 160
ROWS = 5
#: Chance that verification leaves out a pair whose similarity is just enough.
MISSED = 1e-12
#: Shingles hashed at once.
SHINGLES = 2048
#: Band hashes (8 bytes) up to which a list of them may be broadcast.
BROADCAST_KEYS = 1_000_000


@cache
def _functions(minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions."""
    rnd = np.random.Generator(np.random.PCG64(20_240_817))
    a, b = rnd.integers(0, 1 << 64, (2, minima, 1), np.uint64)
    return a | np.uint64(1), b


def signature(grams: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """The smallest value of each function over the shingles, its high 32 bits."""
    a, b = _functions(minima)
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), SHINGLES):
        np.minimum(least, (grams[None, at : at + SHINGLES] * a + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_agreement(percent: int, minima: int = MINIMA, missed: float = MISSED) -> int:
    """Numbers on which two linked signatures agree but for a chance of ``missed``."""
    p, below = percent / 100, 0.0
    for k in range(minima):
        below += math.comb(minima, k) * p**k * (1 - p) ** (minima - k)
        if below > missed:
            return k
    return minima


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per document: doc_id, node (its set), n_shingles, and the signature unless its task has sent it before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            nodes, sizes, marks = [], [], []
            for text in batch.column(1):
                grams = gram_set(text.as_py(), width)
                node = node_of(grams) if len(grams) else None
                fresh = node is not None and node not in sent
                if fresh and len(sent) < REMEMBERED:
                    sent.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                marks.append(signature(grams) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int32()))],
                names=["doc_id", "node", "n_shingles", "signature"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        rows, "doc_id bigint, node bigint, n_shingles bigint, signature array<int>"
    )


def _bands(rows: DataFrame) -> DataFrame:
    """(key, node) of every band of every signature."""
    bands = [F.xxhash64(F.lit(i), F.slice("signature", i * ROWS + 1, ROWS)) for i in range(MINIMA // ROWS)]
    return rows.where("signature is not null").select(F.explode(F.array(*bands)).alias("key"), "node")


def meetings(rows: DataFrame) -> DataFrame:
    """(key, node, n_shingles) of the bands that two or more sets share."""
    shared = stored(
        _bands(rows).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    )
    few = F.broadcast(shared) if fits(shared, BROADCAST_KEYS) else shared
    met = _bands(rows).join(few, "key", "left_semi").distinct()
    sizes = rows.where("signature is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"))
    return met.join(sizes, "node")


def verified(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose signatures agree on enough numbers for a link.

    ``marks`` (node, marks) holds one byte of each number: numbers that agree
    agree in it, others once in 256.
    """
    left = marks.select(F.col("node").alias("a"), F.col("marks").alias("ma"))
    right = marks.select(F.col("node").alias("b"), F.col("marks").alias("mb"))
    agreed = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda same: same))
    return pairs.join(left, "a").join(right, "b").where(agreed >= least_agreement(percent)).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, its node and label (null without shingles)."""
    rows = cut_lineage(signed(docs, id_col, text_col, width))
    members = stored(meetings(rows))
    labels = None
    if not members.isEmpty():
        met = members.select("node").distinct()
        signed_once = rows.where("signature is not null")
        one_byte = F.transform("signature", lambda x: (F.pmod(x, F.lit(256)) - 128).cast("tinyint"))
        marks = by_node(signed_once.join(met, "node", "left_semi").select("node", one_byte.alias("marks")))
        sets = sets_of(docs, signed_once.select("doc_id", "node"), members, id_col, text_col, width)
        labels = resolved(members, sets, percent, likely=lambda pairs: verified(pairs, marks, percent))
    return named_components(rows, labels)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'
  ), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))
  END AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
sets AS (SELECT doc_id, n, md5(array_to_string(list_sort(shingles), chr(10))) AS name FROM s JOIN n USING (doc_id) WHERE n > 0),
rep AS (SELECT name, n, min(doc_id) AS doc_id FROM sets GROUP BY ALL),
g AS (SELECT rep.doc_id, rep.n, unnest(shingles) AS shingle FROM s JOIN rep USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b
    ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM rep
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node),
comp AS (SELECT sets.doc_id, label.label FROM sets JOIN rep USING (name) JOIN label ON label.node = rep.doc_id),
least AS (SELECT label, min(doc_id) AS component_id FROM comp GROUP BY label)
SELECT n.doc_id, n.n AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN comp USING (doc_id) LEFT JOIN least USING (label)
"""
