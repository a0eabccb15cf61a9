"""Chunks and sparse term vectors, built inside the row: no shuffle, no explode.

The vectors of a batch of chunks are counted together in Arrow and numpy: as
column expressions the same counting takes over ten times the CPU time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T

MILLION = 1_000_000.0


def chunk_words(
    c: Column,
    size: int = fixed.CHUNK_WORDS,
    overlap: int = fixed.CHUNK_OVERLAP,
    min_tail: int = fixed.CHUNK_MIN_TAIL,
) -> Column:
    """Overlapping word windows; a short last window goes unless it is the only one."""
    step = size - overlap

    def windows(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(
            F.filter(
                F.sequence(F.lit(0), n - 1, F.lit(step)),
                lambda s: (s == 0) | (n - s >= min_tail),
            )
        )
        cut = F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, F.lit(size)), " "))
        return F.when(n == 0, T.strings([])).otherwise(cut)

    return T.let(T.words(c), windows)


def term_counts(toks: Column) -> Column:
    """array<struct<term, n, pos>> of distinct tokens; pos is the first place.

    Sorts (token, place) pairs and cuts the sorted list where the token
    changes, which takes one pass where counting each token apart would take
    one pass per token.
    """
    pairs = F.sort_array(F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def cut(p: Column) -> Column:
        n = F.size(p)
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
            F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda k: (k == 0) | (p[F.greatest(k - 1, F.lit(0))]["t"] != p[k]["t"]),
            )
        )

        def runs(s: Column) -> Column:
            return F.transform(
                s,
                lambda at, j: F.struct(
                    p[at]["t"].alias("term"),
                    (F.coalesce(F.get(s, j + 1), n) - at).alias("n"),
                    p[at]["i"].alias("pos"),
                ),
            )

        return T.let(starts, runs)

    return T.let(pairs, cut)


def norm(counts: Column) -> Column:
    """Euclidean length of the term counts."""
    return F.sqrt(
        F.aggregate(
            counts,
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + c["n"].cast("bigint") * c["n"],
            lambda acc: acc.cast("double"),
        )
    )


def _counted(tokens: pa.Array, limit: int, stopwords: pa.Array) -> pa.Array:
    """Vectors of lists of tokens, see ``top_terms``."""
    sizes = np.asarray(tokens.value_lengths().fill_null(0))
    coded = tokens.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    rows = np.repeat(np.arange(len(sizes)), sizes)
    # each distinct token of the batch is looked up once
    wanted = ~np.asarray(pc.is_in(words, value_set=stopwords.cast(words.type)))[codes]
    rows, codes = rows[wanted], codes[wanted]
    pairs, first, n = np.unique(rows * max(1, len(words)) + codes, return_index=True, return_counts=True)
    row, code = np.divmod(pairs, max(1, len(words)))
    length = np.sqrt(np.bincount(row, weights=(n * n).astype(np.float64), minlength=len(sizes)))
    order = np.lexsort((first, -n, row))
    row, code, n = row[order], code[order], n[order]
    starts = np.searchsorted(row, np.arange(len(sizes)))
    kept = np.arange(len(row)) - starts[row] < limit
    row, code, n = row[kept], code[kept], n[kept]
    weight = np.floor(n / length[row] * MILLION + 0.5) / MILLION
    entries = pa.StructArray.from_arrays(
        [words.take(pa.array(code)).cast(pa.string()), pa.array(weight, pa.float64())], names=["term", "weight"]
    )
    offsets = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def top_terms(toks: Column, limit: int = fixed.VECTOR_TERMS, stopwords: Iterable[str] = ()) -> Column:
    """array<struct<term, weight>>: counts scaled by their full length, most frequent kept.

    Stop words do not count. Equal counts keep the order of first occurrence.
    Null gives no terms.
    """
    stop = sorted(stopwords)

    def count(tokens: pa.Array) -> pa.Array:
        return _counted(tokens, limit, pa.array(stop, pa.string()))

    return F.arrow_udf(count, "array<struct<term:string,weight:double>>")(toks)


def _found(texts: pa.Array, pattern: re.Pattern) -> pa.Array:
    """Lists of the matches in each text."""
    found, ends = [], [0]
    for text in texts.to_pylist():
        if text is not None:
            found += pattern.findall(text)
        ends.append(len(found))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(found, pa.large_string()))


def text_terms(c: Column, min_len: int = 3, limit: int = fixed.VECTOR_TERMS, stopwords: Iterable[str] = ()) -> Column:
    """``top_terms`` of the tokens of a text.

    The tokens are found where they are counted: one text goes to Python
    instead of a list of some hundred tokens, and they are found there at a
    sixth of the CPU time.
    """
    stop = sorted(stopwords)
    pattern = T.token_pattern(min_len)

    def count(texts: pa.Array) -> pa.Array:
        return _counted(_found(texts, re.compile(pattern)), limit, pa.array(stop, pa.string()))

    return F.arrow_udf(count, "array<struct<term:string,weight:double>>")(T.token_text(c))
