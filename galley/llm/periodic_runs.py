"""Maximal stretches of words that repeat with a period, and the texts without the repeats.

A run is a stretch of consecutive words with smallest period q, at least
``max(LEAST, 2 * q)`` words long, that no neighbouring word extends.

*Splitting by frequency.* Every word of a run occurs at least twice in it, so a
word that is alone in its segment is in no run and splits the segment there;
pieces of fewer than ``LEAST`` words go. A word may be frequent in a document
and alone in a piece, so this is repeated inside the pieces until nothing
changes. It is done for the words of many documents at once, each document
being a segment at first. Ordinary prose falls apart in a few rounds.

*Scanning lags.* In what is left, a run of period q is a stretch of at least
``max(LEAST - q, q)`` places that equal the place q further on. Lags below
``SHORT`` are scanned as they are. Lags from Q to 2Q agree on a grid place of
step Q/2 and on the Q/2 words after it, so only lags at which these words come
again are scanned, from that place to both sides by halving with prefix hashes.
Lags that are a multiple of the period of a run around the place give the same
run again and are left out. So the work grows as n log n, also for a text that
repeats one word a million times. What hashes find is compared word by word.

Defined results: words are separated by ASCII white space and are compared as
they are; a null, empty or blank text has no word and no run; equal documents,
repeated ids and null ids are rows of their own; ties of the longest run go to
the smallest start, then the smallest period; an empty table gives no row;
columns other than id and text are not read. Words are looked up by content in
one Arrow batch at a time, so a task holds a batch of texts and a few numbers a
word, whatever the partition; a text of any length is one piece of work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the shortest run.
LEAST = 12
#: Lags scanned as they are.
SHORT = 8
#: Words handled at once, in whole documents.
CHUNK_WORDS = 1 << 20

# ---- splitting by frequency ----------------------------------------------------


def surviving(codes: np.ndarray, segment: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces in which every word occurs twice; ``segment`` numbers the documents of the words."""
    place = np.arange(len(codes))
    while len(place):
        # neighbours in one segment that are next to each other in the text make a piece
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(segment) != 0)) + 1
        starts = np.concatenate([[0], cut])
        lengths = np.diff(np.concatenate([starts, [len(place)]]))
        piece = np.repeat(np.arange(len(starts)), lengths)
        _, inverse, counts = np.unique(
            piece * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True
        )
        keep = (counts[inverse] >= 2) & (lengths >= least)[piece]
        if keep.all():
            return [(int(place[s]), int(place[s]) + int(n)) for s, n in zip(starts, lengths)]
        place, codes, segment = place[keep], codes[keep], piece[keep]
    return []


# ---- hashes of stretches -------------------------------------------------------

_PRIMES = (2_147_483_629, 2_147_483_587)
_BASES = (911_382_323, 972_663_749)


@cache
def _powers(prime: int, base: int, bits: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


class Stretches:
    """Equality of stretches of one piece by prefix hashes modulo two primes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        bits = max(1, self.n.bit_length())
        self.powers, self.sums = [], []
        for prime, base in zip(_PRIMES, _BASES):
            powers = _powers(prime, base, bits)
            terms = (codes.astype(np.int64) + 1) % prime * powers[: self.n] % prime
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(terms, out=sums[1:])
            self.powers.append(powers)
            self.sums.append(sums % prime)

    def names(self, width: int) -> np.ndarray:
        """A number for the ``width`` words from each place on, equal for equal words."""
        out = np.zeros(self.n - width + 1, np.int64)
        for prime, powers, sums in zip(_PRIMES, self.powers, self.sums):
            part = (sums[width:] - sums[:-width]) % prime
            # hashes carry the power of their place: bring all to that of the last place
            out = (out << 31) | (part * powers[self.n - width - np.arange(len(part))] % prime)
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether the words from i and those from j (both arrays, i < j) agree over ``width`` words."""
        same = np.ones(len(i), bool)
        for prime, powers, sums in zip(_PRIMES, self.powers, self.sums):
            left = (sums[i + width] - sums[i]) % prime * powers[j - i] % prime
            same &= left == (sums[j + width] - sums[j]) % prime
        return same

    def forward(self, i: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """How many words from i on equal those ``lag`` further on."""
        low, high = np.zeros(len(i), np.int64), self.n - i - lag
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(i, i + lag, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, i: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """How many words before i equal those ``lag`` further on."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(i - middle, i - middle + lag, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


# ---- scanning lags -------------------------------------------------------------


def _stretches_at(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of places that equal the place ``lag`` further on."""
    if len(codes) - lag < least:
        return []
    same = np.concatenate([[False], codes[:-lag] == codes[lag:], [False]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(same))
    starts, ends = edge[0::2], edge[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


class _Covered:
    """Runs found so far, by the place they cover: is a stretch inside a run whose period divides a lag?"""

    def __init__(self) -> None:
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.by_period.setdefault(period, []).append((start, end))

    def holds(self, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        for period, runs in self.by_period.items():
            asked = np.flatnonzero(~out & (lag % period == 0))
            if not len(asked):
                continue
            # runs of one period overlap by less than it, so both their ends grow together
            first = np.array(sorted(runs), np.int64)
            at = np.searchsorted(first[:, 0], start[asked], "right") - 1
            out[asked] = (at >= 0) & (first[at, 1] >= end[asked])
        return out


def _candidates(stretches: Stretches, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of grid places whose next ``width`` words come again ``low`` to ``2 * low - 1`` further on."""
    n = stretches.n
    names = stretches.names(width)
    order = np.argsort(names, kind="stable")
    rank = np.concatenate([[0], np.cumsum(np.diff(names[order]) != 0)])
    # class and place in one number, ascending
    keys = rank * (n + 1) + order
    of_place = np.empty(len(names), np.int64)
    of_place[order] = rank
    grid = np.arange(0, len(names), width)
    lo = np.searchsorted(keys, of_place[grid] * (n + 1) + np.minimum(grid + low, n))
    hi = np.searchsorted(keys, of_place[grid] * (n + 1) + np.minimum(grid + 2 * low, n))
    counts = hi - lo
    picked = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    place = np.repeat(grid, counts)
    return place, order[picked] - place


def runs_of(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of one piece, sorted by start, then period."""
    n, found, covered = len(codes), [], _Covered()

    def take(start: int, end: int, period: int) -> None:
        found.append((start, end, period))
        covered.add(start, end, period)

    for lag in range(1, min(SHORT - 1, n // 2) + 1):
        fresh = [(s, e + lag) for s, e in _stretches_at(codes, lag, max(least - lag, lag))]
        if fresh:
            s, e = np.array(fresh, np.int64).T
            known = covered.holds(s, e, np.full(len(s), lag))
            for (start, end), again in zip(fresh, known):
                if not again:
                    take(start, end, lag)
    if n // 2 < SHORT:
        return sorted(found, key=lambda r: (r[0], r[2]))

    stretches, low = Stretches(codes), SHORT
    while low <= n // 2:
        width = low // 2
        place, lag = _candidates(stretches, low, width)
        inside = lag <= n // 2
        place, lag = place[inside], lag[inside]
        new = ~covered.holds(place, place + lag + width, lag)
        place, lag = place[new], lag[new]
        if len(place):
            start = place - stretches.backward(place, lag)
            end = place + stretches.forward(place, lag)
            long = end - start >= np.maximum(least - lag, lag)
            level = np.unique(np.stack([lag[long], start[long], end[long]], axis=1), axis=0)
            # a level has lags below twice its first, so none is a multiple of another's period
            for q, s, e in level.tolist():
                s, e = _verified(codes, s, e, q)
                if e - s >= max(least - q, q):
                    take(s, e + q, q)
        low *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _verified(codes: np.ndarray, start: int, end: int, lag: int) -> tuple[int, int]:
    """The stretch of places that equal the place ``lag`` further on, by the words themselves."""
    same = codes[start:end] == codes[start + lag : end + lag]
    if same.all():
        return start, end
    # equal hashes of unequal words: the longest part that holds
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    s, e = max(zip(edge[0::2], edge[1::2]), key=lambda x: x[1] - x[0], default=(0, 0))
    return start + int(s), start + int(e)


# ---- documents -----------------------------------------------------------------


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of all documents, chosen by id, with a made tail that repeats."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + block * ((n - a) // p) + block[: (n - a) % p]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    flat = pa.array([w for t in texts for w in t], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    document = np.repeat(np.arange(len(texts)), sizes)
    for start, end in surviving(codes, document):
        owner = int(document[start])
        base = start - int(first[owner])
        out[owner] += [(s + base, e + base, q) for s, e, q in runs_of(codes[start:end])]
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        gone[start + period] += 1
        gone[end] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep) if k]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _chunks(batch: pa.RecordBatch, rewrite) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of whole documents, a bounded number of words at once."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # on ASCII white space, for bytes
        ids.append(doc_id.as_py())
        texts.append(rewrite(words, ids[-1]) if rewrite else words)
        size += len(words)
        if size >= CHUNK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None
) -> DataFrame:
    """One row per document: doc_id, ``runs`` (start, length, period by start, then period), and ``collapsed``, the kept words.

    ``rewrite`` (words, id) gives the words to be searched in place of the document's own.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch, rewrite):
                found = runs_of_texts(texts)
                lists = [[{"start": s, "length": e - s, "period": q} for s, e, q in runs] for runs in found]
                collapsed = [
                    b" ".join(without_repeats(t, r)).decode("utf-8", "replace") for t, r in zip(texts, found)
                ]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lists, kind), pa.array(collapsed, pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        rows, f"doc_id bigint, runs array<{RUN}>, collapsed string"
    )


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, rewrite=rewritten)
    # greatest length, then smallest start, then smallest period
    order = lambda r: F.struct(-r["length"], r["start"], r["period"])
    longest = F.array_min(F.transform("runs", order))
    length, start, period = -longest["col1"], longest["start"], longest["period"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
