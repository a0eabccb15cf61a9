"""Documents whose sets of word n-grams have a Jaccard similarity of 0.9 or more (the pipeline: 5 words, 0.8).

The join is a product of the sparse document by n-gram matrix with its own
transpose, by blocks of columns. The columns (n-grams, as 64-bit hashes) are
dealt to blocks by hash, and the bounds on a pair come from the sizes of its
sets: two sets of a and b members are linked only if their difference has at
most ``(a + b) * (100 - percent) / (100 + percent)`` members. Sizes form
levels, each with as many column blocks as its largest allowed difference plus
two. Every difference falls into one block, so a linked pair has equal contents
in at least two blocks; all other pairs are below the bound and are discarded
without being formed. Documents therefore meet only on equal block contents
(about nine n-grams at once), never on a single common n-gram.

Most block keys belong to one set and meet nothing. So keys go first without
their sets, sorted in ranges, four bytes each at most; of those that come again
a bitmap is broadcast, and only keys it has go with their sets. It may hold more
than that, which costs rows and loses none.

Overlap counts are accumulated exactly for the pairs that are left. To find
components it is not needed to form all pairs of a group: its members are
compared with a pivot, the most central of them. As long as the others are in
several components, they meet again on what makes each differ from the pivot,
under the bound that a link puts on these differences, in smaller groups with
a few pivots of their own. So a group of near copies costs about its size, and
no pair that could link two components is left out, whatever the group's size.

Documents of equal sets (exact copies above all) are one node: their first
document within a task alone sends its blocks, the shuffle sees at most one
copy per task, and all get the component of the node.

Defined results: words are separated by ASCII white space, A-Z are lowered; a
text of fewer than n words is one n-gram as a whole; a null, empty or blank
text has no n-gram and is linked with nothing, not even with its copies; a row
with a null id is linked like any other, but its id never names a component
unless the component has no other, and then the component id is null; rows
that repeat an id count as documents of their own; columns other than id and
text are not read. Hashes are 64 bits wide, so counts are exact but for
collisions (about one in 10^7 pairs of documents of a million words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.operators.scale import fits
from galley.session import cut_lineage, shuffles_removed
from galley.sources.files import scratch

WIDTH = 3
PERCENT = 90
#: The pipeline's rule for near copies; the one above is the contract of the op10 query.
STAGE_WIDTH = 5
STAGE_PERCENT = 80
#: Growth, per round, of the number of members all others of a group are compared with (one at first).
MORE_PIVOTS = 16
#: Ids (8 bytes each) up to which a list of documents may be broadcast.
BROADCAST_IDS = 1_000_000
#: Column blocks beyond those that linked sets may differ in: so many, and one for so many members.
SPARE, SPARE_OF = 3, 50
#: Bits of a block key that travel; keys that agree in them by chance cost a comparison.
KEY_BITS = 40
#: Block keys a task holds before it sends them, and the power of two of their ranges at most.
HELD_KEYS, MOST_RANGES = 1 << 21, 14
#: Bits of the bitmap for each key that comes again, and the power of two of its bits at most (64 MB).
BITS_OF_KEY, MOST_BITS = 16, 29
#: Members, or pairs, that move with their sets at once, and the parts of a round at most: each reads the stored sets.
PART_MEMBERS, PART_PAIRS, MOST_PARTS = 1 << 15, 1 << 17, 8
#: Words of 64 bits in a sketch: sets of up to some thousand members are told apart by it.
SKETCH_WORDS = 16
#: Nodes a task remembers so as not to send their blocks again.
REMEMBERED = 1_000_000

# ---- sets of n-grams ---------------------------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_codes() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    """base^0 .. base^(2^bits - 1) modulo 2^64."""
    out = np.ones(1, np.uint64)
    for _ in range(bits):
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


#: Bytes hashed at once; longer texts are cut between words.
SEGMENT = 1 << 20


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each word of some bytes, from differences of one running polynomial hash."""
    space = _SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bits = int(len(raw)).bit_length()
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_codes()[raw] * _powers(_MULTIPLIER, bits)[: len(raw)], out=running[1:])
    return _mixed((running[ends] - running[starts]) * _powers(_INVERSE, bits)[starts] + (ends - starts).astype(np.uint64))


def _segments(raw: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        while end < len(raw) and not (gaps := np.flatnonzero(_SPACES[raw[end - SEGMENT : end]])).size:
            end += SEGMENT  # one word fills the segment
        if end < len(raw):
            end = end - SEGMENT + int(gaps[-1]) + 1
        yield raw[at:end]
        at = end


def gram_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    words = np.concatenate([_word_hashes(part) for part in _segments(raw)] or [np.zeros(0, np.uint64)])
    if not len(words):
        return words
    if len(words) < width:
        total = np.full(1, len(words), np.uint64)
        for w in words:
            total = _mixed(total * np.uint64(_MULTIPLIER) + w)
        return total
    n = len(words) - width + 1
    grams = np.full(n, width, np.uint64)
    for k in range(width):
        grams = _mixed(grams * np.uint64(_MULTIPLIER) + words[k : k + n])
    grams.sort()
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


# ---- size bounds and column blocks -------------------------------------------


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Members by which linked sets of a and b members differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


@cache
def level_of(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """(first, last) size of the level of a size; linked sets are in the same or in adjacent levels."""
    first = 1
    while True:
        last = first * 100 // percent
        if size <= last:
            return first, last
        first = last + 1


@cache
def _bounds(last: int, percent: int) -> tuple[int, np.ndarray | None]:
    """Column blocks of the level that ends with size ``last``: their number, and first hashes."""
    allowed = most_different(last, last * 100 // percent, percent)
    if allowed == 0:
        return 0, None  # sets of such sizes are linked only if equal
    n = allowed + 2 + SPARE + last // SPARE_OF
    return n, np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def block_keys(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the column blocks in which a set can meet another.

    A set is in its own level and in the one below, where it can meet smaller
    sets. A key stands for level, block and contents. Contents that are empty
    say little, so an empty block has no key. If a set has fewer empty blocks
    than the blocks in which a linked set must agree with it, one of these is
    filled. Only if both sets have more (small sets, rarely) they may agree in
    empty blocks alone; such sets also meet on members, the few of smallest
    hash, of which linked sets share one.
    """
    return np.concatenate([keys for keys, _ in level_keys(grams, percent)])


def level_keys(grams: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, int]]:
    """For the level of a set and the one below: its keys, and how many of them a linked set shares at least."""
    size = len(grams)
    none = (np.zeros(0, np.uint64), 1)
    if not size:
        return [none, none]
    first, last = level_of(size, percent)
    out = []
    for end in (last, first - 1):
        n, bounds = _bounds(end, percent) if end else (0, None)
        if not n:
            out.append(none)
            continue
        at = np.concatenate([[0], np.searchsorted(grams, bounds), [size]])
        filled = np.flatnonzero(at[1:] > at[:-1])
        sums = np.add.reduceat(_mixed(grams + np.uint64(end)), at[:-1][filled])
        level = np.full(1, end, np.uint64)
        keys = _mixed(sums + _mixed(filled.astype(np.uint64) + level * np.uint64(_MULTIPLIER) + np.uint64(1)))
        partner = size * 100 // percent if end == last else end
        agree = n - most_different(size, partner, percent)
        least = agree - (n - len(filled))
        if least <= 0:
            # too few filled blocks to be sure of one: these sets also meet on single members
            keys, least = np.concatenate([keys, _prefix(grams, end, percent)]), 1
        out.append((keys, least))
    return out


def _short_keys(grams: np.ndarray, percent: int, shift: int) -> tuple[np.ndarray, int, int, int]:
    """The keys of a set as they travel, how many of them are of its own level, and what a linked set shares at least in each."""
    keys, least = [], []
    for level, shared in level_keys(grams, percent):
        short = np.unique(level >> np.uint64(shift))
        keys.append(short)
        least.append(max(1, shared - (len(level) - len(short))))
    return np.concatenate(keys).view(np.int64), len(keys[0]), *least


def _prefix(grams: np.ndarray, end: int, percent: int) -> np.ndarray:
    """Keys of the members of smallest hash: two linked sets have one of them in common."""
    size = len(grams)
    least = -(-size * percent // 100)  # members that a linked set has in common at least
    return _mixed(grams[: size - least + 1] + _mixed(np.full(1, end, np.uint64) * np.uint64(_INVERSE)))


def node_of(grams: np.ndarray) -> int:
    """Name of a set: a 64-bit hash of all its members."""
    total = _mixed(grams ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64, keepdims=True)
    return int(_mixed(total + np.uint64(len(grams))).view(np.int64)[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the members by hash: two sets differ in at least as many members as their sketches do in bits."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount((_mixed(grams) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class KeyBits:
    """A bitmap of the keys, less their last ``dropped`` bits, that more than one set may have."""

    def __init__(self, held: Broadcast, dropped: int) -> None:
        self.held, self.dropped = held, dropped

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.dropped
        return (np.frombuffer(self.held.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def left(self, keys: np.ndarray, n_own: int, least_own: int, least_below: int) -> tuple:
        """What ``_short_keys`` gave, less the keys nobody else has, and less a level with too few of them for a link."""
        kept, lengths = [], []
        for level, least in ((keys[:n_own], least_own), (keys[n_own:], least_below)):
            some = level[self.has(level)]
            kept.append(some if len(some) >= least else some[:0])
            lengths.append(len(kept[-1]))
        return (np.concatenate(kept), lengths[0], least_own, least_below) if sum(lengths) else (None,) * 4


def _as_planes(keys: np.ndarray) -> bytes:
    """Sorted numbers of four bytes, all first bytes together and so on: the high ones hardly vary, which compression sees."""
    return keys.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _twice(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, those that come more often only twice."""
    return keys[np.concatenate([np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]])]


def _dealt_keys(docs: DataFrame, text_col: str, width: int, percent: int, ranges: int) -> DataFrame:
    """(part, keys): the block keys of a task's sets in pieces, by their range, without their sets."""
    shift, low, most = 64 - KEY_BITS, KEY_BITS - ranges, HELD_KEYS

    def piece(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        keys = _twice(keys)
        at = np.searchsorted(keys, np.arange((1 << ranges) + 1, dtype=np.int64) << low)
        parts = np.flatnonzero(at[1:] > at[:-1])
        below = keys & ((1 << low) - 1)
        planes = [_as_planes(below[at[p] : at[p + 1]]) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(planes, pa.binary())], names=["part", "keys"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                grams = gram_set(text.as_py(), width)
                node = node_of(grams) if len(grams) else None
                if node is None or node in sent:
                    continue
                if len(sent) < REMEMBERED:
                    sent.add(node)
                held.append(_short_keys(grams, percent, shift)[0])
                n += len(held[-1])
                if n >= most:
                    yield piece(held)
                    held, n = [], 0
        if n:
            yield piece(held)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "part int, keys binary")


def _repeated_keys(dealt: DataFrame) -> DataFrame:
    """(part, n, keys) of the keys of a range that come more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces.setdefault(part, []).append(planes)
        for part, planes in pieces.items():
            keys = np.concatenate([_of_planes(p) for p in planes])
            keys.sort()
            again = np.unique(keys[1:][keys[1:] == keys[:-1]])
            if len(again):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([len(again)], pa.int64()), pa.array([_as_planes(again)], pa.binary())],
                    names=["part", "n", "keys"],
                )

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part").mapInArrow(rows, "part int, n bigint, keys binary")


def shared_keys(docs: DataFrame, text_col: str, width: int, percent: int) -> KeyBits:
    """The block keys that come more than once: those of several sets, and of copies that several tasks read."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the rest of a key has four bytes; a range has whole bytes of the bitmap
    ranges = min(MOST_RANGES, KEY_BITS - 3, max(KEY_BITS - 32, tasks.bit_length()))
    again = stored(_repeated_keys(_dealt_keys(docs, text_col, width, percent, ranges)))
    n = again.agg(F.sum("n")).first()[0] or 0
    power = min(MOST_BITS, KEY_BITS, max(ranges + 3, (n * BITS_OF_KEY).bit_length()))
    low, size = KEY_BITS - power, 1 << (power - ranges)  # bits of the bitmap for a range

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for planes in batch.column(1).to_pylist():
                bits = np.zeros(size, bool)
                bits[_of_planes(planes) >> low] = True
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["part", "bits"])

    whole = bytearray(1 << (power - 3))
    for part, bits in again.select("part", "keys").mapInArrow(slices, "part int, bits binary").collect():
        whole[part * size // 8 : (part + 1) * size // 8] = bits
    return KeyBits(spark.sparkContext.broadcast(whole), low)


ROW_SCHEMA = "doc_id bigint, node bigint, n_shingles bigint, keys array<bigint>, n_own int, least_own int, least_below int"


def incidence(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int | None, shared: KeyBits | None = None
) -> DataFrame:
    """One row per document: its node, set size, and block keys unless its task sent them before (or ``percent`` is None).

    With ``shared``, only the keys it has, of levels in which a document has enough of them for a link.
    """

    shift = 64 - KEY_BITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(1):
                grams = gram_set(text.as_py(), width)
                node = node_of(grams) if len(grams) else None
                fresh = percent is not None and node is not None and node not in sent
                if fresh and len(sent) < REMEMBERED:
                    sent.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                short = _short_keys(grams, percent, shift) if fresh else (None,) * 4
                keys.append(shared.left(*short) if fresh and shared else short)
            lists, *counts = zip(*keys) if keys else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())), *[pa.array(c, pa.int32()) for c in counts],
                ],
                names=["doc_id", "node", "n_shingles", "keys", "n_own", "least_own", "least_below"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        rows, ROW_SCHEMA
    )


def gram_arrays(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, node, grams, sketch) of some documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([node_of(g) if len(g) else None for g in sets], pa.int64()),
                    pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64())),
                    pa.array([sketch(g) for g in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "node", "grams", "sketch"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        rows, "doc_id bigint, node bigint, grams array<bigint>, sketch array<bigint>"
    )


# ---- components --------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Alternates large-star and small-star steps, each a group-by on nodes, so
    paths shrink to stars in a number of rounds that grows with the logarithm
    of their length. Stars are written between rounds. Edges that are stars
    already need no round.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(now):
        either_way = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        around = now.select(F.explode(either_way).alias("e")).select("e.*")
        least = around.groupBy("a").agg(F.least(F.min("b"), "a").alias("least"))
        # repeated edges end with the small star
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        ends = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        now = stored(large.join(least, "a").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, or is a centre that has none."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node")
    return nodes.agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 and out > 0").isEmpty()


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) of the components ``labels`` after more ``links`` (a, b), which join whole components."""
    if labels is None:
        return _small(stored(components(links)))
    named = links
    for end in ("a", "b"):
        of_end = labels.select(F.col("node").alias(end), F.col("label").alias("_label"))
        named = named.join(of_end, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    into = stored(components(named))
    moved = into.select(F.col("node").alias("label"), F.col("label").alias("_into"))
    kept = labels.join(_small(moved), "label", "left").select("node", F.coalesce("_into", "label").alias("label"))
    # the names of components are nodes of theirs, so they are on both sides
    return _small(stored(kept.union(into).distinct()))


# ---- the join ----------------------------------------------------------------


def _short(key: Column) -> Column:
    """A key as it travels: what meets by chance is compared in full and is no link."""
    return F.shiftrightunsigned(key, 64 - KEY_BITS)


def _meetings(rows: DataFrame) -> DataFrame:
    """(key, node, n_shingles) of block keys that two or more nodes share.

    Linked sets share a least number of keys in one level; who shares fewer with
    all others together, a passage or a line, is linked to nobody there.
    """
    own = F.col("pos") < F.col("n_own")
    sent = rows.where("keys is not null").select("*", F.posexplode("keys").alias("pos", "key")).select(
        "key", "node", "n_shingles", own.alias("own"), F.when(own, F.col("least_own")).otherwise(F.col("least_below")).alias("least")
    )
    met = _shared(sent).distinct()
    enough = met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("node", "own"))).where("_n >= least")
    return _shared(enough).select("key", "node", "n_shingles").distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of keys that two or more nodes have."""
    w = Window.partitionBy("key")
    return rows.withColumns({"lo": F.min("node").over(w), "hi": F.max("node").over(w)}).where("lo <> hi").drop("lo", "hi")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint it forgets the plan's constraints,
    which would double from round to round."""
    path = scratch(df.sparkSession, "ngram-join")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(meetings: DataFrame) -> DataFrame:
    """Members of each key by ``rank``: first those that share most with most others, the pivots."""
    sizes = meetings.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    shared = meetings.join(sizes, "key")
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    w = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    placed = {"rank": F.row_number().over(w), "pivot": F.first("node").over(w), "pivot_size": F.first("n_shingles").over(w)}
    return meetings.join(central, "node").withColumns(placed).drop("weight")


def _pairs(ranked: DataFrame, arrays: DataFrame, labels: DataFrame | None, pivots: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a pivot and another member whose sizes and sketches allow a link and whose labels differ."""
    if labels is None and pivots == 1:  # the one pivot is in the row
        met = ranked.where("rank > 1").select(F.col("pivot").alias("a"), F.col("pivot_size").alias("na"), F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
        return _allowed(met, percent)
    placed = _labelled(ranked, labels).join(arrays.select("node", "sketch"), "node")
    first = placed.where(F.col("rank") <= pivots).select(
        "key", F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("label").alias("la"), F.col("rank").alias("ra"),
        F.col("sketch").alias("sa"),
    )
    second = placed.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("label").alias("lb"), "rank", F.col("sketch").alias("sb"))
    met = first.join(second, "key").where("rank > ra and la <> lb")
    # members that differ, at least: most that meet here are further apart than a link allows, and are no pair
    differ = reduce(add, [F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_WORDS)])
    return _allowed(met.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)), percent)


def _allowed(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose sizes na and nb allow a link."""
    close = F.abs(F.col("na") - F.col("nb")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return met.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose overlap, counted in full, reaches the bound of their sizes."""
    left = arrays.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = arrays.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", overlap.alias("both"), (F.size("ga") + F.size("gb") - overlap).alias("either"))
    return counted.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _several_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of keys that are in two or more components."""
    w = Window.partitionBy("key")
    return _labelled(rows, labels).withColumns({"lo": F.min("label").over(w), "hi": F.max("label").over(w)}).where("lo <> hi").drop("lo", "hi", "label")


def _next_meetings(open_rows: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Keys on which members of one pivot meet that are yet to be compared.

    Let d(x) be the members by which x differs from the pivot. A linked pair
    (x, y) has at least (d(x) + d(y) - allowed(x, y)) / 2 of these in common,
    and if both are linked to the pivot they need no comparison. That leaves a
    least number in common for each x: with the rarest first, only so many of
    its differences need to be keys that a pair with fewer in common may miss
    each other (a prefix filter on differences). Differences that are rare in
    the group are those that make x special, so what is common to the whole
    group never makes its members meet.
    """
    left = arrays.select(F.col("node").alias("pivot"), F.col("grams").alias("gp"))
    right = arrays.select("node", F.col("grams").alias("gx"))
    scoped = open_rows.select("scope", "pivot", "node", "n_shingles").distinct()
    less, more = 100 - percent, 100 + percent
    met = scoped.join(left, "pivot").join(right, "node").select(
        F.xxhash64("scope", "pivot").alias("scope"), "node", "n_shingles", F.size("gp").alias("np"),
        F.concat(F.array_except("gx", "gp"), F.array_except("gp", "gx")).alias("diff"),
    )
    n, d = F.col("n_shingles"), F.size("diff").cast("bigint")
    is_linked = d * more <= (n + F.col("np")) * less
    # linked to the pivot: the other one is not, so it differs from it by more than its sizes allow
    of_linked = F.ceil((d + F.floor((F.col("np") - n) * less / more) + 1) / 2)
    # not linked: the other one is at most as far from the pivot as a link allows
    of_other = d - F.floor((n + F.floor(n * 100 / percent)) * less / more)
    common = F.greatest(F.lit(1), F.when(is_linked, of_linked).otherwise(of_other)).cast("bigint")
    rows = met.select("scope", "node", "n_shingles", (d - common + 1).alias("first"), d.alias("d"), F.explode("diff").alias("gram")).select(
        _short(F.xxhash64("scope", "gram")).alias("key"), "scope", "node", "n_shingles", "first", "d"
    )
    often = rows.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("seen > 1")
    # differences of one member only come first and are no keys: their number is enough
    own = Window.partitionBy("scope", "node")
    alone = F.col("d") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("seen", "key"))
    placed = often.withColumns({"alone": alone, "place": place})
    return placed.where("alone + place <= first").select("key", "scope", "node", "n_shingles")


def _in_parts(rows: DataFrame, parts: int, *by: str) -> list[DataFrame]:
    """``rows`` in so many parts, all rows that agree in ``by`` in one; shuffle files of a part go before the next."""
    if parts == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == i) for i in range(parts)]


def _parts(n: int, size: int, most: int) -> int:
    return max(1, min(most, -(-n // size)))


def similarity_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and its node and label (null without n-grams).

    Rows of one label are a component; its id names another component too if rows repeat it.
    """
    with shuffles_removed(docs.sparkSession):
        # keys go from the texts to where they meet; sets are named once more rather than written with their keys
        shared = shared_keys(docs, text_col, width, percent)
        members = cut_lineage(_meetings(incidence(docs, id_col, text_col, width, percent, shared)))
        shared.held.destroy()
        rows = cut_lineage(incidence(docs, id_col, text_col, width, None).select("doc_id", "node", "n_shingles"))
        labels = _node_components(docs, rows, members, id_col, text_col, width, percent)
        return named_components(rows, labels)


def named_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row per document (doc_id, node, n_shingles): its component's id, and its node and label."""
    # nodes with several documents or with links, their documents and components by partial aggregates
    own = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = own.withColumn("label", F.lit(None).cast("bigint")) if labels is None else own.join(labels, "node", "left")
    placed = stored(placed.where("copies > 1 or label is not null"))
    of_label = stored(placed.where("label is not null").groupBy("label").agg(F.min("first").alias("least")))
    named = placed.join(_small(of_label), "label", "left").select(
        "node", F.when(F.col("label").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("named"),
        F.coalesce("label", "node").alias("label"), F.lit(True).alias("found")
    )
    joined = rows.select("doc_id", "n_shingles", "node").join(_small(stored(named)), "node", "left")
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("found"), F.col("named")).otherwise(F.col("doc_id")).alias("component_id"),
        "node", F.coalesce("label", "node").alias("label")
    )


def _small(table: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is proven small; otherwise Spark splits skewed keys."""
    return F.broadcast(table) if fits(table, BROADCAST_IDS) else table


def _node_components(docs, rows, members, id_col, text_col, width, percent) -> DataFrame | None:
    """(node, label) of all nodes that are linked to another."""
    if members.isEmpty():
        return None
    sent = rows.where("node is not null").select("doc_id", "node")
    return resolved(members, sets_of(docs, sent, members, id_col, text_col, width), percent, most_parts=MOST_PARTS)


def sets_of(docs: DataFrame, sent: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, grams, sketch) of all nodes of ``members``, each from one of its documents in ``sent`` (doc_id, node)."""
    met = members.select("node").distinct()
    wanted = sent.join(met, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut_lineage(wanted)
    ids = _small(wanted.select(F.col("doc_id").alias("_id")))
    some = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(
        ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
    )
    arrays = gram_arrays(some, "doc_id", "text", width).join(met, "node", "left_semi").select("node", "grams", "sketch")
    return by_node(arrays)


def by_node(rows: DataFrame) -> DataFrame:
    """One row per node, written in buckets of nodes, so joins on nodes do not move it again."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "by-node")
    table = f"galley_by_node_{path[-32:]}"
    once = rows.repartition(buckets, "node").dropDuplicates(["node"])
    once.write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(table)
    return spark.table(table)


def resolved(
    members: DataFrame, arrays: DataFrame, percent: int, likely: Callable[[DataFrame], DataFrame] | None = None,
    most_parts: int = 1,
) -> DataFrame | None:
    """(node, label) of the components that links between members (key, node, n_shingles) of a key make.

    ``likely`` may leave out pairs (a, b) that need no exact count. A round is made in up to ``most_parts``
    parts, which keeps disk low if the shuffle files of each are removed (``shuffles_removed``).
    """
    labels: DataFrame | None = None
    compared: DataFrame | None = None
    meetings, pivots = members.withColumn("scope", F.lit(0).cast("bigint")), 1
    while True:
        ranked = stored(_ranked(meetings))
        pairs = _pairs(ranked, arrays, labels, pivots, percent)
        if compared is not None:  # pairs that meet again were no link before
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        compared = pairs if compared is None else compared.union(pairs)
        some = _in_parts(pairs, _parts(pairs.count(), PART_PAIRS, most_parts) if most_parts > 1 else 1, "a", "b")
        found = reduce(DataFrame.union, [stored(_linked(likely(x) if likely else x, arrays, percent)) for x in some])
        if not found.isEmpty():
            labels = joined_components(labels, found)
        # the pivots have met all; the others of their groups may still link components
        open_rows = stored(_several_labels(ranked.where(F.col("rank") > pivots).drop("pivot_size"), labels))
        if open_rows.isEmpty():
            return labels
        n = open_rows.select("scope", "pivot", "node").distinct().count() if most_parts > 1 else 1
        some = _in_parts(open_rows, _parts(n, PART_MEMBERS, most_parts), "scope", "pivot")
        meetings = reduce(
            DataFrame.union, [stored(_several_labels(_next_meetings(x, arrays, percent).distinct(), labels)) for x in some]
        )
        if meetings.isEmpty():
            return labels
        pivots *= MORE_PIVOTS


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similarity_components(docs).select("doc_id", "n_shingles", "component_id")


def near_duplicates_stage(
    spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Pipeline stage: one document of each component, that of the smallest id.

    The pipeline calls it with ``STAGE_WIDTH`` and ``STAGE_PERCENT``.
    Documents without n-grams stay, and so do rows with a null id, as no
    decision can be carried to them. Rows that repeat an id are decided one by
    one, by their sets; a component keeps one set of its id, and of rows of
    equal id and equal set the smallest is kept.
    """
    rows = similarity_components(docs, width=width, percent=percent).where("doc_id is not null")
    leaves = F.col("node").isNotNull() & (F.col("component_id") != F.col("doc_id"))
    by_id = rows.groupBy("doc_id").agg(F.min(leaves).alias("_leaves"), (F.count(F.lit(1)) > 1).alias("_repeats"))
    marked = cut_lineage(by_id.where("_leaves or _repeats"))
    other = _small(marked.withColumnRenamed("doc_id", "_id"))
    kept = docs.join(other, F.col("doc_id") == F.col("_id"), "left").where(~F.coalesce(F.col("_leaves"), F.lit(False)))
    repeats = F.coalesce(F.col("_repeats"), F.lit(False))
    once = kept.where(~repeats).select(*docs.columns)
    again = marked.where("_repeats").select("doc_id")
    if again.isEmpty():
        return once
    # ids that rows repeat: the sets that stay, and one row of each
    stays = rows.join(_small(again), "doc_id", "left_semi").where(~leaves).groupBy("doc_id", "label").agg(F.min("node").alias("node"))
    sets = _small(cut_lineage(stays.select(F.col("doc_id").alias("_id"), F.col("node").alias("_set"))))
    named = _with_node(kept.where(repeats).select(*docs.columns), width)
    of_sets = named.join(sets, (F.col("doc_id") == F.col("_id")) & F.col("_node").eqNullSafe(F.col("_set")), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = of_sets.groupBy("doc_id", "_node").agg(F.min(F.struct("text", *rest)).alias("_row"))
    return once.unionByName(first.select("doc_id", "_row.*"))


def _with_node(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` and the node of each text, ``_node``."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (gram_set(t.as_py(), width) for t in batch.column(at))
            nodes = pa.array([node_of(g) if len(g) else None for g in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(rows, docs.withColumn("_node", F.lit(None).cast("bigint")).schema)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'
  ), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
  END AS grams
  FROM w
), n AS (SELECT doc_id, len(grams)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
sets AS (SELECT s.doc_id, n.n, md5(array_to_string(list_sort(grams), chr(10))) AS name FROM s JOIN n USING (doc_id) WHERE n.n > 0),
rep AS (SELECT name, n, min(doc_id) AS doc_id FROM sets GROUP BY ALL),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT g.*, rep.n FROM g JOIN rep USING (doc_id)) a JOIN (SELECT g.*, rep.n FROM g JOIN rep USING (doc_id)) b
    ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM rep
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node),
comp AS (
  SELECT sets.doc_id, label.label FROM sets JOIN rep USING (name) JOIN label ON label.node = rep.doc_id
), least AS (SELECT label, min(doc_id) AS component_id FROM comp GROUP BY label)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN comp USING (doc_id) LEFT JOIN least USING (label)
"""
