"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs.

A text is a multiset of blocks: its paragraphs (lines), where a long paragraph
counts as its sentences. Each block is hashed (SHAKE-128) to a vector of
``LANES`` small signed numbers, and the fingerprint is the sum of the vectors
modulo 2^32 per lane, with a lane for the number of blocks modulo 2^32. The
order of blocks does not matter, blocks can be put in or taken out by adding or
subtracting, and equal multisets have equal fingerprints.

Two fingerprints differ by the sum over the blocks that only one text has, so
the mean square of the lane differences estimates how many these are (with a
relative error of about sqrt(2 / LANES), for up to some 10^14 blocks: the lanes
are that wide). ``likeness`` turns that number into
1 - (blocks of one text only) / (blocks of both), from 0 to 1; equal
fingerprints give exactly 1.

Blocks hold all characters of the text, so texts that differ have different
multisets unless they are reorderings. Defined results: a null text is empty;
the empty text has no block, its fingerprint is zero, and its likeness to
another empty text is 1, to any other text 0. The lanes are meant for equality
and likeness of honest texts, not against an attacker who builds collisions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = 128
#: Variance of a lane of one block: whole numbers from -128 to 127.
LANE_VARIANCE = (256**2 - 1) / 12 + 0.25
#: A block ends after a line break, or after a sentence end and the blanks behind it.
BLOCK = re.compile(r"[^\n.!?]*(?:[.!?]+[^\S\n]*\n?|\n|\Z)")
#: Ranges of ids, each sorted by itself, per shuffle partition.
RANGES_PER_PARTITION = 4
MAX_RANGES = 4096


def blocks(text: str) -> list[str]:
    return [b for b in BLOCK.findall(text) if b]


class Fingerprint:
    """Sum of block vectors; ``+`` and ``-`` combine multisets."""

    __slots__ = ("lanes", "count")

    def __init__(self, lanes: np.ndarray | None = None, count: int = 0):
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes
        self.count = count & 0xFFFFFFFF

    @classmethod
    def of_blocks(cls, parts: list[str]) -> Fingerprint:
        if not parts:
            return cls()
        total = np.zeros(LANES, np.int64)
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            digests = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(LANES) for p in some)
            total += np.frombuffer(digests, np.int8).reshape(-1, LANES).sum(axis=0, dtype=np.int64)
        return cls((total & 0xFFFFFFFF).astype(np.uint32), len(parts))

    @classmethod
    def of_text(cls, text: str) -> Fingerprint:
        return cls.of_blocks(blocks(text))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.count + other.count)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.count - other.count)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.count == other.count and bool((self.lanes == other.lanes).all())

    def __hash__(self) -> int:
        return hash((self.count, self.lanes.tobytes()))

    def hex(self) -> str:
        return f"{self.count:08x}" + self.lanes.astype(">u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        return cls(np.frombuffer(bytes.fromhex(text[8:]), ">u4").astype(np.uint32), int(text[:8], 16))

    def likeness(self, other: Fingerprint) -> float:
        both = self.count + other.count
        if self == other:
            return 1.0
        if both == 0:
            return 0.0
        gap = (self.lanes - other.lanes).view(np.int32).astype(np.float64)
        alone = float((gap * gap).mean()) / LANE_VARIANCE
        # at least the difference of the counts, at least one block, at most all of them
        alone = min(max(alone, abs(self.count - other.count), 1.0), both)
        return 1.0 - alone / both


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprint(text: str, own: Fingerprint, after: str) -> Fingerprint:
    """Fingerprint of the edited text from that of the text, by taking out and putting in blocks."""
    parts = blocks(text)
    new = edited(text, after)
    kept, at = 0, 0
    keep = len(text) - len(text) // 2
    # a block that ends before the cut may still grow if the cut is inside its ending
    while kept < len(parts) and at + len(parts[kept]) < keep - 1 and parts[kept].endswith("\n"):
        at += len(parts[kept])
        kept += 1
    stable = 0 if kept == 0 else at
    removed = Fingerprint.of_blocks(parts[kept:])
    return own - removed + Fingerprint.of_text(new[stable:])


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _ranges(docs: DataFrame, spark: SparkSession) -> tuple[DataFrame, list[int]]:
    """``docs`` with ``part``, the number of its range of ids (null ids first), and the bounds."""
    n = min(MAX_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / n for k in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * n)).first()[0]
    bounds = sorted(set(found or []))
    marks = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(marks, lambda b: b < F.col("doc_id"))), F.lit(0))
    return docs.withColumn("part", part), bounds


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, see ``SCHEMA``.

    Whole texts are shuffled once, into sorted ranges of ids, and read as a
    stream. The first document of a range is also sent to the range before it
    (that of the first range to the last), as there it follows the last one.
    Rows that repeat an id are ordered by text; a null id comes first. A table
    of one row follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ranged, bounds = _ranges(rows, spark)
    # per range its first id: at most MAX_RANGES rows
    firsts = ranged.groupBy("part").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null")
    )
    known = sorted((r["part"], None if r["has_null"] else r["low"]) for r in firsts.collect())
    parts = [p for p, _ in known]
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    as_map = F.create_map(*[F.lit(x) for p in parts for x in (p, before[p])])
    lows = F.create_map(*[x for p, low in known for x in (F.lit(p), F.lit(low).cast("bigint"))])
    is_first = lows[F.col("part")].eqNullSafe(F.col("doc_id"))
    places = F.when(
        is_first,
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("border")),
            F.struct(as_map[F.col("part")].alias("part"), F.lit(True).alias("border")),
        ),
    ).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("border"))))
    placed = ranged.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.border")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(tasks, "part").sortWithinPartitions("part", "border", "doc_id", "text")
    return ordered.select("part", "border", "doc_id", "text").mapInArrow(_stream, SCHEMA)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    part, held, held_print, closed = None, None, None, True

    def finish(after: str, after_print: Fingerprint) -> None:
        doc_id, text = held
        new = edited(text, after)
        new_print = edited_fingerprint(text, held_print, after)
        out.append(
            (
                doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held_print.hex(),
                new_print.hex(), held_print.likeness(new_print), held_print.likeness(after_print),
            )
        )

    def ready() -> pa.RecordBatch:
        columns = zip(*out) if out else [[] for _ in names]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for row_part, border, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if row_part != part:
                part, held, closed = row_part, None, False
            if closed:
                continue  # further rows that repeat the id of the border
            own = Fingerprint.of_text(text)
            if held is not None:
                finish(text, own)
            if border:
                closed, held = True, None
            else:
                held, held_print = (doc_id, text), own
        yield ready()
    yield ready()


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
