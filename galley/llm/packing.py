"""Cost-balanced packing of token sequences.

The cost of a piece is linear in its tokens plus a term for attention, which
is quadratic. Texts are tokenized and packed where they are read, in blocks of
a bounded number of tokens: nothing is shuffled, a hot source is as good as
any other, and a lost task is simply run again with the same result. Within a
block, full sequences are cut off long documents first; the rest is assigned
in order of descending cost to the sequence of lowest cost that has room.
Only when no sequence has room for the whole, the sequence of lowest cost is
filled with a part and the remainder goes on as a document of its own.

The sequences of a block hold exactly its tokens: as many of ``capacity`` as
it fills, and the remainder in sequences of powers of two, which need no
padding. So no sequence is padded at all; if that is unwanted, ``power_tail``
false packs the remainder into one last sequence.

Defined results: a null or empty text has the end token alone; rows that
repeat a document are packed as often; a null id is kept; columns other than
id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

CAPACITY = 1024
END_ID = 0
#: Tokens packed together at most, but for a document that is longer by itself.
BLOCK_TOKENS = 2_000_000
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bits of a sequence id that count within a task.
SEQUENCE_BITS = 36
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, sequence_tokens bigint"
)


def cost(length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * length + quadratic * length * length


class Room:
    """Open sequences by remaining room: finds the one of lowest cost that has enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.best: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def _refresh(self, room: int) -> None:
        heap, at = self.heaps[room], room + self.size
        self.best[at] = (*heap[0], room) if heap else None
        while at := at >> 1:
            left, right = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = left if right is None or (left is not None and left < right) else right

    def add(self, sequence_cost: float, sequence: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (sequence_cost, sequence))
            self._refresh(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest with room for ``least``."""
        lo, hi, found = least + self.size, 2 * self.size, None
        while lo < hi:
            if lo & 1:
                found = min(filter(None, (found, self.best[lo])), default=None)
                lo += 1
            lo, hi = lo >> 1, hi >> 1
        if found:
            heapq.heappop(self.heaps[found[2]])
            self._refresh(found[2])
        return found


def sequence_sizes(tokens: int, capacity: int, power_tail: bool = True) -> list[int]:
    """Room of the sequences that hold ``tokens`` tokens."""
    full, rest = divmod(tokens, capacity)
    tail = [1 << b for b in range(rest.bit_length()) if rest >> b & 1][::-1] if power_tail else [rest][: rest > 0]
    return [capacity] * full + tail


def pack(lengths: list[int], capacity: int = CAPACITY, power_tail: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); every token in exactly one."""
    sizes = sequence_sizes(sum(lengths), capacity, power_tail)
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # (-length, document, start)
    used = 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, used, 0))
            used += 1
        if n % capacity:
            waiting.append((-(n % capacity), doc, whole * capacity))
    room = Room(capacity)
    for sequence in range(used, len(sizes)):
        room.add(0.0, sequence, sizes[sequence])
    heapq.heapify(waiting)
    while waiting:
        minus, doc, start = heapq.heappop(waiting)
        n = -minus
        found = room.take(n) or room.take(1)
        spent, sequence, left = found
        part = min(n, left)
        pieces.append((doc, start, part, sequence, sizes[sequence] - left))
        room.add(spent + cost(part), sequence, left - part)
        if part < n:
            heapq.heappush(waiting, (part - n, doc, start + part))
    return pieces


@cache
def encoder(vocabulary: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)):
    """The byte-level BPE vocabulary as an encoder, once per Python worker.

    The ranked form of the vocabulary gives the same ids as its JSON form five
    times as fast; tests compare the two on every code point.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)
    )


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
    power_tail: bool = True,
) -> DataFrame:
    """One row per piece, see ``SCHEMA``; ``sequence_tokens`` is the sequence's own length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        block: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def rows() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(ids) for _, ids in block]
            pieces = pack(lengths, capacity, power_tail)
            sizes = sequence_sizes(sum(lengths), capacity, power_tail)
            doc, start, length, sequence, offset = zip(*pieces) if pieces else [()] * 5
            crc = [zlib.crc32(block[d][1][s : s + n]) for d, s, n in zip(doc, start, length)]
            columns = [
                [block[d][0] for d in doc], start, length, crc, [lengths[d] for d in doc],
                [first + s for s in sequence], offset, [sizes[s] for s in sequence],
            ]
            first += len(sizes)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.append((doc_id.as_py(), token_ids(text.as_py(), vocabulary)))
                held += len(block[-1][1])
                if held >= block_tokens:
                    yield rows()
                    block, held = [], 0
        yield rows()

    return docs.select(docs[id_col].cast("bigint"), docs[text_col]).mapInArrow(packed, SCHEMA)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents."""
    return pack_documents(docs)
