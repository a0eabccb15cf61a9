"""SentencePiece encoding and decoding, sharing forward states between words.

Blanks become marks, one is put in front, and the text is cut into marked
words, which no piece crosses. The distinct words of a stretch of texts are
sorted, so that words with a common prefix follow each other as in a
depth-first walk of their trie. For each prefix on the way the forward state is kept:
the last piece of its best segmentation and where that piece starts. The next
word goes on from the states of the prefix it shares with the one before.

The vocabulary is one of merges (BPE), not of unigram probabilities: its
scores only order the merges, and the path of the highest sum of scores is not
what SentencePiece returns. So the lattice has a constraint in place of the
sum: a piece may follow another only if merging their characters gives exactly
these two pieces. A segmentation is the one of the merges exactly if all its
neighbours may follow each other, hence each prefix has one best path, and the
forward search finds the ids of the library itself. What may follow what is
remembered.

Texts are encoded where they are read; nothing is shuffled. Words are
remembered up to a bound, then forgotten at once.

Defined results: a null text is empty and has no id; characters without a
piece become their UTF-8 bytes; a literal mark decodes to a blank, as in the
library; repeated rows get the same answer; texts of any length are encoded
whole; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
#: Words (marks in front of them, line breaks apart) that no piece crosses.
WORD = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Words, and pairs of pieces, kept in memory by a worker.
REMEMBERED, REMEMBERED_PAIRS = 300_000, 1_000_000
#: Bits of the number of a piece, or of a character that has none.
CODE_BITS = 22
#: Characters of texts whose distinct words are sorted together.
STRETCH = 4_000_000


class Vocabulary:
    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], unknown: int = 0):
        self.pieces, self.scores, self.byte_ids, self.unknown = pieces, scores, byte_ids, unknown
        self.longest = max(map(len, pieces), default=1)
        self.words: dict[str, tuple[int, ...]] = {}
        self.follows: dict[int, bool] = {}
        self.strings = {i: p for p, i in pieces.items()}
        self.first_char = max(self.strings, default=0) + 1
        self.texts = {i: p.replace(MARK, " ") for p, i in pieces.items()}
        self.bytes = {i: b for b, i in enumerate(byte_ids)}

    # ---- merges ----

    def merged(self, text: str) -> list[str]:
        """Pieces by the merges themselves: the pair of the best score first, from the left."""
        symbols: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(text):
                score = self.scores.get(symbols[i] + symbols[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, symbols[i] + symbols[j]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i] if symbols[i] is not None else len(text)
            if j >= len(text) or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j], right[i] = piece, None, right[j]
            if right[i] < len(text):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s is not None]

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether the merges leave these two neighbours as they are (0 before: the start of a word)."""
        key = before << CODE_BITS | piece
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > REMEMBERED_PAIRS:
                self.follows.clear()
            pair = [self._string(before), self._string(piece)] if before else [self._string(piece)]
            # two that merge into one piece do not stay two
            known = "".join(pair[:2]) not in self.scores if before else True
            known = self.follows[key] = known and self.merged("".join(pair)) == pair
        return known

    def _code(self, piece: str) -> int | None:
        """A number for a piece, or for a single character without one."""
        known = self.pieces.get(piece)
        return known if known is not None else self.first_char + ord(piece) if len(piece) == 1 else None

    def _string(self, code: int) -> str:
        return chr(code - self.first_char) if code >= self.first_char else self.strings[code]

    # ---- forward search over sorted words ----

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not known yet, in sorted order."""
        asked = set(words)
        new = sorted(asked - self.words.keys())
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = sorted(asked)
        last, starts, word_before = [0], [0], ""
        for word in new:
            if word.startswith(MARK * 2) or word == MARK:
                body = word.lstrip(MARK)
                self.words[word] = self._with_blanks(body, len(word) - len(body))
                continue
            shared = 0
            for a, b in zip(word_before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            self._extend(word, last, starts)
            word_before = word
            self.words[word] = self._ids(self._path(last, starts))

    def _extend(self, word: str, last: list[int], starts: list[int]) -> None:
        """States of all prefixes of ``word`` that are not there yet."""
        find, follows, longest, chars = self.pieces.get, self.follows.get, self.longest, self.first_char
        for end in range(len(last), len(word) + 1):
            # as only one piece fits, the order is free: most often the last piece grows, or a new one starts
            start, code = starts[-1], find(word[starts[-1] : end])
            if code is None or not (follows(last[start] << CODE_BITS | code) or self.may_follow(last[start], code)):
                start = end - 1
                code = find(word[start])
                code = chars + ord(word[start]) if code is None else code
                if not (follows(last[start] << CODE_BITS | code) or self.may_follow(last[start], code)):
                    for start in range(max(0, end - longest), end - 1):
                        code = find(word[start:end])
                        if code is not None and (follows(last[start] << CODE_BITS | code) or self.may_follow(last[start], code)):
                            break
                    else:
                        raise AssertionError(f"no segmentation of {word[:end]!r}")
            last.append(code)
            starts.append(start)

    @staticmethod
    def _path(last: list[int], starts: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at = starts[at]
        return out[::-1]

    def _with_blanks(self, body: str, blanks: int) -> tuple[int, ...]:
        """Several marks in front: they merge among themselves, after all other merges."""
        codes: list[int] = []
        if body:
            last, starts = [0], [0]
            self._extend(MARK + body, last, starts)
            codes, blanks = self._path(last, starts), blanks - 1
            if codes[0] == self._code(MARK):
                codes, blanks = codes[1:], blanks + 1
        return self._ids([self._code(p) for p in self.merged(MARK * blanks)] + codes)

    def _ids(self, codes: list[int]) -> tuple[int, ...]:
        if max(codes, default=0) < self.first_char:
            return tuple(codes)
        out: list[int] = []
        for c in codes:
            if c < self.first_char:
                out.append(c)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in self._string(c).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return tuple(out)

    # ---- texts ----

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(chain.from_iterable(cut))
        return [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.texts.get(i, ""))
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


@cache
def vocabulary(model: str) -> Vocabulary:
    """The pieces of a model file, once per Python worker."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    plain = [i for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    bytes_of = {sp.id_to_piece(i): i for i in range(len(sp)) if sp.is_byte(i)}
    return Vocabulary(
        {sp.id_to_piece(i): i for i in plain},
        {sp.id_to_piece(i): sp.get_score(i) for i in plain},
        [bytes_of[f"<0x{b:02X}>"] for b in range(256)] if bytes_of else [],
        sp.unk_id(),
    )


SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean, ids array<int>"


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", keep_ids: bool = True
) -> DataFrame:
    """Ids of each text, their number and checksum, and whether decoding gives the text again."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, first = [], 0, at
                while at < batch.num_rows and held < STRETCH:
                    texts.append(batch.column(1)[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                ids = known.encode(texts)
                crc = [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
                same = [known.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first), pa.array(map(len, ids), pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(same, pa.bool_()),
                        pa.array(ids if keep_ids else [None] * len(ids), pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"],
                )

    return docs.select(docs[id_col].cast("bigint"), docs[text_col]).mapInArrow(encoded, SCHEMA)


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of encoded texts; null ids give a null text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else known.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, text string")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, keep_ids=False).drop("ids")
