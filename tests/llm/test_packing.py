from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galley.llm import packing

VOCABULARY = "byte_bpe_50k.tiktoken"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64, 100]), st.booleans())
def test_every_token_once_and_no_gaps(lengths, capacity, tail):
    pieces = packing.pack(lengths, capacity, tail)
    covered = defaultdict(list)
    filled = defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        assert n > 0
        covered[doc].append((start, n))
        filled[sequence].append((offset, n))
    for doc, total in enumerate(lengths):
        at = 0
        for start, n in sorted(covered[doc]):
            assert start == at
            at += n
        assert at == total
    sizes = packing.sequence_sizes(sum(lengths), capacity, tail)
    assert sorted(filled) == list(range(len(sizes)))
    for sequence, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == sizes[sequence] <= capacity
        assert at == capacity or not tail or at & (at - 1) == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(5, 400, 2000).tolist()
    spent = defaultdict(float)
    for _, _, n, sequence, _ in packing.pack(lengths):
        spent[sequence] += packing.cost(n)
    costs = np.array(list(spent.values())[: sum(lengths) // packing.CAPACITY])
    in_order, at = defaultdict(float), 0
    for n in lengths:
        in_order[at // packing.CAPACITY] += packing.cost(n)
        at += n
    plain = np.array(list(in_order.values()))
    assert costs.std() < 0.6 * plain.std()


def test_ids_equal_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    json_form = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["a " + c * 2 + " b" + c + "1" for c in chars] + ["x<|endoftext|>y", "", " \n\t ", "it's we'll", "a" * 3000]
    want = [e.ids + [0] for e in json_form.encode_batch(texts, add_special_tokens=False)]
    assert [packing.token_ids(t, VOCABULARY).tolist() for t in texts] == want


@pytest.fixture(scope="module")
def rows():
    return [(1, "hello world"), (2, None), (3, ""), (4, "many words here. " * 5000), (4, "many words here. " * 5000), (None, "no id"), (5, "x")]


def test_documents(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, start int, sequence_id int").repartition(2)
    got = packing.pack_documents(docs, block_tokens=3000).collect()
    texts = {i: packing.token_ids(t, VOCABULARY) for i, t in rows}
    for r in got:
        ids = texts[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(len(texts[i]) for i, _ in rows)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].sequence_tokens


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
