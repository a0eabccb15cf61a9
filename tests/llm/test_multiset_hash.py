from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from galley.llm import multiset_hash as M

TEXT = st.text(alphabet="ab.!? \n\ré", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_incremental_edit_equals_fresh_hash(a, b):
    assert "".join(M.blocks(a)) == a
    own = M.Fingerprint.of_text(a)
    assert M.edited_fingerprint(a, own, b) == M.Fingerprint.of_text(M.edited(a, b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=12), st.randoms())
def test_order_does_not_matter_and_parts_add_up(parts, rnd):
    whole = M.Fingerprint.of_blocks(parts)
    mixed = parts[:]
    rnd.shuffle(mixed)
    assert M.Fingerprint.of_blocks(mixed) == whole
    cut = len(parts) // 2
    first, second = M.Fingerprint.of_blocks(parts[:cut]), M.Fingerprint.of_blocks(parts[cut:])
    assert first + second == whole and whole - second == first
    assert M.Fingerprint.from_hex(whole.hex()) == whole


def test_likeness_follows_the_shared_part():
    rnd = random.Random(5)
    line = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(30)) + "\n"
    lines, others = [line() for _ in range(200)], [line() for _ in range(200)]
    base = M.Fingerprint.of_blocks(lines)
    for kept in (0, 50, 100, 150, 199):
        other = M.Fingerprint.of_blocks(lines[:kept] + others[: 200 - kept])
        assert abs(base.likeness(other) - kept / 200) < 0.3
    assert base.likeness(base) == 1.0 and M.Fingerprint().likeness(M.Fingerprint()) == 1.0
    assert M.Fingerprint().likeness(base) == 0.0


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, print_new, print_after = (M.Fingerprint.of_text(t) for t in (text, new, after))
        out.append(
            (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), print_new.hex(), own.likeness(print_new), own.likeness(print_after))
        )
    return sorted(out, key=str)


def test_neighbours(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab. \né") for _ in range(rnd.randint(0, 40)))) for i in rnd.sample(range(500), 120)]
    rows += [(rows[0][0], "again"), rows[1], (None, "null id"), (None, None), (1000, None), (1001, "ab. " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, part int, border string").repartition(5)
    assert sorted(map(tuple, M.fingerprint_neighbours(docs).collect()), key=str) == brute(rows)


def test_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "One. Two.")], "doc_id bigint, text string")
    assert sorted(map(tuple, M.fingerprint_neighbours(docs).collect()), key=str) == brute([(3, "One. Two.")])
    assert M.fingerprint_neighbours(docs.limit(0)).count() == 0


def test_unlike_texts_of_many_lines_stay_unlike():
    a = M.Fingerprint.of_blocks([f"a{i}\n" for i in range(120_000)])
    b = M.Fingerprint.of_blocks([f"b{i}\n" for i in range(120_000)])
    both = M.Fingerprint.of_blocks([f"{'a' if i < 60_000 else 'c'}{i}\n" for i in range(120_000)])
    assert a.likeness(b) < 0.3 and abs(a.likeness(both) - 0.5) < 0.15
