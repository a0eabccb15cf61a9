from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from galley.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, t1 string, n1 long"


def nodes_by_hand(sequences):
    """The contract's rows from {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        own = (len(m) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in children
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], digest(ends.get(p, [])))
        for p, m in members.items()
    )


def turns_by_hand(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, name, role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}


def rebuilt_by_hand(rows):
    own, out = turns_by_hand(rows), {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + seq[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 9) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    texts = ["", "a", "hello there", "é😀", "x" * 500, None]
    rows = []
    for c in range(n):
        size = rnd.choice((1, 2, 3, 5, 8, 9, 16, 17, 25))
        rows += [(c * 7, t, rnd.choice(("user", "assistant", None)), rnd.choice(texts)) for t in range(size)]
    same = [(t, "user", f"turn {t}") for t in range(40)]
    for c in range(1000, 1040):  # copies, and copies that end early or go on
        rows += [(c, *x) for x in same[: rnd.choice((40, 40, 40, 20, 16, 8, 3))]] + [(c, 50, "user", "more")] * rnd.randrange(2)
    return rows


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie_equals_brute_force(spark, block):
    rows = corpus(block)
    rnd = random.Random(2)
    rnd.shuffle(rows)
    assert got(P.conversation_trie(table(spark, rows), block=block)) == nodes_by_hand(turns_by_hand(rows))


ODD = [
    (5, None, "user", "first"), (5, None, None, "first"), (5, 2, "user", None), (5, 2, "user", ""), (5, 2, "user", ""),
    (6, 1, "ab", "c"), (7, 1, "a", "bc"), (8, -3, "a", "bc"), (8, 10**12, "a", "z"), (None, 1, "user", "lost"), (None, None, None, None),
    (-250, 1, "user", "below"), (-200, 1, "user", "head"), (101, 3, "r", "long " * 40_000), (102, 3, "r", "long " * 40_000),
]


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(5) + ODD + [(100, t, "user", f"head {t}") for t in range(3)] + [(c, t, "user", f"own {t}") for c in range(103, 180) for t in range(c % 9)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(P.op11_query(spark, str(tmp_path))) == nodes_by_hand(rebuilt_by_hand(rows))


def test_long_conversations_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "TURN_RANGE", 10)
    rows = [(c, t, "user", f"{t % 7}") for c in (1, 2, 3) for t in range(95 - c)] + [(4, None, "user", "x"), (4, -5, "user", "y"), (4, 3, "user", "z")]
    assert got(P.conversation_trie(table(spark, rows))) == nodes_by_hand(turns_by_hand(rows))


def test_nothing_but_turnless_conversations(spark):
    # the ids' own turns are all replaced, and their head is not there
    short = [c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 1][:4]
    rows = [(c, 0, "user", "gone") for c in short]
    convs, placed = P.rebuilt(table(spark, rows))
    want = (min(short), 0, -1, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(short))).encode()).hexdigest())
    assert got(P.prefix_trie(convs, placed)) == [want] == nodes_by_hand(rebuilt_by_hand(rows))


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert P.op11_query(spark, str(tmp_path)).collect() == []


def test_pieces_of_ids_make_one_digest(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 3)
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.randrange(2), i - 40) for i in range(400)]
    groups = defaultdict(list)
    for a, b, i in rows:
        groups[a, b].append(i)
    df = spark.createDataFrame(rows, "n1 bigint, n2 bigint, conv_id bigint").repartition(5)
    want = {(*k, hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for k, v in groups.items()}
    assert {tuple(r) for r in P.end_digests(df).collect()} == want
