from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from galley.llm import ngram_join as J


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def grams_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted(
        [(d, len(sets[i]), (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str
    )


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "k", 7) for r in rows], "doc_id bigint, text string, node bigint, key string, rank int")
    got = J.similarity_components(docs.repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=str)


def corpus(seed):
    """Chains, stars, near misses, a shared passage, copies, and odd texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(30), []

    def edited(words, edits):
        out = words[:]
        for _ in range(edits):
            out[rnd.randrange(len(out))] = word()
        return out

    for n in (9, 12, 20, 45, 90, 200):
        base = text(n)
        now = base
        for _ in range(6):  # a chain: each a copy of the one before
            rows.append(now)
            now = edited(now, rnd.choice([0, 1, n // 60 + 1]))
        for _ in range(14):  # a star about the base
            rows.append(edited(base, rnd.choice([1, 1, n // 60 + 1])))
        rows.append(base[:-1])
        rows.append(base + text(rnd.choice([1, 2])))
    rows += [passage + text(40) for _ in range(15)] + [text(k) for k in (1, 1, 2, 2, 3, 4) for _ in range(3)]
    texts = [rnd.choice([" ", "\n", "\t "]).join(w) for w in rows]
    texts += [texts[0].upper(), "  " + texts[1] + "\n", "a b", "A  b", "a", "", "", " \n", None, None, "é É", "é é"]
    ids = rnd.sample(range(1000), len(texts))
    return [*zip(ids, texts), (ids[0], texts[5]), (ids[3], texts[3]), (None, texts[8]), (None, None), (None, "only null")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_group_whose_centre_is_not_linked_to_all(spark):
    # all share most n-grams, few pairs are links: several rounds of comparisons are needed
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = base[:]
        for k in range(3 + i % 3):
            words[rnd.randrange(120)] = f"x{i % 20}_{k}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_members_far_from_each_other_are_no_pairs(spark, monkeypatch):
    # near a centre that links to few, each with edits of its own that it shares with some: no pair of them is a link
    rnd = random.Random(5)
    rows = [(0, " ".join(f"w{i}" for i in range(200)))]
    for i in range(1, 120):
        words = rows[0][1].split()
        for k in range(8):
            at = rnd.randrange(199)
            words[at : at + 2] = [f"x{rnd.randrange(3)}_{at}", f"y{at}"]
        rows.append((i, " ".join(words)))
    counted, linked = [], J._linked
    monkeypatch.setattr(J, "_linked", lambda pairs, *rest: counted.append(pairs.count()) or linked(pairs, *rest))
    assert run(spark, rows) == brute(rows)
    assert len(counted) > 1 and sum(counted[1:]) < 100


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(2)
    for size, edits in [(0, 0), (1, 1), (5, 2), (300, 0), (300, 40), (300, 300), (20_000, 9000)]:
        a = rng.integers(0, 1 << 64, size, np.uint64)
        b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 64, edits, np.uint64)]))
        bits = np.unpackbits((J.sketch(np.unique(a)) ^ J.sketch(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b)) and len(J.sketch(b)) == J.SKETCH_WORDS and (bits > 0) == (edits > 0)


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_lose_no_linked_pair(percent):
    rng = np.random.default_rng(0)
    linked = 0
    for _ in range(6000):
        n, k = int(rng.integers(5, 150)), int(rng.integers(1, 12))
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[int(rng.integers(0, k + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(J.block_keys(a, percent), J.block_keys(b, percent)))
    assert linked > 500


def test_sets_of_few_members_share_no_key():
    rng = np.random.default_rng(1)
    for size in (4, 5, 8, 12, 40):
        seen = np.concatenate([np.unique(J.block_keys(np.unique(rng.integers(0, 1 << 64, size, np.uint64)), 80)) for _ in range(5000)])
        assert len(seen) == len(np.unique(seen))


def test_long_text_is_hashed_in_segments(monkeypatch):
    text = "Word " * 50 + "long" * 300 + " é\x0bA b\n" * 40
    want = J.gram_set(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(J, "SEGMENT", size)
        assert np.array_equal(J.gram_set(text), want)
    assert len(want) == len(grams_of(text))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_stage_keeps_one_of_each(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = J.near_duplicates_stage(spark, docs, "").collect()
    assert all(k.asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} for k in kept)
    by_id = defaultdict(list)
    for doc_id, n, component in brute(rows):
        if doc_id is not None:
            by_id[doc_id].append(n == 0 or doc_id == component)
    want = sorted(i for i, stays in by_id.items() if any(stays))
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == want
    assert sum(k.doc_id is None for k in kept) == sum(r[0] is None for r in rows)


def test_links_join_whole_components(spark):
    """Components of random links, given at once and in parts, against union by hand."""
    rnd = random.Random(5)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    name = {x: x for link in links for x in link}
    for _ in name:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
        if not changed:
            break
    table = lambda part: spark.createDataFrame(part, "a bigint, b bigint")
    labels = None
    for at in range(0, len(links), 100):
        labels = J.joined_components(labels, table(links[at : at + 100]))
    # a link of a node to itself names no component
    alone = {x for x in name if all(a == b for a, b in links if x in (a, b))}
    want = sorted((x, low) for x, low in name.items() if x not in alone)
    assert sorted(map(tuple, labels.collect())) == want
    assert sorted(map(tuple, J.joined_components(None, table(links)).collect())) == want


def test_keys_travel_short_and_are_not_written(spark, monkeypatch):
    """Keys of six bits meet by chance all the time, which links nothing; what is written holds no lists of keys."""
    from galley import session

    written, cut = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(J, "KEY_BITS", 6)
    before = spark.conf.get(session.REMOVE_SHUFFLES, None)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)
    assert written and not any("keys" in columns for columns in written)
    assert spark.conf.get(session.REMOVE_SHUFFLES, None) == before


def test_linked_sets_share_the_least_number_of_keys():
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        for size in (5, 9, 30, 120, 600):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
                gone = rng.integers(0, len(a) * (100 - percent) // 100 + 1)
                new = len(a) * (100 - percent) // 100 - gone
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 64, int(rng.integers(0, new + 1)), np.uint64)]))
                both = len(np.intersect1d(a, b))
                if np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                shared = [[len(np.intersect1d(x, y)) for y, _ in J.level_keys(b, percent)] for x, _ in J.level_keys(a, percent)]
                least_a, least_b = ([n for _, n in J.level_keys(s, percent)] for s in (a, b))
                assert any(shared[i][j] >= max(least_a[i], least_b[j]) for i in (0, 1) for j in (0, 1) if shared[i][j])


def test_a_passage_in_common_makes_no_meeting(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(200)
    docs = spark.createDataFrame([(i, passage + " " + words(200)) for i in range(4)], "doc_id bigint, text string")
    rows = J.incidence(docs, "doc_id", "text", 5, 80)
    assert not J._shared(rows.selectExpr("node", "explode(keys) as key")).isEmpty()
    assert J._meetings(rows).isEmpty()
    copies = docs.unionByName(docs.selectExpr("doc_id + 100 as doc_id", "text || ' end of it' as text"))
    assert J._meetings(J.incidence(copies, "doc_id", "text", 5, 80)).select("node").distinct().count() == 8


def test_keys_that_no_other_set_has_do_not_travel(spark, monkeypatch):
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, words(200)) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(2)]
    sent, meetings = [], J._meetings
    monkeypatch.setattr(J, "_meetings", lambda r: sent.extend(x.doc_id for x in r.where("keys is not null").collect()) or meetings(r))
    assert run(spark, rows) == brute(rows)
    assert {0, 1, 100, 101} <= set(sent) and len(sent) < 8


def test_small_bitmaps_pieces_and_parts_lose_no_link(spark, monkeypatch):
    """A bitmap of a few hundred bits has most keys, tasks send every few keys, and rounds are made in parts."""
    for name, value in {"MOST_RANGES": 8, "MOST_BITS": 11, "HELD_KEYS": 50, "PART_MEMBERS": 2, "PART_PAIRS": 2, "MOST_PARTS": 3}.items():
        monkeypatch.setattr(J, name, value)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_keys_in_planes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << 32, n, np.uint64))
        assert np.array_equal(J._of_planes(J._as_planes(keys)), keys)
    assert J._twice(np.array([1, 1, 1, 2, 3, 3, 3, 3])).tolist() == [1, 1, 2, 3, 3]
