"""The pipeline's stage next to brute force at five words and a similarity of 0.8."""

from __future__ import annotations

import random
from collections import defaultdict

from test_ngram_join import corpus, words_of

import corpus_pipeline

STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]


def grams_of(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b)


def kept_by_hand(rows):
    """Ids of the documents that stay; ids are distinct."""
    sets = [grams_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted(d for i, (d, _) in enumerate(rows) if not sets[i] or d == min(least[find(i)]))


def between():
    """Pairs that only the pipeline's rule links: a passage replaced, or words appended."""
    rnd = random.Random(5)
    pairs = []
    for n in (100, 150, 400):
        words = [f"w{n}_{i}" for i in range(n)]
        k = n * 6 // 100
        pairs.append((words, words[: n // 2] + [f"x{n}_{i}" for i in range(k)] + words[n // 2 + k :]))
        pairs.append(([f"v{w}" for w in words], [f"v{w}" for w in words] + [f"y{n}_{i}" for i in range(n * 18 // 100)]))
    rnd.shuffle(pairs)
    return [(" ".join(a), " ".join(b)) for a, b in pairs]


def stage(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return STAGE(spark, docs.repartition(4), "").collect()


def test_pairs_between_the_two_rules_are_near_copies(spark):
    rows = [(10 * i + j, t) for i, pair in enumerate(between()) for j, t in enumerate(pair)]
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        assert likeness(grams_of(a), grams_of(b)) >= 0.8 and likeness(grams_of(a, 3), grams_of(b, 3)) < 0.9
    assert sorted(r.doc_id for r in stage(spark, rows)) == [i for i, _ in rows[::2]] == kept_by_hand(rows)


def test_stage_equals_brute_force(spark):
    texts = [t for _, t in corpus(4)] + [t for pair in between() for t in pair]
    rows = [*zip(random.Random(6).sample(range(1000), len(texts)), texts, strict=True)]
    assert sorted(r.doc_id for r in stage(spark, rows)) == kept_by_hand(rows)


def test_rows_that_repeat_an_id_are_decided_by_their_sets(spark):
    word = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    a, b, c, d = word("a"), word("b"), word("c"), word("d")
    rows = [
        (1, a), (2, a + " end"), (2, b),  # the copy leaves, the other text of its id does not
        (3, c), (3, d), (4, c + " end"), (5, d),  # an id that names two components
        (6, word("e")), (6, word("E")), (6, word("e") + " end"),  # one set twice, and a near copy of it
        (7, ""), (7, None), (7, " "), (7, word("f")), (8, a), (8, b + " end"),
        (None, a), (None, None),
    ]
    got = sorted(((r.doc_id, frozenset(grams_of(r.text))) for r in stage(spark, rows)), key=str)
    e = next(s for i, s in got if i == 6)
    assert e in (grams_of(word("e")), grams_of(word("e") + " end"))
    want = [(1, a), (2, b), (3, c), (3, d), (7, None), (7, word("f")), (None, a), (None, None)]
    assert got == sorted([*((i, frozenset(grams_of(t))) for i, t in want), (6, e)], key=str)
