from __future__ import annotations

import random
import re
import zlib

import pytest

from galley.llm import rule_ensemble as R

F = R.F


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=700):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = [word() for _ in range(rnd.randint(5, 60))]
        if not good:
            kind = rnd.randrange(3)
            words = [w + rnd.choice(["###", "$$$", "%%%"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:4] * 15
        rows.append((i, " ".join(words) + "."))
        if rnd.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en", 0.5, "x") for r in rows], "doc_id bigint, text string, lang string, score double, _stats string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1), (4, 7), (5, 0), (5, 0)], "doc_id bigint, quality int")
    return docs.repartition(3), marks, R.fit(docs, marks), dict(rows), dict(labels)


def test_held_out_accuracy(made):
    docs, _, model, _, labels = made
    got = {r.doc_id: r for r in R.score_documents(docs, model).collect()}
    pairs = [(got[i].predicted, y) for i, y in labels.items() if held_out(i)]
    assert len(pairs) > 60 and sum(a == b for a, b in pairs) >= 0.93 * len(pairs)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_model_is_a_few_rules_over_statistics(made):
    model = made[2]
    assert 0 < len(model.rules) < 60
    assert all(b.name in R.NAMES for _, rule in model.rules for b in rule)


def test_score_equals_rules_by_hand(made):
    docs, _, model, _, _ = made
    rows = R.with_statistics(docs.drop("_stats")).withColumn("s", model.score(F.col("_stats"))).collect()
    for r in rows:
        total = model.intercept
        for weight, rule in model.rules:
            if all((r._stats[b.name] <= b.value) == b.at_most for b in rule):
                total += weight
        assert r.s == pytest.approx(1 / (1 + 2.718281828459045**-total), abs=1e-9)


def test_held_out_labels_are_never_read(spark, made):
    docs, marks, model, _, _ = made
    flipped = marks.withColumn("quality", F.when(R.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = R.fit(docs, flipped)
    assert [r for _, r in other.rules] == [r for _, r in model.rules]
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), R.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == held_out(r.doc_id) for r in ids)


def test_statistics_by_hand(spark):
    texts = ["", None, "Hello WORLD hello\n\nline 2!", "É ß #a# " * 3, "x" * 300_000 + "\n" + "y " * 100_000]
    for r in R.with_statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        t, s = r.text or "", r._stats
        words, lines = t.split(), [x for x in t.split("\n") if x]
        assert (s.chars, s.words, s.lines) == (len(t), len(words), len(lines))
        assert s.upper == (sum(c.isupper() for c in t) / len(t) if t else 0)
        assert s.distinct_words == (len({w.lower() for w in words}) / len(words) if words else 0)
        assert s.symbols == (len(re.findall(r"[#$%&*@~^|<>{}\[\]\\_=+]", t)) / len(t) if t else 0)


def test_names_are_those_of_the_statistics(spark):
    assert tuple(R.statistics(F.lit(""))) == R.NAMES


def test_tree_paths():
    text = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      Predict: 1.0
    Else (feature 3 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 0.0
"""
    name = R.NAMES[3]
    low, mid, high = R.Bound(name, True, 0.5), R.Bound(name, False, 0.25), R.Bound(name, False, 0.5)
    assert R.tree_rules(text) == [(low,), (R.Bound(name, True, 0.25),), (mid, low), (high,)]


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1), (2, 1), (3, 1)], None), ([(1, 0)], None)])
def test_without_both_labels_the_score_is_their_share(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c"), (None, "d")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    used = [y for i, y in labels if not held_out(i) for _ in range(2 if i == 3 else 1)]  # row 3 is there twice
    want = (sum(used) + 1) / (len(used) + 2)
    got = R.score_documents(docs, R.fit(docs, marks)).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(want) for r in got)


def test_empty_table(spark, made):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    model = R.fit(docs, made[1])
    assert R.score_documents(docs, model).count() == 0
