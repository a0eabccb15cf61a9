"""Text helpers against plain Python formulas on random texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from galley import fixed
from galley.functions import terms as V
from galley.functions import text as T
from galley.operators import checks as K
from galley.operators import corpus as C

ALPHABET = ["de", "The", "cloud", "AI", "é", "Été", "x_1", "a", "don't", "rose", "e", "the", "42", "İst", "ŸA", "naïve"]
GLUE = [" ", "  ", "\n", "\n\n", ". ", "! ", "? ", ", ", "\t", " ", "\n- ", "\n* ", "\n## ", "\n# ", " [2] ", " *", "`"]


def texts(n=150, seed=7):
    rng = random.Random(seed)
    out = ["", " ", "\n", "one", "# "]
    for _ in range(n):
        out.append("".join(rng.choice(ALPHABET) + rng.choice(GLUE) for _ in range(rng.randint(0, 400))))
    return out


def run(spark, expr, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def py_tokens(t, n, stop):
    return [x.lower() for x in re.findall(r"[A-Za-zÀ-ÿ0-9_]+", t) if len(x) >= n and x.lower() not in stop]


def test_tokens(spark):
    vs = texts()
    for n, stop in ((3, fixed.BUILD_STOPWORDS), (2, fixed.QUERY_STOPWORDS)):
        assert run(spark, T.tokens(F.col("t"), n, stop), vs) == [py_tokens(v, n, set(stop)) for v in vs]


def test_strip_words_lines(spark):
    vs = texts() + [" a b ", "x\r\ny\x0bz q"]
    assert run(spark, T.strip(F.col("t")), vs) == [v.strip() for v in vs]
    assert run(spark, T.words(F.col("t")), vs) == [v.split() for v in vs]
    assert run(spark, T.lines(F.col("t")), vs) == [v.splitlines() for v in vs]


def test_words_sentences_paragraphs(spark):
    vs = texts()
    bare = run(spark, T.md_strip(F.col("t")), vs)
    assert run(spark, T.word_count(F.col("t")), vs) == [len(re.findall(r"\w+", b)) for b in bare]
    assert run(spark, T.sentences(F.col("t")), vs) == [
        [p.strip() for p in re.split(r"[.!?](?:\s|$)", b) if p.strip()] for b in bare
    ]
    assert run(spark, T.paragraphs(F.col("t")), vs) == [
        [p.strip() for p in re.split(r"\n\s*\n", b) if p.strip()] for b in bare
    ]
    assert run(spark, T.speech_words(F.col("t")), vs) == [re.findall(r"\b[\w']+\b", v) for v in vs]


def test_syllables(spark):
    vs = ["rose", "the", "e", "queue", "sky", "table", "", "Idea"]

    def count(w):
        n = len(re.findall("[aeiouy]+", w.lower()))
        return max(1, n - (w.lower().endswith("e") and n > 1))

    assert run(spark, T.syllables(F.col("t")), vs) == [count(v) for v in vs]


def test_chunks(spark):
    for n in (0, 1, 259, 260, 261, 299, 300, 480, 519, 520, 700):
        words = [f"w{i}" for i in range(n)]
        got = run(spark, V.chunk_words(F.col("t")), [" ".join(words)])[0]
        want = []
        if n and n <= 260:
            want = [words]
        elif n:
            for s in range(0, n, 220):
                if want and n - s < 40:
                    break
                want.append(words[s : s + 260])
        assert got == [" ".join(w) for w in want], n


def test_top_terms(spark):
    vs = texts(60, 3) + [" ".join(f"t{i}" * (1 + i % 3) for i in range(300))]
    got = run(spark, V.top_terms(T.tokens(F.col("t"), 3, fixed.BUILD_STOPWORDS), 20), vs)
    for v, terms in zip(vs, got):
        counts = Counter(py_tokens(v, 3, set(fixed.BUILD_STOPWORDS)))
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        want = counts.most_common(20)
        assert [t.term for t in terms] == [t for t, _ in want]
        assert all(abs(t.weight - n / norm) < 1e-6 for t, (_, n) in zip(terms, want))


def test_sections_and_runs(spark):
    vs = texts()
    for v, got in zip(vs, run(spark, C.h2_sections(F.col("t")), vs)):
        at = list(re.finditer(r"^##\s+(.+)$", v, re.M))
        ends = [m.start() for m in at[1:]] + [len(v)]
        want = [(m.group(1).strip(), v[m.start() : e].strip(), v[: m.start()].count("\n") + 1) for m, e in zip(at, ends)]
        assert [(s.title, s.text, s.line_num) for s in got] == want
    for v, got in zip(vs, run(spark, K.bullet_runs(F.col("t")), vs)):
        marks = "".join("b" if re.match(r"\s*[-*+]\s+\S", ln) else "." for ln in v.splitlines())
        assert got == [len(m) for m in re.findall("b+", marks)]


def test_summary(spark):
    vs = ["a" * 420, "a" * 421, " b \n c ", "d" * 418 + "  " + "e" * 9]
    got = run(spark, C.summary(F.col("t")), vs)
    assert got[0] == "a" * 420 and got[1] == "a" * 419 + "..." and got[2] == "b c"
    assert got[3] == "d" * 418 + "..."


def test_occurrences_do_not_overlap(spark):
    assert run(spark, T.occurrences(F.col("t"), F.lit("aa")), ["aaaaa", "", "baab"]) == [2, 0, 1]


def test_terms_of_a_text_are_those_of_its_tokens(spark):
    vs = [*texts(60, 3), None, "", "the the", "abKcd Plain PLAIN İstanbul ẞeta ÀÉÎ x×y÷z \U0001d400bcd ß_9", "퟿�é" * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, t string")
    stop = fixed.BUILD_STOPWORDS
    both = df.select("i", V.text_terms(F.col("t"), 3, 20, stop).alias("a"), V.top_terms(T.tokens(F.col("t"), 3, stop), 20).alias("b"))
    rows = both.collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) > 200
    nodes = spark.createDataFrame([("c", 0, 0, "0001", "A", "Cat cat dog", ["Tag"])], "corpus string, root_ord int, node_ord int, node_id string, title string, text string, tags array<string>")
    for name in ("article_title", "lang", "line_num", "own_url", "source_url", "published"):
        nodes = nodes.withColumn(name, F.lit(None).cast("string"))
    built = C.chunk_records(nodes)
    # texts go to the counting function, not lists of tokens found in the row before
    assert "regexp_extract_all" not in built._jdf.queryExecution().optimizedPlan().toString()
    assert [(e.term, round(e.weight, 3)) for e in built.first().terms] == [("cat", 0.816), ("dog", 0.408), ("tag", 0.408)]
