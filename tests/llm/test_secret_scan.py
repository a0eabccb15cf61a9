from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from galley.llm import secret_scan as S

PATTERNS = (
    re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
)


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) if kind == 0 else len(m[0])) >= (8, 16, 32)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def noise(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    b64 = S.ALPHABETS["base64"]
    texts = [
        None, "", "token: secret: abcdefghij", 'PassWord" = \'abc.def-12', "api_key=short", "apikey : LONGENOUGH1 api-key=nothing8",
        "é€😀 secret=ÄÄ token=" + noise(rnd, b64, 30), "AKIAABC AKIA" + noise(rnd, "ABCDEF12", 12) + "x", "AKIA" * 6,
        "ffff " + "a" * 32 + " " + noise(rnd, "0123456789abcdef", 40) + "g", "password=token=abcdefghijk", "ſecret=abcdefghijkl",
        "x\ny password\n=abcdefghijkl", "secret='" + "q" * 9 + "'secret=\"" + "r" * 9,
        " ".join("k" + str(i) + " token=" + noise(rnd, b64[:62], 12) for i in range(700)), "word " * 100_000 + "secret=abcdefgh1",
    ]
    texts += ["key " + noise(rnd, b64, 40) + " end" for _ in range(40)] + ["words " + "internationalisation" * 3 for _ in range(30)]
    return [*enumerate(texts), (3, texts[3]), (None, texts[3])]


@pytest.fixture(scope="module")
def scanned(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], "doc_id bigint, text string, spans int, _found string, _ends string")
    return S.with_spans(docs.repartition(3)).cache()


def test_base_spans_equal_brute_force(scanned, rows):
    text = S.F.coalesce("text", S.F.lit(""))
    got = scanned.select("doc_id", "spans", S.masked(text, S.F.col("spans")).alias("masked")).collect()
    assert len(got) == len(rows)
    want = {i: base_spans(t) for i, t in rows}
    for r in got:
        assert [tuple(s) for s in r.spans if s["kind"] < 3] == want[r.doc_id]
        assert [tuple(s) for s in r.spans] == sorted(map(tuple, r.spans))


def test_masking_equals_brute_force(scanned, rows):
    texts = dict(rows)
    text = S.F.coalesce("text", S.F.lit(""))
    for r in scanned.select("doc_id", "spans", S.masked(text, S.F.col("spans")).alias("masked")).collect():
        out, at = [], 0
        for s in r.spans:
            if s["start"] > at or (s["start"] == at == 0 and not out):
                out += [(texts[r.doc_id] or "")[at : s["start"]], S.MASK]
            at = max(at, s["end"])
        assert r.masked == "".join(out) + (texts[r.doc_id] or "")[at:]


def test_random_strings_are_found_and_words_are_not(scanned):
    rows = scanned.collect()
    random_of = lambda r: [s for s in r.spans if s["kind"] == 3]
    keys = [r for r in rows if r.text and r.text.startswith("key ")]
    words = [r for r in rows if r.text and r.text.startswith("words ")]
    assert sum(bool(random_of(r)) for r in keys) > 0.75 * len(keys)
    assert not any(random_of(r) for r in words)


def p_by_hand(token, alphabet):
    n, k = len(token), len(alphabet)
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    df = k - 1
    chi = k / n * sum(token.count(c) ** 2 for c in alphabet) - n
    spread = 2 / (9 * df)
    p1 = tail(((chi / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    values = [alphabet.index(c) + 1 for c in token]
    high = [v > k / 2 for v in values]
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p2 = tail((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(var)) if var > 0 else 0.0
    m = sum(values) / n
    total = sum((v - m) ** 2 for v in values)
    p3 = tail((sum((a - m) * (b - m) for a, b in zip(values, values[1:])) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return 1 - (1 - min(p1, p2, p3)) ** 3


def test_battery_equals_formulas(spark):
    rnd = random.Random(8)
    tokens = []
    for name, alphabet in S.ALPHABETS.items():
        tokens += [noise(rnd, alphabet, rnd.randint(20, 90)) for _ in range(6)] + [alphabet * 2, alphabet[:2] * 20]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    encoded = df.withColumn("e", S._encoding(S.F.col("t"))).withColumn("b", S.battery(S.F.col("t"), S.F.col("e")))
    for r in encoded.select("t", "e", S.p_value(S.F.col("b")).alias("p")).collect():
        smallest = next(n for n, a in S.ALPHABETS.items() if set(r.t) <= set(a))
        assert r.e == smallest
        assert r.p == pytest.approx(p_by_hand(r.t, S.ALPHABETS[r.e]), abs=2e-6)


def test_cut_controls_false_discoveries():
    uniform = [10] * S.BINS
    assert S.lowest_cut(uniform, 0.1) == 1
    words = [5000] + [200] * 10 + [0] * (S.BINS - 11)
    assert S.lowest_cut(words, 0.1) is None
    mixed = [a + b for a, b in zip(uniform, words)]
    cut = S.lowest_cut(mixed, 0.1)
    assert cut >= 10 and sum(words[cut:]) <= 0.2 * sum(mixed[cut:])


def test_running_sum(spark):
    df = spark.range(300).select("id", S.F.transform(S.F.sequence(S.F.lit(0), S.F.col("id").cast("int")), lambda x: x % 7).alias("a"))
    for r in df.select("a", S.running_sum(S.F.col("a")).alias("s"), S.running_sum(S.F.slice("a", 1, 0)).alias("none")).collect():
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))] and r.none == []


def test_query_columns_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "token=12345678"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in S.op9_query(spark, str(tmp_path)).collect()}
    assert (got[1].n_assign, got[1].spans) == (1, "assign:0:14")
    assert got[1].base_sha256 == hashlib.sha256(b"assign:0:14").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert S.with_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stage_masks_and_counts(spark):
    docs = spark.createDataFrame([(1, "a token=12345678 b", "en", "s", 18), (2, None, None, None, 5), (3, "clean", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in S.secrets_stage(spark, docs, "").collect()}
    assert got[1].text == "a [SECRET] b" and got[1].n_chars == 12
    assert tuple(got[2]) == (2, None, None, None, 5) and tuple(got[3]) == (3, "clean", "en", "s", 5)


def test_long_tokens_and_many_matches_stay_linear(spark):
    import time

    rnd = random.Random(9)
    blob = noise(rnd, S.ALPHABETS["base64"], 200_000)
    many = " ".join(f"token=abcdefgh{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, blob), (2, many)], "doc_id bigint, text string").coalesce(2)
    start = time.time()
    got = {r.doc_id: r for r in S.with_spans(docs).collect()}
    assert time.time() - start < 60
    assert [tuple(s) for s in got[2].spans if s["kind"] < 3] == base_spans(many)
    assert sum(s["end"] - s["start"] for s in got[1].spans) >= 0


def test_very_long_runs_and_tokens_end_without_overflow(spark):
    rnd = random.Random(9)
    token = "".join(rnd.choices(S.ALPHABETS["base64"], k=4_000_000))
    rows = [(1, "a" * 47_000), (2, "A" * 300_000), (3, "key " + token + " end"), (4, "f" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.spans for r in S.with_spans(docs).collect()}
    assert got[1][0]["kind"] == 2 and got[1][0]["end"] == 47_000 and got[2] == []
    assert [tuple(s) for s in got[3] if s["kind"] == 3 and s["end"] - s["start"] > 3_900_000] == [(4, 3, 4_000_004)]
