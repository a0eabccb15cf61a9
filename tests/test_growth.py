"""What must not grow faster than the input: buckets of the stored corpora, text read per summary and check."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import terms as V
from galley.functions import text as T
from galley.operators import corpus as C
from galley.operators import scale
from galley.plans import assets


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(i, f"alpha beta word{i} " * 40 + "\n\ngamma " + "delta epsilon " * (i % 5 * 60), ["en", "fr", "de", "es"][i % 4], f"s{i % 3}") for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_buckets_grow_with_the_articles(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert assets.buckets(spark, 10) == least
    assert assets.buckets(spark, 3_000_000) == 1_500
    assert assets.buckets(spark, 10**12) == assets.MOST_BUCKETS


def test_chunks_are_written_where_their_nodes_are_read(spark, documents, monkeypatch):
    monkeypatch.setattr(assets, "BUCKET_ARTICLES", 4)
    plans = []
    records = C.chunk_records
    monkeypatch.setattr(C, "chunk_records", lambda nodes: plans.append(records(nodes)) or plans[0])
    auto = spark.conf.get(assets.BY_BUCKET)
    chunks = assets.chunks(spark, documents)
    assert spark.conf.get(assets.BY_BUCKET) == auto
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    # a bucket of a corpus is one file, written by one task; the same chunks as when nothing is stored
    files = Counter(f.rsplit("/", 1)[0] + f.rsplit("_", 1)[1].split(".")[0] for f in chunks.inputFiles())
    assert set(files.values()) == {1} and len({f.rsplit("_", 1)[1] for f in chunks.inputFiles()}) > 8
    plain = records(C.flatten(C.article_trees(assets.inputs.articles(spark, documents))))
    cols = ["corpus", "root_ord", "node_ord", "chunk_index", "content", F.to_json("terms").alias("terms")]
    assert Counter(chunks.select(*cols).collect()) == Counter(plain.select(*cols).collect())
    assert chunks.count() > 64


def test_articles_are_parsed_in_buckets_also_when_one_split_has_them_all(spark, documents, tmp_path, monkeypatch):
    sf = str(tmp_path / "one")
    spark.read.parquet(f"{documents}/documents.parquet").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    seen, trees = [], C.article_trees
    monkeypatch.setattr(C, "article_trees", lambda articles: seen.append(articles) or trees(articles))
    for key, value in (("maxPartitionBytes", "1k"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        # one row group, so all splits but one are empty
        assert spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        nodes = assets.nodes(spark, sf)
        in_a_task = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert sum(in_a_task) == 64 and max(in_a_task) <= 32
    cols = sorted(nodes.columns)
    plain = C.flatten(trees(assets.inputs.articles(spark, sf)))
    rows = lambda df: Counter(str(r) for r in df.select(cols).collect())
    assert rows(nodes) == rows(plain)
    # all nodes of an article lie in one bucket
    files = nodes.select("corpus", "root_ord", F.input_file_name().alias("f")).distinct()
    assert files.count() == files.select("corpus", "root_ord").distinct().count() == 64


def test_ranges_are_found_in_two_steps(spark):
    for n in (1, 15, 16, 17, 255):
        bounds = [f"s{i:04d}" for i in range(0, 3 * n, 3)]
        keys = [f"s{i:04d}" for i in range(3 * n + 3)] + ["", "zz"]
        got = spark.createDataFrame([(k,) for k in [*keys, None]], "k string").select("k", scale._range_of(F.col("k"), bounds, "string").alias("n"))
        assert {r.k: r.n for r in got.collect()} == {k: bisect_right(bounds, k) for k in keys} | {None: 0}


def test_lines_are_dropped_as_if_one_kind_went_after_the_other(spark):
    lines = ["![a](b) x", "  <p>y", "<IFRAME src>", "<ab", "13/01/2010 • x", "13/01/2010", "•", "", " ", "## H", "word", "# T", "![a]"]
    texts = ["\n".join(lines[(i * j + i // 5) % len(lines)] for j in range(1, 9)) for i in range(400)]

    def plain(t):
        for line in (r"^\s*!\[.*?\]\(.*?\).*$", r"(?i)^\s*<(iframe|video|source|track|p|a)\b.*$", r"^\d{1,2}/\d{1,2}/\d{4}\s*•.*$"):
            t = re.sub(line, "", t, flags=re.M)
        t = re.sub(r"\n{3,}", "\n\n", t).lstrip()
        return (re.sub(r"\A#\s+[^\n]+\n+", "", t) if t.startswith("# ") else t).strip()

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.clean_body(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [plain(r.t) for r in got]


def test_front_matter_ends_at_its_first_closing_mark(spark):
    raws = ['---\ntitle: "a"\n---\nb\n---\nc', "---\n---\nx\n---\ny", "---\n\n---\nz", "no\n---\nmarks", "---\nopen", "", None]
    got = spark.createDataFrame([(i, r, "slug") for i, r in enumerate(raws)], "i int, raw string, slug string").select("i", *[F.col(c) for c in ("raw", "slug")])
    rows = C.frontmatter(got).orderBy("i").collect()
    want = [re.match(r"(?s)---\n(.*?)\n---\n", r or "") for r in raws]
    assert [r.body for r in rows] == [raw if m is None else raw[m.end():] for raw, m in zip(raws, want)]
    assert rows[0].title == "a" and rows[3].title == "slug"


def test_summary_of_long_and_spaced_texts(spark):
    texts = ["", " a  b ", "x" * 419, "x" * 420, "x" * 421, " \n " * 3000 + "late " * 300, "a \t" * 900, "word " * 83 + "tail" + " " * 2000, "word " * 84 + " " * 3000 + "end", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", C.summary(F.col("t")).alias("s")).orderBy("i").collect()]

    def plain(t):
        s = " ".join((t or "").split())
        return s if len(s) <= fixed.SUMMARY_CHARS else s[: fixed.SUMMARY_CHARS - 1].rstrip() + "..."

    assert got == [plain(t) for t in texts]


def test_stop_words_are_dropped_per_batch_and_do_not_count(spark):
    got = V._counted(pa.array([["the", "cat", "the", "cat", "dog"], [], None, ["the"]]), 96, pa.array(["the"])).to_pylist()
    assert [[(e["term"], round(e["weight"], 6)) for e in r] for r in got] == [[("cat", 0.894427), ("dog", 0.447214)], [], [], []]


def test_strange_capitals_still_separate_tokens(spark):
    rows = spark.createDataFrame([("abKcd Plain TEXT", ), ("no such thing", )], "t string")
    assert [r.x for r in rows.select(T.tokens(F.col("t"), 2, ()).alias("x")).collect()] == [["ab", "cd", "plain", "text"], ["no", "such", "thing"]]


def test_syllables_of_a_text_are_those_of_its_words(spark):
    words = ["the", "tree", "rhythm", "xyz", "hmm", "make", "Emile", "e", "ee", "queue", "été", "OIE", "a'e", "İstanbule", "naïve", "1e", "bcd_e", "aeiou", "made", "ΣΑΣ"]
    df = spark.createDataFrame([(words,), ([],)], "w array<string>")
    each = F.aggregate("w", F.lit(0), lambda acc, w: acc + T.syllables(w))
    rows = df.select(T.syllables_of(F.col("w")).alias("whole"), each.alias("each")).collect()
    assert [r.whole for r in rows] == [r.each for r in rows] and rows[0].whole > 20
    one = spark.createDataFrame([([w],) for w in words], "w array<string>")
    assert all(r.whole == r.each for r in one.select(T.syllables_of(F.col("w")).alias("whole"), each.alias("each")).collect())
