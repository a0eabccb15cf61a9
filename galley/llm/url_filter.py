"""URL filter: host rules first, then naive Bayes over segmented names.

Names are the runs of letters of hosts and paths (a run of digits counts as
``0``). A name like ``cheappills`` is split into words by a Viterbi search
over a unigram model: word counts of all pages, with a floor for the seed
words. A multinomial naive Bayes model then scores the words of host and path.
Its labels are weak: a URL whose host has a seed word is an example to block,
every other one an example to allow; counts cover all distinct URLs, so words
that go with seed words get weight too. Weights are whole millionths, so sums
do not depend on their order.

Everything is keyed by distinct names and distinct (host, path) pairs, so a
very common host or name is segmented and scored once. Only totals (three
numbers) reach the driver.

Defined results: a null URL, or one without ``://``, has an empty host and
path; such and all other URLs without a word get the verdict of the class
sizes alone; names and words of any length are segmented alike, in time linear
in the length; repeated rows get the same answer; a null page id is kept; in an
empty table nothing is fitted; columns other than id, URL and html are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import cut_lineage

#: Rules (verdict, host, path) the query applies.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words whose presence in a host makes it an example to block.
SEEDS = (
    "ads", "adult", "bet", "bets", "bingo", "casino", "cheap", "escort", "gambling", "jackpot", "lottery", "nude",
    "payday", "phishing", "pills", "poker", "porn", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
)
#: Least share of all words a seed word is given.
SEED_SHARE = 1e-5
#: Words of the unigram model: letters, and times they must be seen.
SHORTEST_WORD, SEEN = 2, 2
#: Letters of a word by which names are looked up; longer words are compared in whole where these agree.
KEY = 24
#: Letters of a name looked up at once, and of a name that is its own key.
STRETCH, SHORT_NAME = 1000, 64
#: Weight of the prior of each class, in words: words are expected as often as they are overall.
PRIOR_WORDS = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MILLION = 1_000_000


def lowered(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def names(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), F.lit("0")).otherwise(x))


def unigrams(pages: DataFrame, text_col: str = "html") -> tuple[DataFrame, int]:
    """(word, weight) with weight the logarithm of its share in millionths; and the number of words."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, r"\P{L}+")).alias("word")).where(F.length("word") >= SHORTEST_WORD)
    counts = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    seeds = counts.sparkSession.createDataFrame([(w,) for w in SEEDS], "word string").withColumn("seed", F.lit(SEED_SHARE))
    share = F.greatest(F.coalesce(F.col("n") / F.lit(float(total)), F.lit(0.0)), F.coalesce("seed", F.lit(0.0)))
    return counts.join(seeds, "word", "full").select("word", F.log(share).alias("weight")), total


def best_split(name: str, known: list[tuple[int, int, float]], total: int) -> list[str]:
    """The most likely words of ``name``; ``known`` are (start, length, log share) of known words in it.

    An unknown stretch of n letters has the share 10 / (total * 10^n). Of equally
    likely splits the one whose last word is longest is taken.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, weight in known:
        ending.setdefault(start + length, []).append((start, weight))
    unknown, letter = math.log(10.0 / total), math.log(10.0)
    best = [0.0] + [-math.inf] * len(name)
    before = [0] * (len(name) + 1)
    open_from, opened = 0, 0.0  # where an unknown stretch starts best, and its likelihood but for its end
    for end in range(1, len(name) + 1):
        for start, weight in [*sorted(ending.get(end, [])), (open_from, opened - best[open_from] + unknown - letter * end)]:
            if best[start] + weight > best[end]:
                best[end], before[end] = best[start] + weight, start
        if best[end] + letter * end > opened:
            open_from, opened = end, best[end] + letter * end
    words, at = [], len(name)
    while at:
        words.append(name[before[at] : at])
        at = before[at]
    return words[::-1]


def segmented(distinct_names: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names."""
    # a digest stands for a long name, so its pieces do not carry it; names are letters or "0", so none looks like it
    named = distinct_names.withColumn(
        "name_key", F.when(F.length("name") <= SHORT_NAME, F.col("name")).otherwise(F.concat(F.lit("0:"), F.sha2("name", 256)))
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.length("name") - 1, F.lit(STRETCH)),
        lambda at: F.struct(at.alias("at"), F.substring(F.col("name"), at + 1, F.lit(STRETCH + KEY - 1)).alias("part")),
    )
    parts = named.select("name_key", F.explode(cut).alias("s")).select("name_key", "s.*")
    starts = parts.select(
        "name_key", "at", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("part")))).alias("start")
    )
    lengths = F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("part") - F.col("start") + 1))
    pieces = starts.select("name_key", "at", "part", "start", F.explode(lengths).alias("length")).where(
        F.col("length") >= SHORTEST_WORD
    ).select(
        "name_key", (F.col("at") + F.col("start") - 1).alias("start"), F.substring("part", F.col("start"), F.col("length")).alias("key")
    )
    by_key = lexicon.withColumns({"key": F.substring("word", 1, KEY), "length": F.length("word")})
    longer = F.when(F.col("length") > KEY, F.col("word"))
    # at most KEY entries per letter, and the longer words that start alike
    known = pieces.join(by_key, "key").groupBy("name_key").agg(
        F.collect_list(F.struct("start", "length", "weight", longer.alias("longer"))).alias("known")
    )
    rows = named.join(known, "name_key", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [
                    (p["start"], p["length"], p["weight"]) for p in parts or []
                    if p["longer"] is None or name.startswith(p["longer"], p["start"])
                ]
                out.append([name] if name == "0" else best_split(name, found, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return rows.select("name", "known").mapInArrow(split, "name string, words array<string>")


def word_weights(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(word, score) in millionths of log odds for "block", and the prior, from (host, path, words, in_host)."""
    seeds = F.array(*map(F.lit, SEEDS))
    by_url = tokens.groupBy("host", "path").agg(
        F.max(F.col("in_host") & F.arrays_overlap("words", seeds)).alias("block")
    )
    sizes = by_url.agg(F.coalesce(F.sum(F.col("block").cast("bigint")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    counted = (
        tokens.join(by_url, ["host", "path"])
        .select(F.explode("words").alias("word"), F.col("block").cast("bigint").alias("block"))
        .groupBy("word")
        .agg(F.sum("block").alias("b"), F.count(F.lit(1)).alias("n"))
    )
    counted = cut_lineage(counted)
    t = counted.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    expected = F.col("n") * PRIOR_WORDS / F.lit(float(max(t["n"], 1)))
    odds = (
        F.log(F.col("b") + expected) - F.log(F.col("n") - F.col("b") + expected)
        - F.lit(math.log(t["b"] + PRIOR_WORDS) - math.log(t["n"] - t["b"] + PRIOR_WORDS))
    )
    prior = math.log((sizes["b"] + 1) / (sizes["n"] - sizes["b"] + 1))
    return counted.select("word", F.round(odds * MILLION).cast("bigint").alias("score")), round(prior * MILLION)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) of every row; score is log odds in millionths."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    places = parsed.select("host", "path").distinct()
    tagged = lambda c, flag: F.transform(names(F.col(c)), lambda x: F.struct(x.alias("name"), F.lit(flag).alias("in_host")))
    named = places.select("host", "path", F.explode(F.concat(tagged("host", True), tagged("path", False))).alias("x")).select(
        "host", "path", "x.*"
    )
    named = cut_lineage(named)
    lexicon, total = unigrams(pages, text_col)
    words = cut_lineage(segmented(named.select("name").distinct(), lexicon, total))
    weights, prior = word_weights(named.join(words, "name"))
    name_score = words.select("name", F.explode("words").alias("word")).join(weights, "word").groupBy("name").agg(F.sum("score").alias("score"))
    scored = (
        named.join(name_score, "name")
        .groupBy("host", "path")
        .agg(F.sum("score").alias("score"))
    )
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    score = F.coalesce("score", F.lit(0)) + F.lit(prior)
    return parsed.join(scored, ["host", "path"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(score > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score.cast("bigint").alias("score"),
    )


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
