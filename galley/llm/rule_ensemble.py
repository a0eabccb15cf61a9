"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of a text are column expressions. Boosted and bagged trees are
grown on labelled rows; each path from a root to a node is a rule, a
conjunction of bounds on statistics. A logistic model with a lasso penalty
picks few rules and weighs them, and the rules it keeps are compiled to one
column expression, so scoring is a scan without Python and without a shuffle.

Only the fit is bounded: at most ``max_rows`` labelled rows, those of the
smallest hashes of their ids, are read for it. Labels, language, source and id
are never statistics.

Defined results: a null or empty text has zero statistics and gets a score
like any other; labels other than 0 and 1 and null ids are not learned from; of
several labels of one id the smallest counts; if labels of both kinds are not
at hand, all texts get the smoothed share of label 1 (0.5 without any label).
Columns of the documents pass through; columns that clash with those of the
model are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import cut_lineage

#: Labelled rows a fit reads at most.
MAX_ROWS = 20_000
#: Labelled rows that reach the cut to the most a fit reads, as a multiple of these.
CUT_FIRST = 1.5
THRESHOLD = 0.3
FOREST = {"numTrees": 12, "maxDepth": 3, "subsamplingRate": 0.7, "minInstancesPerNode": 5, "seed": 7}
BOOSTED = {"maxIter": 8, "maxDepth": 2, "stepSize": 0.3, "minInstancesPerNode": 5, "seed": 7}
#: Lasso penalty of the rule weights.
PENALTY = 0.002
MAX_ITERATIONS = 60


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts, all computed in the JVM."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n_words = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    low = F.array_distinct(F.transform(words, F.lower))
    return {
        "chars": chars.cast("double"),
        "words": n_words.cast("double"),
        "word_length": share(chars, n_words),
        "upper": share(count(r"\p{Lu}"), chars),
        "digits": share(count(r"[0-9]"), chars),
        "symbols": share(count(r"[#$%&*@~^|<>{}\[\]\\_=+]"), chars),
        "marks": share(count(r"[!?]"), n_words),
        "stops": share(count(r"[.,;:]"), n_words),
        "blanks": share(count(r"\s"), chars),
        "distinct_words": share(F.size(low), n_words),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": share(chars, F.size(lines)),
        "hard_words": share(count(r"\S{25,}"), n_words),
        "short_words": share(count(r"(?<!\S)\S{1,3}(?!\S)"), n_words),
    }


#: Order of the statistics in feature vectors.
NAMES = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "marks", "stops", "blanks", "distinct_words",
    "lines", "distinct_lines", "line_length", "hard_words", "short_words",
)


@dataclass(frozen=True)
class Bound:
    name: str
    at_most: bool
    value: float

    def column(self, stats: Column) -> Column:
        return stats[self.name] <= self.value if self.at_most else stats[self.name] > self.value


@dataclass
class Model:
    """Weighted rules; ``rules`` may be empty, then the score is constant."""

    intercept: float
    rules: list[tuple[float, tuple[Bound, ...]]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        parts = [F.when(conjunction(rule, stats), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.rules]
        total = reduce(lambda a, b: a + b, parts, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def conjunction(rule: tuple[Bound, ...], stats: Column) -> Column:
    return reduce(lambda a, b: a & b, [b.column(stats) for b in rule])


def tree_rules(debug: str) -> list[tuple[Bound, ...]]:
    """Paths to every node but the roots, from the text form of Spark's trees."""
    rules: dict[tuple[Bound, ...], None] = {}
    path: list[Bound] = []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r" *Tree \d+", line):
            path, base = [], None
        elif found:
            depth = len(found[1])
            base = depth if base is None else base
            del path[depth - base :]
            path.append(Bound(NAMES[int(found[2])], found[3] == "<=", float(found[4])))
            rules[_merged(path)] = None
    return list(rules)


def _merged(path: list[Bound]) -> tuple[Bound, ...]:
    """The tightest bound per statistic and direction."""
    best: dict[tuple[str, bool], Bound] = {}
    for b in path:
        old = best.get((b.name, b.at_most))
        if old is None or (b.value < old.value) == b.at_most:
            best[b.name, b.at_most] = b
    return tuple(best[k] for k in sorted(best))


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    return docs.withColumn(out, F.struct(*[c.alias(n) for n, c in statistics(F.col(text_col)).items()]))


def is_held_out(doc_id: Column) -> Column:
    """Rows no fit may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(features, label) of at most ``max_rows`` labelled rows that are not held out."""
    usable = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min(target).cast("double").alias("label"))
    )
    # ids of small hash in such a share that enough of them are left, so tasks send few rows to the cut
    share = CUT_FIRST * max_rows / max(usable.count(), 1)
    near = usable if share >= 1 else usable.where(F.xxhash64("doc_id") < int(share * 2**64) - 2**63)
    picked = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers: small enough to send to every task
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return (
        with_statistics(rows)
        .orderBy(F.xxhash64("doc_id", "text"))
        .limit(max_rows)
        .select(array_to_vector(F.array(*[F.col("_stats")[n] for n in NAMES])).alias("features"), "label", "_stats")
    )


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    rows = cut_lineage(training_rows(docs, labels, target, max_rows).coalesce(4))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = seen.get(0.0, 0), seen.get(1.0, 0)
    base = Model(math.log((n1 + 1) / (n0 + 1)))
    if not (n0 and n1):
        return base
    forest = RandomForestClassifier(**FOREST).fit(rows)
    boosted = GBTClassifier(**BOOSTED).fit(rows)
    rules = list(dict.fromkeys(tree_rules(forest.toDebugString) + tree_rules(boosted.toDebugString)))
    if not rules:
        return base
    fired = F.array(*[conjunction(rule, F.col("_stats")).cast("double") for rule in rules])
    marked = cut_lineage(rows.select(array_to_vector(fired).alias("features"), "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=MAX_ITERATIONS, standardization=True)
    fitted = lasso.fit(marked)
    weights = fitted.coefficients.toArray()
    kept = [(float(w), rule) for w, rule in zip(weights, rules) if abs(w) > 1e-6]
    return Model(float(fitted.intercept), kept)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    scored = with_statistics(docs, text_col).withColumn("score", model.score(F.col("_stats")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_stats")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents the classifier accepts, with their own columns."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).where("predicted = 1").select(*docs.columns)
