"""The built corpora, written once per session and read by every search.

Building and searching are separate jobs: nodes and chunks are stored by
corpus, so a search reads only the routed corpora and the columns it scores,
and in buckets of whole articles, so the scores of a node or chunk are complete in
the task that reads it. The folder is the shared one of the cluster.

A bucket is what one task sorts, writes and scores, so there are as many as the
articles ask for, and a task stays as small when the corpora grow. Raw articles
are dealt into the buckets and parsed there: a text moves once and in one piece,
and the parsing is as even as the buckets, whatever the splits of the input.
Chunks lie in the bucket of their node, so they are written where the node is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.operators import corpus as C
from galley.plans import inputs
from galley.sources.files import scratch

_BUILT: dict[tuple[str, str, str], str] = {}

#: Articles in a bucket, about; and the most buckets Spark takes unless told otherwise.
BUCKET_ARTICLES, MOST_BUCKETS = 2_000, 100_000
ARTICLE = "root_ord"
#: A scan task per bucket, though no join or grouping asks for it.
BY_BUCKET = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def buckets(spark: SparkSession, articles: int) -> int:
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(least, -(-articles // BUCKET_ARTICLES)))


def _stored(spark: SparkSession, sf: str, name: str, build: Callable[[int], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        n = buckets(spark, inputs.table(spark, sf, "documents").count())
        path = scratch(spark, name)
        table = f"galley_{name}_{path[-32:]}"
        rows = build(n)
        auto = spark.conf.get(BY_BUCKET)
        spark.conf.set(BY_BUCKET, "false")
        try:
            (
                rows.write.partitionBy("corpus").bucketBy(n, ARTICLE)
                .option("path", path).option("compression", "zstd").saveAsTable(table)
            )
        finally:
            spark.conf.set(BY_BUCKET, auto)
        _BUILT[key] = table
    return spark.table(_BUILT[key])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of all document corpora."""

    def build(n: int) -> DataFrame:
        dealt = C.numbered(inputs.articles(spark, sf, even=False)).repartition(n, ARTICLE)
        return C.flatten(C.article_trees(dealt))

    return _stored(spark, sf, "nodes", build)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all nodes with their term vectors, each in the bucket its node is read from."""
    return _stored(spark, sf, "chunks", lambda n: C.chunk_records(nodes(spark, sf)))
