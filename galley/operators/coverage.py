"""Questions about a corpus as a whole: aging, gaps, filters, examples, search.

Articles are rows with corpus, lang, slug, title, tags, author and published.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators.scale import join_skewed, top_rows


def aging_scan(articles: DataFrame, as_of: dt.date, threshold_days: int = 365) -> DataFrame:
    """Articles older than the threshold, with age and the first author."""
    day = F.to_date("published")
    age = F.datediff(F.lit(as_of), day)
    return articles.where(age > threshold_days).select(
        "corpus", "slug", "title", day.alias("published"), age.alias("age_days"),
        F.get("author", F.lit(0)).alias("original_author"),
    )


def gap_report(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles per topic, zero where a topic is not covered.

    Tags are counted before the join, so a tag on most articles is one row.
    """
    counts = (
        articles.select("slug", F.explode_outer(F.array_distinct(F.transform("tags", F.lower))).alias("topic"))
        .where(F.col("topic").isNotNull())
        .groupBy("topic").agg(F.count(F.lit(1)).alias("articles"))
    )
    asked = topics.select(F.lower("topic").alias("topic")).distinct()
    return asked.join(counts, "topic", "left").select(
        "topic", F.coalesce("articles", F.lit(0)).alias("articles")
    )


def corpus_filter(
    articles: DataFrame, tag: str | None = None, start: dt.date | None = None, end: dt.date | None = None,
    author: str | None = None,
) -> DataFrame:
    """Articles with the tag, published in the range (ends included), by the author."""
    rows = articles
    if tag is not None:
        rows = rows.where(F.array_contains(F.transform("tags", F.lower), tag.lower()))
    if start is not None:
        rows = rows.where(F.to_date("published") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.to_date("published") <= F.lit(end))
    if author is not None:
        rows = rows.where(F.array_contains("author", author))
    return rows


def corpus_examples(articles: DataFrame, topics: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` articles per topic."""
    tagged = articles.select(
        "corpus", "slug", "title", "published",
        F.explode_outer(F.array_distinct(F.transform("tags", F.lower))).alias("topic"),
    )
    asked = topics.select(F.lower("topic").alias("topic")).distinct()
    hits = join_skewed(tagged, asked, ["topic"], ["slug"])
    return top_rows(hits, ["topic"], [F.desc("published"), F.col("slug").asc()], n, "rank")
