"""Queries over trees of any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import trees as D
from galley.plans import inputs
from galley.plans.registry import query, view
from galley.sources import files

#: Documents as nodes: chains and bushes of up to a hundred levels; some without title, link or, one in 97, parent.
NODES = {
    "corpus": "'tree_' || cast(floor(doc_id / 100) % 3 as int)",
    "node_id": "cast(doc_id as string)",
    "parent_id": (
        "case when doc_id % 100 = 0 then null when doc_id % 97 = 5 then 'none'"
        " when floor(doc_id / 100) % 2 = 0 then cast(doc_id - 1 as string) else cast(doc_id - 1 - doc_id % 3 % (doc_id % 100) as string) end"
    ),
    "ord": "doc_id",
    "title": "case when doc_id % 4 < 2 then ' ' else ' Title ' || doc_id end",
    "source_url": "case when doc_id % 7 = 3 then 'https://example.org/n/' || doc_id when doc_id % 7 = 4 then '' end",
    "text": "text",
}
inputs.as_view("deep_in", "documents", NODES)
view(
    "o_deep",
    """with recursive w as (
  select corpus, node_id, node_id as root_id, 1 as depth, [ord] as path, nullif(trim(title), '') as article_title, nullif(trim(source_url), '') as link
  from deep_in where parent_id is null
  union all
  select n.corpus, n.node_id, w.root_id, depth + 1, list_append(path, n.ord), coalesce(w.article_title, nullif(trim(n.title), '')),
    coalesce(nullif(trim(n.source_url), ''), link)
  from w join deep_in n on n.corpus = w.corpus and n.parent_id = w.node_id
)
select corpus, node_id, root_id, depth::BIGINT as depth, article_title, link as source_url,
  row_number() over (partition by corpus order by path, node_id) as seq from w""",
)


def _nodes(spark, sf):
    return inputs.select(inputs.spread(inputs.table(spark, sf, "documents")), NODES)


@query("tree_walk", "select corpus, node_id, root_id, depth, article_title, source_url, seq from o_deep")
def tree_walk(spark, sf):
    """Nodes of any depth in depth-first order, with the title and link they inherit."""
    walked, _ = D.walk(_nodes(spark, sf))
    return D.numbered(walked.drop("text")).select(
        "corpus", "node_id", "root_id", "depth", "article_title", "source_url", F.col("seq").cast("bigint").alias("seq")
    )


@query(
    "tree_rejects",
    """select corpus, node_id, 'parent not found' as reason from deep_in
where (corpus, node_id) not in (select (corpus, node_id) from o_deep)""",
)
def tree_rejects(spark, sf):
    return D.walk(_nodes(spark, sf))[1]


@query("tree_objects", "select corpus, node_id, root_id, depth, article_title, w.source_url, md5(text) as text_md5 from o_deep w join deep_in using (corpus, node_id)")
def tree_objects(spark, sf):
    """Written as one nested object per corpus and read back."""
    path = files.scratch(spark, "tree-objects")
    D.write_tree_objects(D.walk(_nodes(spark, sf))[0], path)
    return D.read_tree_objects(spark, path).select(
        "corpus", "node_id", "root_id", "depth", "article_title", "source_url", F.md5("text").alias("text_md5")
    )
