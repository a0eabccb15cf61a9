"""Retrieval of passages of the document corpora for the benchmark requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley import fixed
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import retrieval as R
from galley.plans import assets, inputs
from galley.plans import intent_queries  # noqa: F401  (registers the intent views)
from galley.plans import sqltext as Q
from galley.plans.registry import ORACLES, query, view
from galley.session import cut_lineage

AVAILABLE = ("corpus_en", "corpus_nl", "schrijfwijzer", "writing_guide")


def selected(spark, sf):
    return P.select_profiles(I.classify(inputs.requests(spark, sf)))


def queries_of(spark, sf):
    """Requests with their queries; read several times by one search, so written once."""
    return cut_lineage(R.build_query(selected(spark, sf), AVAILABLE))


# ---- check SQL ------------------------------------------------------------


def _route_sql() -> str:
    def by_lang(table):
        return (
            f"case lang when 'nl' then {Q.lits(table['nl'])} when 'both' then {Q.lits(table['both'])} "
            f"else {Q.lits(table['en'])} end"
        )

    a, g = by_lang(fixed.ARTICLE_CORPORA), by_lang(fixed.GUIDE_CORPORA)
    every = Q.lits([*fixed.ARTICLE_CORPORA["both"], *fixed.GUIDE_CORPORA["both"]])
    return (
        f"flatten(list_transform(task_codes, lambda c: case c when 'T1_SEARCH' then {a} "
        f"when 'T2_COMPLIANCE' then {g} || {a} "
        f"when 'T1_TRANSLATE' then {a} || {g} || case when lang = 'both' then []::VARCHAR[] else {every} end "
        f"else {a} || {g} end))"
    )


view(
    "o_query",
    f"""select * replace (list_filter(corpora, lambda x, i: list_position(corpora, x) = i) as corpora),
  list_distinct({Q.tokens('query_text', 3, fixed.QUERY_STOPWORDS)} || {Q.tokens('kws', 2, fixed.QUERY_STOPWORDS)}) as query_terms
from (select *, list_filter({_route_sql()}, lambda c: list_contains({Q.lits(AVAILABLE)}, c)) as corpora,
  array_to_string(topic_keywords, ' ') as kws,
  user_prompt || ' ' || coalesce(sector, '') || ' ' || array_to_string(topic_keywords, ' ') || ' ' ||
    array_to_string(workflow_ids, ' ') || ' ' || array_to_string(expert_ids, ' ') as query_text,
  list_transform(topic_keywords, lambda k: lower(k)) as tag_terms
  from (select *, coalesce(language, 'en') as lang from o_req_profiles))""",
)
view(
    "o_routed",
    """select run_id, k, backend, tag_terms, query_terms, query_text, unnest(corpora) as corpus,
  unnest(range(0, len(corpora))) as route_ord from o_query""",
)
_MATCH = (
    "len(list_filter({terms}, lambda k: len(list_filter({tags}, lambda t: contains(lower(t), k) or contains(k, lower(t)))) > 0)) > 0"
)
view(
    "o_flags",
    f"""select run_id, q.corpus, count(*) as total, count_if({_MATCH.format(terms='tag_terms', tags='root_tags')})::BIGINT as matched
from o_routed q join (select corpus, root_tags from o_nodes where node_ord = 0) n on n.corpus = q.corpus
group by all""",
)
_TITLE = Q.tokens("title", 3, fixed.QUERY_STOPWORDS)
_TAGS = Q.tokens("array_to_string(tags, ' ')", 2, fixed.QUERY_STOPWORDS)
_SUM = Q.tokens("prefix_summary || ' ' || summary", 3, fixed.QUERY_STOPWORDS)
view(
    "o_field_terms",
    f"""select corpus, root_ord, node_ord, term, max(a) + max(b) + max(c) as w from (
  select corpus, root_ord, node_ord, unnest({_TITLE}) as term, 4 as a, 0 as b, 0 as c from o_nodes
  union all select corpus, root_ord, node_ord, unnest({_TAGS}), 0, 2, 0 from o_nodes
  union all select corpus, root_ord, node_ord, unnest({_SUM}), 0, 0, 1 from o_nodes) group by all""",
)
view(
    "o_kw_scores",
    f"""select q.run_id, q.k, q.backend, q.corpus, q.route_ord, f.root_ord, f.node_ord, sum(f.w)::BIGINT as score,
  list_sort(list(f.term)) as terms
from (select *, unnest(query_terms) as term from o_routed) q
join o_field_terms f on f.corpus = q.corpus and f.term = q.term
join o_nodes n on n.corpus = f.corpus and n.root_ord = f.root_ord and n.node_ord = f.node_ord
join o_flags g on g.run_id = q.run_id and g.corpus = q.corpus
where not (g.matched > 0 and g.matched < g.total) or {_MATCH.format(terms='q.tag_terms', tags='n.root_tags')}
group by q.run_id, q.k, q.backend, q.corpus, q.route_ord, f.root_ord, f.node_ord""",
)


def _best_sql(source: str, value: str, place: str) -> str:
    return f"""select *, round({value} / max({value}) over (partition by run_id), 4) as rel from (
  select *, row_number() over (partition by run_id order by {value} desc, route_ord, {place}) as rank from {source})
where rank <= k"""


view("o_kw_best", _best_sql("o_kw_scores", "score", "root_ord, node_ord"))
view(
    "o_qvec",
    f"""select *, sqrt(sum(n * n) over (partition by run_id)) as length from (
  select run_id, term, count(*) as n from (
    select run_id, unnest({Q.tokens('query_text', 3, fixed.QUERY_STOPWORDS)}) as term from o_query) group by all)""",
)
view(
    "o_dots",
    """select q.run_id, q.k, q.backend, q.corpus, q.route_ord, t.root_ord, t.node_ord, t.chunk_index, t.id,
  sum(v.n * round(t.weight * 1000000)::BIGINT)::BIGINT as dot, any_value(v.length) as length,
  list_sort(list(t.term)) as terms
from o_routed q join o_qvec v on v.run_id = q.run_id
join o_terms t on t.corpus = q.corpus and t.term = v.term group by all""",
)
view("o_vec_best", _best_sql("o_dots", "dot", "root_ord, node_ord, chunk_index"))


def _vec_out(where: str = "") -> str:
    return f"""select b.run_id, b.rank, b.corpus as source_doc, c.node_id, c.title, c.article_title,
  md5(c.content) as content_md5, b.rel as score,
  'sparse vector overlap: ' || array_to_string(b.terms[1:8], ', ') as reason, c.source_url
from o_vec_best b join o_chunks c on c.id = b.id {where}"""


def _kw_out(where: str = "") -> str:
    return f"""select b.run_id, b.rank, b.corpus as source_doc, n.node_id, n.title, n.article_title,
  md5(n.text) as content_md5, b.rel as score,
  'keyword overlap: ' || array_to_string(b.terms[1:8], ', ') as reason, n.source_url
from o_kw_best b join o_nodes n on n.corpus = b.corpus and n.root_ord = b.root_ord and n.node_ord = b.node_ord {where}"""


def _snippets(df):
    return df.select(
        "run_id", F.col("rank").cast("bigint").alias("rank"), "source_doc", "node_id", "title",
        "article_title", F.md5("content").alias("content_md5"), "score", "reason", "source_url",
    )


# ---- queries --------------------------------------------------------------


@query(
    "build_query",
    """select run_id, query_text, array_to_string(list_sort(query_terms), ' ') as terms, k::BIGINT as k, backend from o_query""",
)
def build_query(spark, sf):
    return queries_of(spark, sf).select(
        "run_id", "query_text", F.array_join(F.array_sort("query_terms"), " ").alias("terms"),
        F.col("k").cast("bigint").alias("k"), "backend",
    )


@query("route_corpora", "select run_id, corpus, route_ord::BIGINT as route_ord from o_routed")
def route_corpora(spark, sf):
    return R.routed(queries_of(spark, sf)).select(
        "run_id", "corpus", F.col("route_ord").cast("bigint").alias("route_ord")
    )


@query(
    "tag_filter",
    """select distinct array_to_string(q.tag_terms, '|') as keywords, q.corpus, matched, total
from o_flags f join o_routed q on q.run_id = f.run_id and q.corpus = f.corpus where matched > 0 and matched < total""",
)
def tag_filter(spark, sf):
    roots = assets.nodes(spark, sf).where("node_ord = 0").select("corpus", "tags")
    queries = queries_of(spark, sf)
    flags = R.tag_filter(queries, roots)
    used = queries.select(
        F.array_join("tag_terms", "\x01").alias("keyword_set"), F.explode("corpora").alias("corpus")
    ).distinct()
    return flags.join(used, ["keyword_set", "corpus"]).select(
        F.replace("keyword_set", F.lit("\x01"), F.lit("|")).alias("keywords"), "corpus", "matched", "total"
    )


@query(
    "keyword_score",
    "select run_id, corpus, root_ord::BIGINT as root_ord, node_ord::BIGINT as node_ord, score from o_kw_scores",
)
def keyword_score(spark, sf):
    queries = queries_of(spark, sf)
    scores = R.keyword_scores(queries, assets.nodes(spark, sf))
    return scores.join(R.routed(queries).select("run_id", "route_ord", "corpus"), ["run_id", "route_ord"]).select(
        "run_id", "corpus", "root_ord", F.col("node_ord").cast("bigint").alias("node_ord"), "score"
    )


@query(
    "rejected_requests",
    """select item_id as run_id, k, 'k is not in 1..20' as reason
from (select item_id, cast(item_id % 30 - 3 as int) as k from benchmark) where k < 1 or k > 20""",
)
def rejected_requests(spark, sf):
    """Requests that ask for none or too many snippets."""
    asked = inputs.table(spark, sf, "benchmark").select(F.col("item_id").alias("run_id"), (F.col("item_id") % 30 - 3).cast("int").alias("k"))
    return R.rejected_requests(asked)


@query("topk_keyword", _kw_out())
def topk_keyword(spark, sf):
    return _snippets(R.topk_keyword(queries_of(spark, sf), assets.nodes(spark, sf)))


@query("query_vector", "select run_id, term, round(n / length, 9) as weight from o_qvec")
def query_vector(spark, sf):
    return (
        R.query_vectors(queries_of(spark, sf)).where("route_ord = 0")
        .select("run_id", "term", F.round(F.col("n") / F.col("length"), 9).alias("weight"))
    )


@query("sparse_cosine", "select run_id, id, dot, round(length * length)::BIGINT as squares from o_dots")
def sparse_cosine(spark, sf):
    return R.sparse_cosine(queries_of(spark, sf), assets.chunks(spark, sf)).select(
        "run_id",
        F.concat_ws(
            ":", "corpus",
            F.concat(
                F.format_string("%04d", "root_ord"),
                F.when(F.col("node_ord") == 0, "").otherwise(F.concat(F.lit("."), F.format_string("%04d", "node_ord"))),
            ),
            F.format_string("%03d", "chunk_index"),
        ).alias("id"),
        "dot", F.round(F.pow(F.col("dot") / F.col("cosine") / 1_000_000, 2)).cast("bigint").alias("squares"),
    )


@query("topk_vector", _vec_out())
def topk_vector(spark, sf):
    return _snippets(R.topk_vector(queries_of(spark, sf), assets.chunks(spark, sf)))


_RETRIEVED = f"""{_vec_out("where b.backend = 'vector_rag'")}
union all {_kw_out("where b.backend <> 'vector_rag' or b.run_id not in (select run_id from o_vec_best)")}"""


def retrieved(spark, sf):
    return R.retrieve(queries_of(spark, sf), assets.nodes(spark, sf), assets.chunks(spark, sf))


@query("retrieve", _RETRIEVED)
def retrieve(spark, sf):
    return _snippets(retrieved(spark, sf)[0])


@query(
    "retrieve_summary",
    f"""select q.run_id, backend as provider, array_to_string(corpora, ',') as corpora, count(s.rank) as snippet_count,
  case when backend <> 'vector_rag' then '{fixed.KEYWORD_NOTE}'
    when q.run_id in (select run_id from o_vec_best) then '{fixed.VECTOR_NOTE}' else '{fixed.FALLBACK_NOTE}' end as reasoning
from o_query q left join ({_RETRIEVED}) s on s.run_id = q.run_id group by all""",
)
def retrieve_summary(spark, sf):
    return retrieved(spark, sf)[1].select(
        "run_id", "provider", F.array_join("corpora_searched", ",").alias("corpora"), "snippet_count", "reasoning"
    )


#: Choices of an outside ranker: per request and corpus, ids by arithmetic, some unknown.
PICKS = {
    "run_id": "run_id",
    "corpus": "corpus",
    "ord": "cast(ord as bigint)",
    "node_id": (
        "lpad(cast((run_id * 7 + ord * 13) % 40 as string), 4, '0') || case when ord % 3 = 2 then '.0001' "
        "when ord % 7 = 6 then '.9999' else '' end"
    ),
    "score": "cast(((run_id * 31 + ord * 17) % 13 - 1) / 10.0 as double)",
    "reason": "'pick ' || ord",
}
inputs.as_view(
    "picks_in", "(select run_id, corpus, unnest(range(0, 8)) as ord from o_routed)", PICKS, "run_id % 4 <> 3"
)


def picks(queries):
    rows = queries.select("run_id", F.explode("corpora").alias("corpus")).withColumn(
        "ord", F.explode(F.sequence(F.lit(0), F.lit(7)))
    )
    return inputs.select(rows.where("run_id % 4 <> 3"), PICKS)


@query(
    "ranker_shortlist",
    f"""select q.run_id, q.corpus, case when candidates > greatest(k, least(5, 2 * k)) then coalesce(nullif(picked, 0), candidates)
    else candidates end as shortlisted,
  not (candidates > greatest(k, least(5, 2 * k)) and coalesce(picked, 0) > 0) as whole,
  case when candidates > greatest(k, least(5, 2 * k)) and picked > 0 then ids else '' end as node_ids
from (select run_id, corpus, case when matched > 0 and matched < total then matched else total end as candidates,
    matched > 0 and matched < total as narrowed from o_flags) f
join o_routed q on q.run_id = f.run_id and q.corpus = f.corpus
left join (select run_id, corpus, count(*) as picked, string_agg(node_id, ',' order by ord, node_id) as ids
  from (select p.run_id, p.corpus, p.node_id, min(p.ord) as ord
  from picks_in p join o_nodes n on n.corpus = p.corpus and n.node_id = p.node_id and n.node_ord = 0
  join o_routed q on q.run_id = p.run_id and q.corpus = p.corpus
  join o_flags f on f.run_id = p.run_id and f.corpus = p.corpus
  where not (f.matched > 0 and f.matched < f.total) or {_MATCH.format(terms='q.tag_terms', tags='n.root_tags')}
  group by all) group by all) s on s.run_id = q.run_id and s.corpus = q.corpus""",
)
def ranker_shortlist(spark, sf):
    queries = queries_of(spark, sf)
    return R.shortlist(queries, assets.nodes(spark, sf), picks(queries)).select(
        "run_id", "corpus", "shortlisted", "whole", F.coalesce(F.array_join("node_ids", ","), F.lit("")).alias("node_ids")
    )


@query(
    "ranker_reconcile",
    """select run_id, rank, corpus as source_doc, node_id, title, article_title, md5(text) as content_md5,
  score, reason, source_url from (
  select p.run_id, q.k, n.*, p.reason, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, p.score)), 4) as score,
    row_number() over (partition by p.run_id order by greatest(0.0::DOUBLE, least(1.0::DOUBLE, p.score)) desc, route_ord, p.ord) as rank
  from picks_in p join o_routed q on q.run_id = p.run_id and q.corpus = p.corpus
  join o_nodes n on n.corpus = p.corpus and n.node_id = p.node_id) where rank <= k""",
)
def ranker_reconcile(spark, sf):
    queries = queries_of(spark, sf)
    return _snippets(R.ranker_picks(queries, assets.nodes(spark, sf), picks(queries)))


#: Requests the ranker was asked about; it failed for some.
ASKED = {
    "run_id": "run_id",
    "model": "'ranker-' || (run_id % 2)",
    "error": "case when run_id % 5 = 4 then 'boom ' || run_id end",
}
inputs.as_view("asked_in", "o_query", ASKED, "run_id % 4 <> 1 and backend <> 'vector_rag'")
view(
    "o_ranked",
    """select run_id, rank, corpus as source_doc, node_id, title, article_title, md5(text) as content_md5,
  score, reason, source_url from (
  select p.run_id, q.k, n.*, p.reason, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, p.score)), 4) as score,
    row_number() over (partition by p.run_id order by greatest(0.0::DOUBLE, least(1.0::DOUBLE, p.score)) desc, route_ord, p.ord) as rank
  from picks_in p join o_routed q on q.run_id = p.run_id and q.corpus = p.corpus
  join o_nodes n on n.corpus = p.corpus and n.node_id = p.node_id
  where p.run_id in (select run_id from asked_in where error is null)) where rank <= k""",
)


def _ranked(spark, sf):
    queries = queries_of(spark, sf)
    asked = inputs.select(queries.where("run_id % 4 <> 1 and backend <> 'vector_rag'"), ASKED)
    return R.retrieve_ranked(queries, assets.nodes(spark, sf), assets.chunks(spark, sf), asked, picks(queries))


@query(
    "retrieve_ranked",
    f"select * from o_ranked union all select * from ({_RETRIEVED}) where run_id not in (select run_id from o_ranked)",
)
def retrieve_ranked(spark, sf):
    """Vectors, an outside ranker, its failures, and keywords, side by side."""
    return _snippets(_ranked(spark, sf)[0])


@query(
    "retrieve_ranked_summary",
    f"""select q.run_id, q.backend as provider, coalesce(n, 0) as snippet_count,
  case when r.run_id is not null then 'llm' else 'deterministic' end as source, case when r.run_id is not null then a.model end as model,
  case when r.run_id is not null then '{fixed.RANKER_NOTE}' when a.error is not null then '{fixed.RANKER_FAILED_NOTE}' || a.error
    when a.run_id is not null then '{fixed.RANKER_EMPTY_NOTE}' when q.backend <> 'vector_rag' then '{fixed.KEYWORD_NOTE}'
    when q.run_id in (select run_id from o_vec_best) then '{fixed.VECTOR_NOTE}' else '{fixed.FALLBACK_NOTE}' end as reasoning
from o_query q left join asked_in a on a.run_id = q.run_id
left join (select distinct run_id from o_ranked) r on r.run_id = q.run_id
left join (select run_id, count(*) as n from (
  select run_id from o_ranked union all select run_id from ({_RETRIEVED}) where run_id not in (select run_id from o_ranked)) group by 1) c
  on c.run_id = q.run_id""",
)
def retrieve_ranked_summary(spark, sf):
    return _ranked(spark, sf)[1].select("run_id", "provider", "snippet_count", "source", "model", "reasoning")


_ABOUT = "case when prefix_summary <> '' then prefix_summary else summary end"
_SHORT = f"substr(replace({Q.strip(_ABOUT)}, chr(10), ' '), 1, 180)"


@query(
    "ranker_input",
    f"""select corpus, node_id, coalesce(case when node_ord = 0 then '- [' || node_id || '] ' || title || chr(10) || '    tags: ' ||
    case when len(tags) = 0 then '-' else array_to_string(tags, ', ') end || chr(10) || '    desc: ' ||
    substr(replace({Q.strip(_ABOUT)}, chr(10), ' '), 1, 280) end, '') as article_line,
  case when node_ord = 0 then '' else '  ' end || '- [' || node_id || '] ' || title ||
    case when {_SHORT} = '' then '' else ' - ' || {_SHORT} end as tree_line from o_nodes""",
)
def ranker_input(spark, sf):
    return R.ranker_lines(assets.nodes(spark, sf)).select(
        "corpus", "node_id", F.coalesce("article_line", F.lit("")).alias("article_line"), "tree_line"
    )


view(
    "o_lines",
    f"""select corpus, root_ord, node_ord, node_id, coalesce(case when node_ord = 0 then '- [' || node_id || '] ' || title || chr(10) || '    tags: ' ||
    case when len(tags) = 0 then '-' else array_to_string(tags, ', ') end || chr(10) || '    desc: ' ||
    substr(replace({Q.strip(_ABOUT)}, chr(10), ' '), 1, 280) end, '') as article_line, case when node_ord = 0 then '' else '  ' end || '- [' || node_id || '] ' || title ||
    case when {_SHORT} = '' then '' else ' - ' || {_SHORT} end as tree_line from o_nodes""",
)


def _parts_sql(rows: str, by: str, order: str, line: str) -> str:
    return f"""select {by}, part, md5(string_agg({line}, chr(10) order by seq)) as text_md5 from (
  select *, (seq - 1) // 200 as part from (select *, row_number() over (partition by {by} order by {order}) as seq from ({rows}))) group by {by}, part"""


@query("ranker_article_lists", _parts_sql("select * from o_lines where node_ord = 0", "corpus", "root_ord", "article_line"))
def ranker_article_lists(spark, sf):
    """Stage 1 lists of articles, in parts of 200 lines."""
    lists = R.article_lists(R.ranker_lines(assets.nodes(spark, sf)))
    return lists.select("corpus", "part", F.md5("text").alias("text_md5"))


view("o_shortlist", ORACLES["ranker_shortlist"])


@query(
    "ranker_tree_lists",
    _parts_sql(
        """select s.run_id, s.corpus, s.ord, l.node_ord, l.tree_line from (
  select run_id, corpus, unnest(string_split(node_ids, ',')) as root_id, unnest(range(len(string_split(node_ids, ',')))) as ord
  from o_shortlist where node_ids <> '') s
join o_lines r on r.corpus = s.corpus and r.node_id = s.root_id and r.node_ord = 0
join o_lines l on l.corpus = r.corpus and l.root_ord = r.root_ord""",
        "run_id, corpus", "ord, node_ord", "tree_line",
    ),
)
def ranker_tree_lists(spark, sf):
    """Stage 2 lists: the nodes of the articles on each request's shortlist."""
    queries, nodes = queries_of(spark, sf), assets.nodes(spark, sf)
    lists = R.tree_lists(R.shortlist(queries, nodes, picks(queries)), R.ranker_lines(nodes))
    return lists.select("run_id", "corpus", "part", F.md5("text").alias("text_md5"))
