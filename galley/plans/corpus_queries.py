"""Corpus build: sources, cleaning, sections, nodes, chunks and term vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley import fixed
from galley.functions import terms as V
from galley.functions import text as T
from galley.operators import corpus as C
from galley.operators.scale import spread
from galley.plans import inputs
from galley.plans import sqltext as Q
from galley.plans.registry import query, table, view
from galley.sources import files

HEADER = "Guide 2025"


# ---- check SQL ------------------------------------------------------------

view(
    "o_front",
    r"""select corpus, lang, slug, doc_id,
  regexp_extract(raw, '(?s)\A---\n(.*?)\n---\n', 1) as front,
  substr(raw, length(regexp_extract(raw, '(?s)\A---\n(.*?)\n---\n', 0)) + 1) as body
from articles_in""",
)


def _scalar(key: str) -> str:
    line = rf'(?m)^{key}:[ \t]*"?([^"\n]*)"?[ \t]*$'
    return f"nullif(regexp_extract(front, {Q.lit(line)}, 1), '')"


def _unlink(x: str) -> str:
    return Q.strip(f"regexp_replace({x}, '\\[\\[(.+?)\\]\\]', '\\1', 'g')")


def _items(key: str) -> str:
    block = rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n)*)"
    return (
        f"list_transform(regexp_extract_all(regexp_extract(front || chr(10), {Q.lit(block)}, 1), "
        f"'\"(.*?)\"', 1), lambda i: {_unlink('i')})"
    )


view(
    "o_parsed",
    f"""select corpus, lang, slug, doc_id, body,
  {_scalar('title')} as title,
  {_unlink(_scalar('description'))} as description,
  {_scalar('published')} as published, {_scalar('source')} as source_url,
  {_items('tag')} as tags, {_items('author')} as author
from o_front""",
)
_CUT = ", ".join(f"nullif(instr(body, chr(10) || {Q.lit(h)}), 0)" for h in fixed.BOILERPLATE_HEADINGS)
view(
    "o_cut",
    f"""select * replace ({Q.rstrip(f"substr(body, 1, coalesce(list_min([{_CUT}]) - 1, length(body)))")} as body)
from o_parsed""",
)
_CLEAN = Q.sub(
    Q.sub(
        Q.sub("body", r"(?m)^\s*!\[.*?\]\(.*?\).*$"),
        r"(?mi)^\s*<(iframe|video|source|track|p|a)\b.*$",
    ),
    r"(?m)^\d{1,2}/\d{1,2}/\d{4}\s*•.*$",
)
_CLEAN = f"ltrim(regexp_replace({_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {Q.WS})"
view("o_clean0", f"select * replace ({_CLEAN} as body) from o_cut")
view(
    "o_clean",
    f"""select * replace ({Q.strip("case when body like '# %' then regexp_replace(body, '^#[ ]+[^' || chr(10) || ']+' || chr(10) || '+', '') else body end")} as body)
from o_clean0""",
)
view(
    "o_parts",
    r"""select corpus, slug, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from (
  select corpus, slug,
    string_split(regexp_replace(body, '(^|\n)(##\s+[^\n])', '\1' || chr(1) || '\2', 'g'), chr(1)) as parts
  from o_clean)""",
)
view(
    "o_sections",
    f"""select corpus, slug, part, i,
  row_number() over (partition by corpus, slug order by i) as ord, line_num
from (select *, 1 + coalesce(sum({Q.newlines('part')}) over (partition by corpus, slug order by i
    rows between unbounded preceding and 1 preceding), 0) as line_num from o_parts)
where regexp_matches(part, '^##\\s+[^\\n]')""",
)
view(
    "o_roots",
    "select *, row_number() over (partition by corpus order by slug) - 1 as root_ord from o_clean",
)
view(
    "o_nodes",
    f"""select corpus, root_ord, 0 as node_ord, printf('%04d', root_ord) as node_id, title,
  title as article_title, '# ' || title || chr(10) || chr(10) || body || chr(10) as text,
  '' as summary, coalesce(description, {Q.summary('body')}) as prefix_summary,
  tags, tags as root_tags, source_url, 1 as line_num, lang
from o_roots
union all
select r.corpus, r.root_ord, s.ord, printf('%04d', r.root_ord) || '.' || printf('%04d', s.ord),
  {Q.strip("regexp_extract(s.part, '^##\\s+([^\\n]+)', 1)")}, r.title, {Q.strip('s.part')},
  {Q.summary(Q.strip('s.part'))}, '', []::VARCHAR[], r.tags, r.source_url, s.line_num, r.lang
from o_sections s join o_roots r on r.corpus = s.corpus and r.slug = s.slug""",
)
view(
    "o_chunks",
    f"""select corpus, root_ord, node_ord, node_id, title, article_title, source_url, tags, lang,
  line_num, s // 220 as chunk_index, array_to_string(list_slice(ws, s + 1, s + 260), ' ') as content,
  corpus || ':' || node_id || ':' || printf('%03d', s // 220) as id
from (select *, unnest(case when len(ws) <= 260 then [0]
    else list_filter(range(0, len(ws), 220), lambda s: s = 0 or len(ws) - s >= 40) end) as s
  from (select *, {Q.words(Q.strip('text'))} as ws from o_nodes) where len(ws) > 0)""",
)
view(
    "o_tokens",
    f"""select corpus, root_ord, node_ord, chunk_index, id, unnest(tk) as term, unnest(range(1, len(tk) + 1)) as pos
from (select *, {Q.tokens("title || ' ' || content || ' ' || array_to_string(tags, ' ')", 3, fixed.BUILD_STOPWORDS)} as tk
  from o_chunks)""",
)
view(
    "o_counts",
    """select corpus, root_ord, node_ord, chunk_index, id, term, count(*) as n, min(pos) as pos
from o_tokens group by all""",
)
view(
    "o_terms",
    """select corpus, root_ord, node_ord, chunk_index, id, term, round(n / nn, 6) as weight from (
  select c.*, sqrt(sum(n * n) over (partition by id)) as nn,
    row_number() over (partition by id order by n desc, pos) as rk from o_counts c) where rk <= 96""",
)


# ---- queries --------------------------------------------------------------


def trees(spark, sf):
    return C.article_trees(inputs.articles(spark, sf))


def nodes(spark, sf):
    return C.flatten(trees(spark, sf))


def parsed(spark, sf):
    return C.frontmatter(inputs.articles(spark, sf))


_FRONT_OUT = """corpus, slug, title, coalesce(description, '') as description, published, source_url,
  array_to_string(tags, '|') as tags, array_to_string(author, '|') as author"""


def _front_cols(df, *more):
    return df.select(
        "corpus", "slug", "title", F.coalesce("description", F.lit("")).alias("description"),
        "published", "source_url", F.array_join("tags", "|").alias("tags"),
        F.array_join("author", "|").alias("author"), *more,
    )


@query("src_articles", f"select {_FRONT_OUT}, lang from o_parsed")
def src_articles(spark, sf):
    path = files.scratch(spark, "articles")
    files.write_article_archive(inputs.articles(spark, sf), path)
    read = files.read_article_archive(spark, path)
    return _front_cols(C.frontmatter(read), "lang")


@query("frontmatter", f"select {_FRONT_OUT}, md5(body) as body_md5 from o_parsed")
def frontmatter(spark, sf):
    return _front_cols(parsed(spark, sf).withColumn("body_md5", F.md5("body")), "body_md5")


@query("wikilinks", f"select doc_id, md5({_unlink('raw')}) as text_md5 from articles_in")
def wikilinks(spark, sf):
    return inputs.articles(spark, sf).select("doc_id", F.md5(C.wikilinks(F.col("raw"))).alias("text_md5"))


@query("boilerplate_cut", "select corpus, slug, length(body) as chars, md5(body) as body_md5 from o_cut")
def boilerplate_cut(spark, sf):
    cut = C.cut_boilerplate(F.col("body"))
    return parsed(spark, sf).select(
        "corpus", "slug", F.length(cut).cast("bigint").alias("chars"), F.md5(cut).alias("body_md5")
    )


@query("body_clean", "select corpus, slug, body from o_clean")
def body_clean(spark, sf):
    return parsed(spark, sf).select(
        "corpus", "slug", C.clean_body(C.cut_boilerplate(F.col("body"))).alias("body")
    )


@query("summary", f"select doc_id, {Q.summary('text')} as summary from documents")
def summary(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", C.summary(F.col("text")).alias("summary"))


@query(
    "h2_sections",
    f"""select corpus, slug, ord as section, {Q.strip("regexp_extract(part, '^##\\s+([^\\n]+)', 1)")} as title,
  line_num::BIGINT as line_num, md5({Q.strip('part')}) as text_md5 from o_sections""",
)
def h2_sections(spark, sf):
    body = C.clean_body(C.cut_boilerplate(F.col("body")))
    return (
        parsed(spark, sf)
        .select("corpus", "slug", body.alias("body"))
        .select("corpus", "slug", F.posexplode_outer(C.h2_sections(F.col("body"))).alias("i", "s"))
        .where(F.col("s").isNotNull())
        .select(
            "corpus", "slug", (F.col("i") + 1).cast("bigint").alias("section"), F.col("s.title").alias("title"),
            F.col("s.line_num").cast("bigint").alias("line_num"), F.md5("s.text").alias("text_md5"),
        )
    )


_NODE_OUT = """corpus, node_id, title, article_title, md5(text) as text_md5, summary, prefix_summary,
  array_to_string(tags, '|') as tags, source_url, line_num::BIGINT as line_num, lang"""


def _node_cols(df):
    return df.select(
        "corpus", "node_id", "title", "article_title", F.md5("text").alias("text_md5"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("prefix_summary", F.lit("")).alias("prefix_summary"),
        F.array_join("tags", "|").alias("tags"), "source_url",
        F.col("line_num").cast("bigint").alias("line_num"), "lang",
    )


@query("article_nodes", f"select {_NODE_OUT} from o_nodes")
def article_nodes(spark, sf):
    return _node_cols(nodes(spark, sf))


@query("sink_tree_json", "select corpus, root_ord::BIGINT as root_ord, count(*) as nodes from o_nodes group by all")
def sink_tree_json(spark, sf):
    path = files.scratch(spark, "trees")
    files.write_trees(trees(spark, sf), path)
    return files.read_trees(spark, path).select(
        "corpus", "root_ord", (F.size("nodes") + 1).cast("bigint").alias("nodes")
    )


@query("src_tree_json", f"select {_NODE_OUT} from o_nodes")
def src_tree_json(spark, sf):
    path = files.scratch(spark, "trees")
    files.write_trees(trees(spark, sf), path)
    return _node_cols(C.flatten(files.read_trees(spark, path)))


@query(
    "tree_flatten",
    "select corpus, node_id, article_title, source_url from o_nodes",
)
def tree_flatten(spark, sf):
    return nodes(spark, sf).select("corpus", "node_id", "article_title", "source_url")


def _token_sql(min_len, stop):
    return Q.tokens("text", min_len, stop)


@query(
    "tokenize",
    f"""select doc_id, len({_token_sql(3, fixed.BUILD_STOPWORDS)}) as build_tokens,
  md5(array_to_string({_token_sql(3, fixed.BUILD_STOPWORDS)}, ' ')) as build_md5,
  len(list_distinct({_token_sql(3, fixed.QUERY_STOPWORDS)})) as query_terms,
  md5(array_to_string(list_sort(list_distinct({_token_sql(2, fixed.QUERY_STOPWORDS)})), ' ')) as tag_md5
from documents""",
)
def tokenize(spark, sf):
    text = F.col("text")
    build = T.tokens(text, 3, fixed.BUILD_STOPWORDS)
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        F.size(build).cast("bigint").alias("build_tokens"),
        F.md5(F.array_join(build, " ")).alias("build_md5"),
        F.size(T.token_set(text, 3)).cast("bigint").alias("query_terms"),
        F.md5(F.array_join(F.array_sort(T.token_set(text, 2)), " ")).alias("tag_md5"),
    )


@query(
    "chunk_words",
    "select corpus, node_id, chunk_index::BIGINT as chunk_index, md5(content) as content_md5 from o_chunks",
)
def chunk_words(spark, sf):
    return (
        nodes(spark, sf)
        .select("corpus", "node_id", F.posexplode_outer(V.chunk_words(T.strip(F.col("text")))).alias("i", "c"))
        .where(F.col("c").isNotNull())
        .select("corpus", "node_id", F.col("i").cast("bigint").alias("chunk_index"), F.md5("c").alias("content_md5"))
    )


@query("term_vectors", "select id, term, weight from o_terms")
def term_vectors(spark, sf):
    chunks = C.chunk_records(nodes(spark, sf))
    rows = chunks.select("id", F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
    return rows.select("id", "t.term", "t.weight")


_CHUNK_OUT = """id, corpus, node_id, chunk_index::BIGINT as chunk_index, title, content, lang as language,
  line_num::BIGINT as line_num, array_to_string(tags, '|') as tags,
  (select count(*) from o_terms t where t.id = c.id) as terms"""


def _chunk_cols(df):
    return df.select(
        "id", "corpus", "node_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "title",
        "content", "language", F.col("line_num").cast("bigint").alias("line_num"),
        F.array_join("tags", "|").alias("tags"), F.size("terms").cast("bigint").alias("terms"),
    )


@query("chunk_records", f"select {_CHUNK_OUT} from o_chunks c")
def chunk_records(spark, sf):
    return _chunk_cols(C.chunk_records(nodes(spark, sf)))


@query("sink_chunks", "select corpus, count(*) as chunks from o_chunks group by corpus")
def sink_chunks(spark, sf):
    path = files.scratch(spark, "chunks")
    files.write_chunks(C.chunk_records(nodes(spark, sf)), path)
    return files.read_chunks(spark, path).groupBy("corpus").agg(F.count(F.lit(1)).alias("chunks"))


@query("src_chunks", f"select {_CHUNK_OUT} from o_chunks c")
def src_chunks(spark, sf):
    path = files.scratch(spark, "chunks")
    files.write_chunks(C.chunk_records(nodes(spark, sf)), path)
    return _chunk_cols(files.read_chunks(spark, path))


@query(
    "corpus_stats",
    f"""select corpus, count(*) as articles, (sum({Q.newlines('text')}) + 4 * (count(*) - 1))::BIGINT as line_count
from o_nodes where node_ord = 0 group by corpus""",
)
def corpus_stats(spark, sf):
    return C.corpus_stats(trees(spark, sf))


# ---- paged guides ---------------------------------------------------------


def _page_sql(kind: str) -> str:
    drop = "^[0-9]+$" if kind == "guide" else r"^[0-9]+(\s+[0-9]+)*$"
    line = f"replace(l, '{HEADER}', '')" if kind == "guide" else "l"
    cleaned = (
        "list_transform(string_split(raw, chr(12)), lambda p: "
        + Q.strip(
            "regexp_replace(array_to_string(list_filter(list_transform(string_split(p, chr(10)), "
            f"lambda l: {Q.rstrip(line)}), lambda l: not regexp_matches({Q.strip('l')}, '{drop}')), chr(10)), "
            "'\\n{3,}', chr(10) || chr(10), 'g')"
        )
        + ")"
    )
    if kind == "guide":
        cleaned = f"list_filter({cleaned}, lambda p: p <> '')"
    filled = f"list_filter(list_transform(string_split(body, chr(10)), lambda l: {Q.strip('l')}), lambda l: l <> '')"
    if kind == "guide":
        named = (
            f"list_filter(ls[1:12], lambda l: list_contains({Q.lits(fixed.GUIDE_PAGE_TITLES)}, l) "
            "or regexp_matches(l, '^[0-9]+(?:\\.[0-9]+)*\\.?\\s+\\S'))"
        )
    else:
        named = "list_filter(ls[1:10], lambda l: not regexp_matches(l, '^[0-9]+(\\s+[0-9]+)*$'))"
    return f"""select doc_id, lang, page, body, coalesce({named}[1], ls[1], 'Pagina ' || page) as title from (
  select *, {filled} as ls from (
    select doc_id, lang, unnest(ps) as body, unnest(range(1, len(ps) + 1)) as page
    from (select doc_id, lang, {cleaned} as ps from guides_in)) where body <> '')"""


view("o_guide_pages", _page_sql("guide"))
view("o_slide_pages", _page_sql("slides"))
view(
    "o_marked",
    r"""select doc_id, regexp_extract(part, '^## Page\s+([0-9]+):', 1)::int as page,
  trim(regexp_extract(part, '^## Page\s+[0-9]+:\s+([^\n]+)', 1)) as title,
  """
    + Q.strip(r"regexp_replace(part, '^## Page\s+[0-9]+:\s+[^\n]+', '')")
    + r""" as body from (
  select doc_id, unnest(string_split(regexp_replace(marked, '(^|\n)(## Page\s+[0-9]+:\s+[^\n])', '\1' || chr(1) || '\2', 'g'), chr(1))) as part
  from guides_in) where part like '## Page%'""",
)


def _pages(df, kind):
    split = C.split_pages(F.col("raw"), kind, HEADER)
    return df.select("doc_id", "lang", F.explode_outer(split).alias("p")).where(F.col("p").isNotNull()).select(
        "doc_id", F.col("p.page").cast("bigint").alias("page"), "p.title", "p.body"
    )


@query(
    "src_pages",
    """select doc_id, 'guide' as form, page::BIGINT as page, title, md5(body) as body_md5 from o_guide_pages
union all select doc_id, 'marked', page, title, md5(body) from o_marked""",
)
def src_pages(spark, sf):
    df = inputs.guides(spark, sf)
    marked = df.select("doc_id", F.explode_outer(C.split_marked_pages(F.col("marked"))).alias("p")).where(F.col("p").isNotNull()).select(
        "doc_id", F.col("p.page").cast("bigint").alias("page"), "p.title", "p.body"
    )
    both = _pages(df, "guide").withColumn("form", F.lit("guide")).unionByName(
        marked.withColumn("form", F.lit("marked"))
    )
    return both.select("doc_id", "form", "page", "title", F.md5("body").alias("body_md5"))


@query(
    "page_clean",
    """select doc_id, 'guide' as kind, page::BIGINT as page, body from o_guide_pages
union all select doc_id, 'slides', page, body from o_slide_pages""",
)
def page_clean(spark, sf):
    df = inputs.guides(spark, sf)
    both = _pages(df, "guide").withColumn("kind", F.lit("guide")).unionByName(
        _pages(df, "slides").withColumn("kind", F.lit("slides"))
    )
    return both.select("doc_id", "kind", "page", "body")


@query(
    "page_title",
    """select doc_id, 'guide' as kind, page::BIGINT as page, title from o_guide_pages
union all select doc_id, 'slides', page, title from o_slide_pages""",
)
def page_title(spark, sf):
    df = inputs.guides(spark, sf)
    both = _pages(df, "guide").withColumn("kind", F.lit("guide")).unionByName(
        _pages(df, "slides").withColumn("kind", F.lit("slides"))
    )
    return both.select("doc_id", "kind", "page", "title")


@query(
    "page_nodes",
    f"""select 'guide-' || doc_id || '.' || printf('%04d', page) as node_id, title,
  md5('## ' || title || chr(10) || chr(10) || body) as text_md5, {Q.summary('body')} as summary,
  page::BIGINT as line_num from o_guide_pages
union all
select 'guide-' || g.doc_id, 'Guide ' || g.doc_id,
  md5('# Guide ' || g.doc_id || chr(10) || chr(10) ||
    coalesce(string_agg('## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) order by page), '')),
  'Guide of ' || any_value(g.lang), 1
from guides_in g left join o_guide_pages p on p.doc_id = g.doc_id group by g.doc_id""",
)
def page_nodes(spark, sf):
    guides = inputs.guides(spark, sf).select(
        F.lit("guides").alias("corpus"),
        F.col("doc_id").alias("root_ord"),
        F.concat(F.lit("guide-"), "doc_id").alias("root_id"),
        "lang",
        F.concat(F.lit("Guide "), "doc_id").alias("title"),
        F.concat(F.lit("Guide of "), "lang").alias("summary"),
        F.lit("guides").alias("source_url"),
        C.split_pages(F.col("raw"), "guide", HEADER).alias("pages"),
    )
    return C.flatten(C.page_trees(guides)).select(
        "node_id", "title", F.md5("text").alias("text_md5"), "summary",
        F.col("line_num").cast("bigint").alias("line_num"),
    )
