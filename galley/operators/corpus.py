"""Articles and paged guides to trees, nodes, chunks and term vectors.

Every step up to the chunk records works inside one input row, so the whole
build is a scan and a projection; only the numbering of articles moves data.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import terms as V
from galley.functions import text as T
from galley.operators.scale import ordinals

OPEN, CLOSE = "---\n", "\n---\n"


def wikilinks(c: Column) -> Column:
    return T.strip(F.regexp_replace(c, r"\[\[(.+?)\]\]", "$1"))


def front_scalar(front: Column, key: str) -> Column:
    """The value of a one-line key, without quotes; null when missing or empty."""
    line = rf'(?md)^{key}:[ \t]*(?:"(.*)"|([^"\n].*?)?)[ \t]*$'
    quoted, plain = F.regexp_extract(front, line, 1), F.regexp_extract(front, line, 2)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")))


def frontmatter(articles: DataFrame) -> DataFrame:
    """Split the raw article into front-matter columns and body; the marks are found by bytes, not by a pattern."""
    raw = F.col("raw")
    end = F.when(F.startswith(raw, F.lit(OPEN)), F.nullif(F.locate(CLOSE, raw, len(OPEN) + 1), F.lit(0)))
    front = F.concat(F.col("front"), F.lit("\n"))
    split = articles.withColumns(
        {
            "front": F.substring(raw, F.lit(len(OPEN) + 1), F.coalesce(end - len(OPEN) - 1, F.lit(0))),
            "body": F.substring(raw, F.coalesce(end + len(CLOSE), F.lit(1)), F.lit(2**31 - 1)),
        }
    )
    title = T.strip(F.regexp_extract("front", r'(?md)^title:\s*"(.+?)"', 1))
    return split.withColumns(
        {
            "title": F.when(title == "", F.col("slug")).otherwise(title),
            "description": T.present(wikilinks(front_scalar(F.col("front"), "description"))),
            "published": front_scalar(F.col("front"), "published"),
            "source_url": front_scalar(F.col("front"), "source"),
            "tags": _front_items(front, "tag"),
            "author": _front_items(front, "author"),
        }
    ).drop("front", "raw")


def _front_items(front: Column, key: str) -> Column:
    block = F.regexp_extract(front, rf"(?md)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n)*)", 1)
    return F.transform(T.matches(block, r'(?md)^[ \t]*-[ \t]+"?(.*?)"?[ \t]*$', 1), wikilinks)


#: From the earliest closing heading on; the heads in common come first, so that they are searched as one text.
_HEAD = os.path.commonprefix(fixed.BOILERPLATE_HEADINGS)
CLOSING = "\n" + _HEAD + "(?:" + "|".join(re.escape(h[len(_HEAD):]) for h in fixed.BOILERPLATE_HEADINGS) + ")(?s:.*)"


def cut_boilerplate(c: Column) -> Column:
    """Body up to the earliest closing heading."""
    return T.rstrip(F.regexp_replace(c, CLOSING, ""))


#: Image and html lines; what one kind leaves empty before the other is a run of line breaks, which is cut anyway.
DROPPED_LINE = rf"(?md)^{fixed.SPACE}*(?:!\[.*?\]\(.*?\)|<(?i:iframe|video|source|track|p|a)\b).*$"
#: A date and its mark may have such lines between them, so these go last.
BYLINE = rf"(?md)^\d{{1,2}}/\d{{1,2}}/\d{{4}}{fixed.SPACE}*•.*$"


def clean_body(c: Column) -> Column:
    """Drop image, html and byline lines, extra blank lines and the leading title."""
    c = F.regexp_replace(F.regexp_replace(c, DROPPED_LINE, ""), BYLINE, "")
    c = T.lstrip(F.regexp_replace(c, r"\n\n\n+", "\n\n"))
    untitled = F.regexp_replace(c, rf"\A#{fixed.SPACE}+[^\n]+\n+", "")
    return T.strip(F.when(F.startswith(c, F.lit("# ")), untitled).otherwise(c))


def summary(c: Column, limit: int = fixed.SUMMARY_CHARS) -> Column:
    """The squeezed text, cut at ``limit``; of a long text only the start is read, if that is enough."""
    cut = lambda s: F.concat(T.rstrip(F.substring(s, 1, limit - 1)), F.lit("..."))

    def shown(whole: Column, starts: list[int]) -> Column:
        if not starts:
            return T.let(T.squeeze(whole), lambda s: F.when(F.length(s) <= limit, s).otherwise(cut(s)))
        return T.let(
            T.squeeze(F.substring(whole, 1, starts[0])),
            # a start that is longer than the limit has all that the summary shows, and so has a start that is all
            lambda head: F.when(F.length(head) > limit, cut(head))
            .when(F.substring(whole, starts[0] + 1, 1) == "", head)
            .otherwise(shown(whole, starts[1:])),
        )

    return T.let(F.coalesce(c, F.lit("")), lambda whole: shown(whole, [limit + limit // 4, 4 * limit]))


def h2_sections(body: Column) -> Column:
    """array<struct<title, text, line_num>> of the second-level sections."""
    head = rf"##{fixed.SPACE}+[^\n]"
    # lines up to the end of each part, so each part is counted once
    numbered = T.let(
        F.transform(
            # the plain look-ahead in front rules out most places at less cost
            F.split(body, rf"(?md)(?=##)(?=^{head})"),
            lambda p: F.struct(p.alias("text"), (F.size(F.split(p, "\n")) - 1).alias("n")),
        ),
        lambda parts: F.zip_with(
            parts, T.running_sum(F.transform(parts, lambda p: p["n"])),
            lambda p, until: F.struct(p["text"].alias("text"), (until - p["n"] + 1).alias("line_num")),
        ),
    )
    return F.transform(
        F.filter(numbered, lambda p: F.rlike(p["text"], F.lit(r"\A" + head))),
        lambda p: F.struct(
            T.strip(F.regexp_extract(p["text"], rf"(?d)\A##{fixed.SPACE}+(.+)", 1)).alias("title"),
            T.strip(p["text"]).alias("text"),
            p["line_num"].alias("line_num"),
        ),
    )


NODE = (
    "array<struct<node_ord:int,node_id:string,parent_id:string,title:string,text:string,"
    "summary:string,prefix_summary:string,source_url:string,line_num:int,page_index:int>>"
)


def _node(**cols: Column) -> Column:
    order = (
        "node_ord node_id parent_id title text summary prefix_summary source_url line_num page_index"
    ).split()
    return F.struct(*[cols.get(name, F.lit(None)).alias(name) for name in order])


def numbered(articles: DataFrame) -> DataFrame:
    """Articles with ``root_ord``, their number in the corpus by slug."""
    return ordinals(articles, ["corpus"], "slug", "root_ord")


def article_trees(articles: DataFrame) -> DataFrame:
    """One row per article: root fields and the array of its child nodes.

    Articles that have no ``root_ord`` yet are numbered as they come, in raw
    form: a text is moved before it is parsed, while it is in one piece.
    """
    placed = articles if "root_ord" in articles.columns else numbered(articles)
    parsed = frontmatter(placed).withColumn("body", clean_body(cut_boilerplate(F.col("body"))))
    root = F.format_string("%04d", "root_ord")
    children = F.transform(
        h2_sections(F.col("body")),
        lambda s, i: _node(
            node_ord=i + 1,
            node_id=F.concat(F.col("root_id"), F.lit("."), F.format_string("%04d", i + 1)),
            parent_id=F.col("root_id"),
            title=s["title"],
            text=s["text"],
            summary=summary(s["text"]),
            line_num=s["line_num"],
        ),
    )
    return parsed.withColumn("root_id", root).select(
        "corpus",
        "root_ord",
        "root_id",
        "lang",
        "slug",
        "title",
        "tags",
        "published",
        "source_url",
        F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("text"),
        F.lit(None).cast("string").alias("summary"),
        F.coalesce("description", summary(F.col("body"))).alias("prefix_summary"),
        children.cast(NODE).alias("nodes"),
    )


def flatten(trees: DataFrame) -> DataFrame:
    """Depth-first nodes; a child takes the article title and, if it has none, the link of its root."""
    root = _node(
        node_ord=F.lit(0),
        node_id=F.col("root_id"),
        title=F.col("title"),
        text=F.col("text"),
        summary=F.col("summary"),
        prefix_summary=F.col("prefix_summary"),
        source_url=F.col("source_url"),
        line_num=F.lit(1),
    )
    every = F.concat(F.array(root).cast(NODE), F.coalesce("nodes", F.array().cast(NODE)))
    own = T.present(F.col("n.source_url"))
    top = F.col("n.node_ord") == 0
    return (
        trees.withColumn("n", F.explode_outer(every))
        .select(
            "corpus",
            "root_ord",
            "root_id",
            "lang",
            F.col("n.node_ord").alias("node_ord"),
            F.col("n.node_id").alias("node_id"),
            F.col("n.parent_id").alias("parent_id"),
            F.col("n.title").alias("title"),
            F.coalesce(T.present(F.col("title")), T.present(F.col("n.title"))).alias("article_title"),
            F.col("n.text").alias("text"),
            F.col("n.summary").alias("summary"),
            F.col("n.prefix_summary").alias("prefix_summary"),
            F.when(top, F.col("tags")).otherwise(T.strings([])).alias("tags"),
            F.col("tags").alias("root_tags"),
            F.when(top, F.col("published")).alias("published"),
            own.alias("own_url"),
            F.coalesce(own, T.present(F.col("source_url"))).alias("source_url"),
            F.coalesce("n.line_num", "n.page_index").alias("line_num"),
            F.col("n.page_index").alias("page_index"),
        )
    )


def corpus_stats(trees: DataFrame) -> DataFrame:
    """Articles and lines per corpus when its articles are joined by a rule line."""
    return trees.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("articles"),
        (F.sum(T.line_breaks(F.col("text"))) + 4 * (F.count(F.lit(1)) - 1)).alias("line_count"),
    )


# ---- paged guides ---------------------------------------------------------


def clean_page(page: Column, kind: str, running_header: str = "") -> Column:
    """Page text without page numbers; ``guide`` pages also lose the running header."""
    number = r"\A\p{Nd}+\z" if kind == "guide" else rf"\A\p{{Nd}}+({fixed.SPACE}+\p{{Nd}}+)*\z"

    def line(ln: Column) -> Column:
        if kind == "guide" and running_header:
            ln = F.replace(ln, F.lit(running_header), F.lit(""))
        return T.rstrip(ln)

    kept = F.filter(
        F.transform(T.lines(page), line), lambda ln: ~F.rlike(T.strip(ln), F.lit(number))
    )
    return T.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def page_title(page: Column, number: Column, kind: str) -> Column:
    """The line that names the page."""
    filled = F.filter(F.transform(T.lines(page), T.strip), lambda ln: ln != "")

    def pick(ls: Column) -> Column:
        if kind == "guide":
            named = F.filter(
                F.slice(ls, 1, 12),
                lambda ln: ln.isin(*fixed.GUIDE_PAGE_TITLES)
                | F.rlike(ln, F.lit(rf"\A\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?{fixed.SPACE}+[^\s]")),
            )
        else:
            named = F.filter(
                F.slice(ls, 1, 10),
                lambda ln: ~F.rlike(ln, F.lit(rf"\A\p{{Nd}}+({fixed.SPACE}+\p{{Nd}}+)*\z")),
            )
        return F.coalesce(F.get(named, F.lit(0)), F.get(ls, F.lit(0)), F.format_string("Pagina %d", number))

    return T.let(filled, pick)


def split_pages(c: Column, kind: str, running_header: str = "") -> Column:
    """array<struct<page, title, body>> of form-feed separated text.

    Guide pages are numbered after empty pages are dropped, slides before.
    """
    cleaned = F.transform(F.split(c, "\f"), lambda p: clean_page(p, kind, running_header))
    if kind == "guide":
        cleaned = F.filter(cleaned, lambda p: p != "")
    numbered = F.transform(cleaned, lambda p, i: F.struct((i + 1).alias("page"), p.alias("body")))
    filled = F.filter(numbered, lambda p: p["body"] != "")
    return F.transform(
        filled,
        lambda p: F.struct(
            p["page"].alias("page"),
            page_title(p["body"], p["page"], kind).alias("title"),
            p["body"].alias("body"),
        ),
    )


def split_marked_pages(c: Column) -> Column:
    """array<struct<page, title, body>> of ``## Page n: title`` sections."""
    s = fixed.SPACE
    head = rf"## Page{s}+\p{{Nd}}+:{s}+[^\n]"
    parts = F.filter(
        F.split(c, rf"(?md)(?=^{head})"), lambda p: F.rlike(p, F.lit(r"\A" + head))
    )
    line = rf"(?d)\A## Page{s}+(\p{{Nd}}+):{s}+([^\n]+)"
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, line, 1).cast("int").alias("page"),
            T.strip(F.regexp_extract(p, line, 2)).alias("title"),
            T.strip(F.regexp_replace(p, line, "")).alias("body"),
        ),
    )


def page_trees(guides: DataFrame, pages: str = "pages") -> DataFrame:
    """Trees of guides; columns corpus, root_ord, root_id, lang, title, summary, source_url, pages.

    The pages of a guide come as one array, so its root text is joined in the row.
    """
    children = F.transform(
        F.col(pages),
        lambda p, i: _node(
            node_ord=i + 1,
            node_id=F.concat(F.col("root_id"), F.lit("."), F.format_string("%04d", p["page"])),
            parent_id=F.col("root_id"),
            title=p["title"],
            text=F.concat(
                F.lit("## "),
                p["title"],
                F.when(p["body"] == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), p["body"])),
            ),
            summary=summary(p["body"]),
            source_url=F.col("source_url"),
            line_num=p["page"],
            page_index=p["page"],
        ),
    ).cast(NODE)
    return guides.withColumn("nodes", children).select(
        "corpus",
        "root_ord",
        "root_id",
        "lang",
        F.lit(None).cast("string").alias("slug"),
        "title",
        T.strings([]).alias("tags"),
        F.lit(None).cast("string").alias("published"),
        "source_url",
        F.concat(
            F.lit("# "),
            "title",
            F.lit("\n\n"),
            F.array_join(F.transform("nodes", lambda n: n["text"]), "\n\n"),
        ).alias("text"),
        "summary",
        F.lit(None).cast("string").alias("prefix_summary"),
        "nodes",
    )


# ---- chunks ---------------------------------------------------------------


def chunk_records(nodes: DataFrame) -> DataFrame:
    """Word chunks of every node with text, each with its term vector."""
    # the words of a text are the same without the space around it; a text without words has no chunk
    cut = nodes.select(
        "corpus",
        "root_ord",
        "node_ord",
        "node_id",
        F.coalesce("title", F.lit("")).alias("title"),
        "article_title",
        F.col("lang").alias("language"),
        "line_num",
        "own_url",
        "source_url",
        "tags",
        "published",
        F.posexplode_outer(V.chunk_words(F.col("text"))).alias("chunk_index", "content"),
    ).where(F.col("chunk_index").isNotNull())
    basis = F.concat_ws(" ", "title", "content", F.array_join("tags", " "))
    return cut.withColumns(
        {
            "id": F.format_string("%s:%s:%03d", "corpus", "node_id", "chunk_index"),
            "terms": V.text_terms(basis, 3, stopwords=fixed.BUILD_STOPWORDS),
        }
    )


def postings(chunks: DataFrame) -> DataFrame:
    """One row per chunk and term; the weight in millionths, so that sums are exact."""
    return chunks.select(
        "corpus",
        "root_ord",
        "node_ord",
        "chunk_index",
        "id",
        F.explode_outer("terms").alias("t"),
    ).select(
        "corpus",
        "root_ord",
        "node_ord",
        "chunk_index",
        "id",
        F.col("t.term").alias("term"),
        F.floor(F.col("t.weight") * 1_000_000 + 0.5).alias("weight6"),
    )
