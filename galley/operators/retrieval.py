"""Routing, scoring and ranking of passages for many requests at once.

Requests come as rows with run_id, user_prompt, task_codes, sector,
topic_keywords, language, workflow, domain_expert, k and backend. Scores come
from a join of request terms with term postings, so only pairs that share a
term exist; the best k per request are found before any text is fetched.

Arrays are unnested with the outer generators: the plain ones make the
optimizer infer a filter on the array, which evaluates its expression twice.
Empty arrays give a null that the next join drops.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import terms as V
from galley.functions import text as T
from galley.operators import corpus as C
from galley.operators import profiles as P
from galley.operators.scale import BROADCAST_ROWS, fits, join_skewed, join_small, number_in_ranges, top_rows
from galley.session import cut_lineage

PLACE = ["corpus", "root_ord", "node_ord"]


# ---- queries and routes ---------------------------------------------------


def query_text() -> Column:
    return F.concat_ws(
        " ",
        "user_prompt",
        F.coalesce("sector", F.lit("")),
        F.array_join("topic_keywords", " "),
        F.array_join(P.ids(F.col("workflow")), " "),
        F.array_join(P.ids(F.col("domain_expert")), " "),
    )


def _by_language(table: dict[str, tuple[str, ...]], lang: Column) -> Column:
    out = F.when(lang == "nl", T.strings(table["nl"])).when(lang == "both", T.strings(table["both"]))
    return out.otherwise(T.strings(table["en"]))


def routes(codes: Column, language: Column, available: Iterable[str]) -> Column:
    """Corpora to search, in order: by task and language, all of them when none is there."""
    have = sorted(available)
    lang = F.coalesce(language, F.lit("en"))
    articles = _by_language(fixed.ARTICLE_CORPORA, lang)
    guides = _by_language(fixed.GUIDE_CORPORA, lang)
    every = T.strings([*fixed.ARTICLE_CORPORA["both"], *fixed.GUIDE_CORPORA["both"]])
    asked = T.let(codes, lambda c: F.when(F.size(c) == 0, T.strings([fixed.DEFAULT_TASK])).otherwise(c))
    wanted = F.flatten(
        F.transform(
            asked,
            lambda c: F.when(c == "T1_SEARCH", articles)
            .when(c == "T2_COMPLIANCE", F.concat(guides, articles))
            .when(
                (c == "T1_TRANSLATE") & (lang != "both"),
                F.concat(articles, guides, every),
            )
            .otherwise(F.concat(articles, guides)),
        )
    )
    found = F.array_distinct(F.filter(wanted, lambda c: c.isin(*have) if have else F.lit(False)))
    return T.let(found, lambda r: F.when(F.size(r) == 0, T.strings(have)).otherwise(r))


def build_query(selected: DataFrame, available: Iterable[str]) -> DataFrame:
    """Add query text, terms, lower-case keywords and routed corpora."""
    joined = F.array_join("topic_keywords", " ")
    return selected.withColumn("query_text", query_text()).withColumns(
        {
            "query_terms": F.array_union(
                T.token_set(F.col("query_text"), 3), T.token_set(joined, 2)
            ),
            "tag_terms": F.filter(F.transform("topic_keywords", F.lower), lambda k: k != ""),
            "corpora": routes(F.col("task_codes"), F.col("language"), available),
        }
    )


# ---- tag filter -----------------------------------------------------------


def tags_match(tags: Column, terms: Column) -> Column:
    """A tag holds a term or a term holds a tag; both sides in lower case."""
    return F.exists(
        terms, lambda k: F.exists(tags, lambda t: F.contains(t, k) | F.contains(k, t))
    )


def _inner_texts(c: Column, lengths: Column) -> Column:
    """The substrings of a text that have one of the lengths."""
    size = F.length(c)
    cuts = F.transform(
        F.filter(lengths, lambda n: n <= size),
        lambda n: F.when(n == 0, T.strings([""])).otherwise(
            F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substr(c, at, n))
        ),
    )
    return F.array_distinct(F.flatten(cuts))


def _matching_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (tag, term) where one text holds the other, by equality of substrings.

    Only substrings as long as a text of the other side are made. What reaches
    the driver are the different lengths of a side, a few numbers.
    """
    def lengths(df: DataFrame, c: str) -> Column:
        seen = df.agg(F.collect_set(F.length(c))).first()[0]
        return F.array(*map(F.lit, sorted(seen))).cast("array<int>")

    in_tag = tags.select(
        "tag", F.explode_outer(_inner_texts(F.col("tag"), lengths(terms, "term"))).alias("term")
    ).join(terms, "term")
    in_term = terms.select(
        "term", F.explode_outer(_inner_texts(F.col("term"), lengths(tags, "tag"))).alias("tag")
    ).join(tags, "tag")
    return in_tag.select("tag", "term").unionByName(in_term.select("tag", "term")).distinct()


def tag_filter(queries: DataFrame, roots: DataFrame) -> DataFrame:
    """(keyword_set, corpus, matched, total) where tags narrow the corpus.

    Roots are first counted per distinct tag list, and requests per distinct
    keyword list, so no pair of request and root is ever made.
    """
    glue = lambda c: F.array_join(c, "\x01")
    tag_lists = roots.groupBy("corpus", F.transform("tags", F.lower).alias("tags")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = tag_lists.groupBy("corpus").agg(F.sum("n").alias("total"))
    in_lists = tag_lists.select(
        "corpus", glue("tags").alias("tag_list"), "n", F.explode_outer("tags").alias("tag")
    ).distinct()
    keyword_lists = queries.where(F.size("tag_terms") > 0).select("tag_terms").distinct()
    in_sets = keyword_lists.select(
        glue("tag_terms").alias("keyword_set"), F.explode_outer("tag_terms").alias("term")
    )
    pairs = _matching_tags(in_lists.select("tag").distinct(), in_sets.select("term").distinct())
    set_tags = in_sets.join(pairs, "term").select("keyword_set", "tag").distinct()
    matched = (
        join_skewed(in_lists, set_tags, ["tag"], ["corpus", "tag_list"])
        .select("keyword_set", "corpus", "tag_list", "n")
        .distinct()
        .groupBy("keyword_set", "corpus")
        .agg(F.sum("n").alias("matched"))
    )
    return join_small(matched, totals, ["corpus"], rows=10_000).where(F.col("matched") < F.col("total"))


def routed(queries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per request and corpus; ``narrowed`` tells whether tags decide there."""
    rows = queries.select(
        "run_id", "k", "tag_terms", "query_terms", "query_text",
        F.posexplode_outer("corpora").alias("route_ord", "corpus"),
    ).where(F.col("corpus").isNotNull())
    if roots is None:
        return rows
    flags = tag_filter(queries, roots).select("keyword_set", "corpus", F.lit(True).alias("narrowed"))
    return (
        rows.withColumn("keyword_set", F.array_join("tag_terms", "\x01"))
        .join(flags, ["keyword_set", "corpus"], "left")
        .withColumn("narrowed", F.coalesce("narrowed", F.lit(False)))
        .drop("keyword_set")
    )


# ---- keyword scores -------------------------------------------------------


def field_terms(title: Column, tags: Column, prefix_summary: Column, summary: Column) -> Column:
    """array<struct<term, w>>: weight of a term by the fields it is in."""
    none = F.lit("")
    sets = F.struct(
        T.token_set(F.coalesce(title, none), 3).alias("title"),
        T.token_set(F.array_join(tags, " "), 2).alias("tags"),
        T.token_set(
            F.concat_ws(" ", F.coalesce(prefix_summary, none), F.coalesce(summary, none)), 3
        ).alias("summary"),
    )
    in_field = lambda field, t, w: F.when(F.array_contains(field, t), w).otherwise(0)
    return T.let(
        sets,
        lambda s: F.transform(
            F.array_union(F.array_union(s["title"], s["tags"]), s["summary"]),
            lambda t: F.struct(
                t.alias("term"),
                (
                    in_field(s["title"], t, fixed.TITLE_WEIGHT)
                    + in_field(s["tags"], t, fixed.TAG_WEIGHT)
                    + in_field(s["summary"], t, fixed.SUMMARY_WEIGHT)
                ).alias("w"),
            ),
        ),
    )


def node_postings(nodes: DataFrame) -> DataFrame:
    fields = field_terms(*[F.col(c) for c in ("title", "tags", "prefix_summary", "summary")])
    return (
        nodes.where(F.col("text") != "")
        .select(*PLACE, F.transform("root_tags", F.lower).alias("root_tags"), F.explode_outer(fields).alias("t"))
        .select(*PLACE, "root_tags", "t.term", "t.w")
    )


def keyword_scores(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, route_ord, root_ord, node_ord, score) of every node that shares a term.

    The place of a corpus on the route stands for its name, so the sums are
    grouped by whole numbers only.
    """
    roots = nodes.where(F.col("node_ord") == 0).select("corpus", F.col("root_tags").alias("tags"))
    asked = routed(queries, roots).select(
        "run_id", "route_ord", "corpus", "narrowed", "tag_terms",
        F.explode_outer("query_terms").alias("term"),
    )
    pairs = join_skewed(node_postings(nodes), asked, ["corpus", "term"], PLACE)
    kept = pairs.where(~F.col("narrowed") | tags_match(F.col("root_tags"), F.col("tag_terms")))
    return kept.groupBy("run_id", "route_ord", *PLACE[1:]).agg(F.sum("w").alias("score"))


def has_valid_k() -> Column:
    """Requests may ask for 1 to MAX_K snippets."""
    return F.coalesce(F.col("k").between(1, fixed.MAX_K), F.lit(False))


def rejected_requests(queries: DataFrame) -> DataFrame:
    """(run_id, k, reason) of requests that are not searched."""
    reason = F.when(F.col("k").isNull(), "k is missing").otherwise(F.lit(f"k is not in 1..{fixed.MAX_K}"))
    return queries.where(~has_valid_k()).select("run_id", "k", reason.alias("reason"))


def _routes(queries: DataFrame) -> DataFrame:
    """(run_id, k, route_ord, corpus) of the requests that are searched."""
    return queries.where(has_valid_k()).select("run_id", "k", F.posexplode_outer("corpora").alias("route_ord", "corpus"))


def _best(queries: DataFrame, scores: DataFrame, value: str, place: list[str]) -> DataFrame:
    """The k best per request: higher score, then search order, then place in the corpus."""
    order = [F.desc(value), "route_ord", *place[1:]]
    ranked = top_rows(scores, ["run_id"], order, fixed.MAX_K, "rank")
    top = F.max(value).over(Window.partitionBy("run_id"))
    scaled = ranked.withColumn("score", F.round(F.col(value) / top, 4))
    return scaled.join(_routes(queries), ["run_id", "route_ord"]).where(F.col("rank") <= F.col("k"))


def _fetch(best: DataFrame, rows: DataFrame, place: list[str], queries: DataFrame) -> DataFrame:
    """Join the winners, at most MAX_K per request, with what they point at."""
    few = fits(queries, BROADCAST_ROWS // fixed.MAX_K)
    return rows.join(F.broadcast(best) if few else best, place)


def _reason(kind: str, matched: Column) -> Column:
    shown = F.array_join(F.slice(F.array_sort(matched), 1, 8), ", ")
    return F.concat(F.lit(kind), F.when(shown == "", "n/a").otherwise(shown))


SNIPPET = [
    "run_id", "rank", "source_doc", "node_id", "title", "article_title", "content", "line_num",
    "score", "reason", "source_url",
]


def topk_keyword(queries: DataFrame, nodes: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Snippets by weighted keyword overlap."""
    if best is None:
        best = _best(queries, keyword_scores(queries, nodes), "score", PLACE)
    terms = queries.select("run_id", "query_terms")
    found = F.transform(
        field_terms(*[F.col(c) for c in ("title", "tags", "prefix_summary", "summary")]),
        lambda t: t["term"],
    )
    full = _fetch(best, nodes, PLACE, queries).join(terms, "run_id")
    return full.select(
        "run_id", "rank", F.col("corpus").alias("source_doc"), "node_id", "title", "article_title",
        F.col("text").alias("content"), "line_num", "score",
        _reason("keyword overlap: ", F.array_intersect(found, "query_terms")).alias("reason"),
        "source_url",
    )


# ---- sparse cosine --------------------------------------------------------


def query_vectors(queries: DataFrame) -> DataFrame:
    """(run_id, k, route_ord, corpus, term, n, length): term counts and their Euclidean length."""
    counted = queries.withColumn("counts", V.term_counts(T.tokens(F.col("query_text"), 3)))
    return (
        counted.withColumn("length", V.norm(F.col("counts")))
        .select("run_id", "k", "length", "counts", F.posexplode_outer("corpora").alias("route_ord", "corpus"))
        .select("run_id", "k", "route_ord", "corpus", "length", F.explode_outer("counts").alias("c"))
        .select("run_id", "k", "route_ord", "corpus", "length", "c.term", F.col("c.n").cast("bigint").alias("n"))
    )


CHUNK = [*PLACE, "chunk_index"]


def dot_products(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run_id, route_ord, root_ord, node_ord, chunk_index, dot) of pairs that share a term.

    ``dot`` is the sum of count x weight in millionths, a whole number, so it
    does not depend on the order of summation.
    """
    asked = query_vectors(queries).select("run_id", "route_ord", "corpus", "term", "n")
    pairs = join_skewed(C.postings(chunks), asked, ["corpus", "term"], ["id"])
    sums = pairs.groupBy("run_id", "route_ord", *CHUNK[1:]).agg(
        F.sum(F.col("n") * F.col("weight6")).alias("dot")
    )
    return sums.where(F.col("dot") > 0)


def sparse_cosine(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dot products with the cosine, the dot product of the scaled vectors."""
    lengths = query_vectors(queries).select("run_id", "route_ord", "corpus", "length").distinct()
    return join_small(dot_products(queries, chunks), lengths, ["run_id", "route_ord"]).withColumn(
        "cosine", F.col("dot") / (F.col("length") * 1_000_000)
    )


def best_vector(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return _best(queries, dot_products(queries, chunks), "dot", CHUNK)


def topk_vector(queries: DataFrame, chunks: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Snippets by sparse cosine."""
    if best is None:
        best = best_vector(queries, chunks)
    asked = queries.select("run_id", T.token_set(F.col("query_text"), 3).alias("_asked"))
    full = _fetch(best, chunks, CHUNK, queries).join(asked, "run_id")
    shared = F.array_intersect(F.transform("terms", lambda t: t["term"]), "_asked")
    return full.select(
        "run_id", "rank", F.col("corpus").alias("source_doc"), "node_id", "title", "article_title",
        "content", "line_num", "score", _reason("sparse vector overlap: ", shared).alias("reason"),
        "source_url",
    )


def retrieve(queries: DataFrame, nodes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snippets and one summary row per request.

    Requests for vectors that find nothing, and all others, go by keywords.
    """
    queries = queries.where(has_valid_k())
    by_vector = queries.where(F.col("backend") == "vector_rag")
    # a few rows per request, read three times below
    best = cut_lineage(best_vector(by_vector, chunks))
    hit = best.select("run_id").distinct()
    rest = queries.join(hit, "run_id", "left_anti")
    snippets = topk_vector(by_vector, chunks, best).unionByName(topk_keyword(rest, nodes))
    counts = snippets.groupBy("run_id").agg(F.count(F.lit(1)).alias("snippet_count"))
    reasoning = (
        F.when(F.col("backend") != "vector_rag", fixed.KEYWORD_NOTE)
        .when(F.col("hit"), fixed.VECTOR_NOTE)
        .otherwise(fixed.FALLBACK_NOTE)
    )
    summary = (
        queries.join(hit.withColumn("hit", F.lit(True)), "run_id", "left")
        .join(counts, "run_id", "left")
        .select(
            "run_id", F.col("backend").alias("provider"), F.col("corpora").alias("corpora_searched"),
            F.coalesce("snippet_count", F.lit(0)).cast("bigint").alias("snippet_count"),
            reasoning.alias("reasoning"),
        )
    )
    return snippets, summary


# ---- picks of an outside ranker -------------------------------------------


def shortlist_target(k: Column) -> Column:
    return F.greatest(k, F.least(F.lit(5), k * 2))


def shortlist(queries: DataFrame, nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """Articles to look into, one row per request and corpus.

    ``picks`` holds stage 1 choices: run_id, corpus, ord, node_id. Only known
    articles that pass the tag filter stay, each once; ``node_ids`` has them in
    order. A request and corpus without a usable pick, or with few articles,
    takes all articles that pass the filter: ``whole`` says so, ``shortlisted``
    how many these are, and ``node_ids`` is null.
    """
    roots = nodes.where(F.col("node_ord") == 0).select(
        "corpus", "node_id", F.col("root_tags").alias("tags")
    )
    flags = tag_filter(queries, roots).select("keyword_set", "corpus", "matched")
    totals = roots.groupBy("corpus").agg(F.count(F.lit(1)).alias("total"))
    pairs = (
        queries.select(
            "run_id", "k", "tag_terms", F.array_join("tag_terms", "\x01").alias("keyword_set"),
            F.posexplode_outer("corpora").alias("route_ord", "corpus"),
        )
        .join(flags, ["keyword_set", "corpus"], "left")
        .join(totals, "corpus", "left")
        .withColumn("candidates", F.coalesce("matched", "total", F.lit(0)).cast("bigint"))
        .withColumn("ask", F.col("candidates") > shortlist_target(F.col("k")))
    )
    usable = (
        picks.join(pairs.where("ask").select("run_id", "corpus", "tag_terms", "matched"), ["run_id", "corpus"])
        .join(roots, ["corpus", "node_id"])
        .where(F.col("matched").isNull() | tags_match(F.transform("tags", F.lower), F.col("tag_terms")))
        .groupBy("run_id", "corpus", "node_id")
        .agg(F.min("ord").alias("ord"))
    )
    # what a ranker picks in one reply
    sizes = usable.groupBy("run_id", "corpus").agg(
        F.count(F.lit(1)).alias("picked"), F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("chosen")
    )
    return (
        pairs.join(sizes, ["run_id", "corpus"], "left")
        .select(
            "run_id", "corpus", "route_ord", "ask",
            F.coalesce("picked", "candidates").alias("shortlisted"),
            F.col("picked").isNull().alias("whole"), F.transform("chosen", lambda c: c["node_id"]).alias("node_ids"),
        )
    )


def ranker_picks(queries: DataFrame, nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """Snippets from stage 2 choices: run_id, corpus, ord, node_id, score, reason.

    Choices must be on the route and point at nodes with text; scores are held
    in 0..1; equal scores keep the order of corpora and choices.
    """
    on_route = queries.select("run_id", "k", F.posexplode_outer("corpora").alias("route_ord", "corpus"))
    known = nodes.where(F.col("text") != "")
    scored = (
        picks.join(on_route, ["run_id", "corpus"])
        .withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 4))
    )
    hits = scored.join(known.select(*PLACE, "node_id"), ["corpus", "node_id"])
    best = top_rows(
        hits, ["run_id"], [F.desc("score"), "route_ord", "ord"], fixed.MAX_K, "rank"
    ).where(F.col("rank") <= F.col("k"))
    full = _fetch(best.drop("node_id"), known, PLACE, queries)
    return full.select(
        "run_id", "rank", F.col("corpus").alias("source_doc"), "node_id", "title", "article_title",
        F.col("text").alias("content"), "line_num", "score", "reason", "source_url",
    )


def retrieve_ranked(
    queries: DataFrame, nodes: DataFrame, chunks: DataFrame, asked: DataFrame, picks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``retrieve`` with an outside ranker for the requests that do not go by vectors.

    ``asked`` holds a row for each request the ranker was asked about: run_id,
    model and error (null if it answered). Its usable choices are the snippets;
    without any, and after an error, keywords decide and the summary says why.
    """
    paged = F.col("backend") != "vector_rag"
    put = asked.groupBy("run_id").agg(F.max("model").alias("model"), F.max("error").alias("error"))
    answered = queries.where(paged & has_valid_k()).join(put.where("error is null").select("run_id"), "run_id", "left_semi")
    # at most MAX_K rows per request, read three times below
    chosen = cut_lineage(ranker_picks(answered, nodes, picks))
    counts = chosen.groupBy("run_id").agg(F.count(F.lit(1)).alias("snippet_count"))
    others, summary = retrieve(queries.join(counts, "run_id", "left_anti"), nodes, chunks)
    reasoning = (
        F.when(~F.col("paged") | F.col("was_asked").isNull(), F.col("reasoning"))
        .when(F.col("error").isNotNull(), F.concat(F.lit(fixed.RANKER_FAILED_NOTE), F.col("error")))
        .otherwise(fixed.RANKER_EMPTY_NOTE)
    )
    told = (
        summary.withColumn("paged", F.col("provider") != "vector_rag")
        .join(put.withColumn("was_asked", F.lit(True)), "run_id", "left")
        .select(
            "run_id", "provider", "corpora_searched", "snippet_count", reasoning.alias("reasoning"),
            F.lit("deterministic").alias("source"), F.lit(None).cast("string").alias("model"),
        )
    )
    by_ranker = (
        queries.join(counts, "run_id").join(put.select("run_id", "model"), "run_id")
        .select(
            "run_id", F.col("backend").alias("provider"), F.col("corpora").alias("corpora_searched"),
            F.col("snippet_count").cast("bigint").alias("snippet_count"), F.lit(fixed.RANKER_NOTE).alias("reasoning"),
            F.lit("llm").alias("source"), "model",
        )
    )
    return chosen.unionByName(others), by_ranker.unionByName(told)


def _one_line(c: Column, limit: int) -> Column:
    return F.substring(F.replace(T.strip(c), F.lit("\n"), F.lit(" ")), 1, limit)


def ranker_lines(nodes: DataFrame) -> DataFrame:
    """The two texts an outside ranker reads for each node, as rows in corpus order.

    A list for one request is the rows of its corpora, or of its shortlist,
    ordered by root_ord and node_ord.
    """
    about = F.coalesce(F.nullif("prefix_summary", F.lit("")), "summary", F.lit(""))
    tags = F.array_join("tags", ", ")
    title = T.strip(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("- ["), "node_id", F.lit("] "), title)
    article = F.concat(
        head, F.lit("\n    tags: "), F.when(tags == "", "-").otherwise(tags),
        F.lit("\n    desc: "), _one_line(about, 280),
    )
    short = _one_line(about, 180)
    tree = F.concat(
        F.when(F.col("node_ord") == 0, "").otherwise("  "), head,
        F.when(short == "", "").otherwise(F.concat(F.lit(" - "), short)),
    )
    return nodes.select(
        *PLACE, "node_id",
        F.when(F.col("node_ord") == 0, article).alias("article_line"),
        tree.alias("tree_line"),
    )


#: Lines of one part of a list.
PART_LINES = 200


def list_parts(lines: DataFrame, by: list[str], order: list[str], line: str) -> DataFrame:
    """Lists of lines as texts: one row per group and part, parts of ``PART_LINES`` lines numbered from 0.

    A list may be most of the table, so it is numbered in ranges and no task
    holds more of it than a part; joined by line breaks, the parts are the list.
    """
    rows = number_in_ranges(lines.select(*by, *order, F.col(line).alias("_line")), by, order, "_seq")
    part = F.floor((F.col("_seq") - 1) / PART_LINES)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_line"))), lambda x: x["_line"])
    return rows.groupBy(*by, part.alias("part")).agg(F.array_join(texts, "\n").alias("text"))


def article_lists(lines: DataFrame) -> DataFrame:
    """What a ranker reads first: the articles of each corpus, the same for all requests that search it."""
    return list_parts(lines.where("article_line IS NOT NULL"), ["corpus"], ["root_ord"], "article_line")


def tree_lists(shortlists: DataFrame, lines: DataFrame) -> DataFrame:
    """What it reads next: for each request and corpus the nodes of the articles on its shortlist, in the shortlist's order.

    A request that takes all articles has no list of its own here (``whole`` in ``shortlist``).
    """
    picked = shortlists.where("node_ids IS NOT NULL").select("run_id", "corpus", F.posexplode("node_ids").alias("ord", "root_id"))
    roots = lines.where("node_ord = 0").select("corpus", "root_ord", F.col("node_id").alias("root_id"))
    placed = picked.join(roots, ["corpus", "root_id"]).select("run_id", "corpus", "ord", "root_ord")
    rows = join_small(lines.select("corpus", "root_ord", "node_ord", "tree_line"), placed, ["corpus", "root_ord"])
    return list_parts(rows, ["run_id", "corpus"], ["ord", "node_ord"], "tree_line")
