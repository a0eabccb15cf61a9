"""Citations, model replies, template drafts and the texts models are given.

Snippets of a request, at most MAX_K, travel as one array, so everything
after ``snippet_arrays`` stays in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T
from galley.operators.scale import join_skewed

FIELDS = [
    "source_doc", "node_id", "title", "article_title", "content", "line_num", "score", "reason", "source_url",
]


def snippet_arrays(snippets: DataFrame) -> DataFrame:
    """One row per run with its snippets in rank order."""
    bounded = snippets.where(F.col("rank") <= fixed.MAX_K)
    return bounded.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *FIELDS))).alias("snippets")
    )


def _citation(index: Column, s: Column) -> Column:
    return F.struct(
        index.cast("int").alias("index"),
        s["source_doc"].alias("source_doc"),
        s["node_id"].alias("node_id"),
        s["title"].alias("title"),
        F.coalesce(F.nullif(s["article_title"], F.lit("")), s["title"]).alias("article_title"),
        s["source_url"].alias("source_url"),
    )


def citations(snippets: Column) -> Column:
    """The first snippets as numbered citations."""
    return F.transform(
        F.slice(snippets, 1, fixed.MAX_CITATIONS), lambda s, i: _citation(i + 1, s)
    )


def citations_from_indices(snippets: Column, indices: Column) -> Column:
    """Citations a reply names, in its order; the first snippets when none is valid."""
    valid = F.filter(indices, lambda i: (i >= 1) & (i <= F.size(snippets)))
    return T.let(
        F.transform(valid, lambda i: _citation(i, F.get(snippets, i - 1))),
        lambda c: F.when(F.size(c) == 0, citations(snippets)).otherwise(c),
    )


def reply_indices(reply: Column) -> Column:
    """Whole numbers of ``citation_indices`` in a JSON reply, in order."""
    raw = F.coalesce(F.get_json_object(T.unfence(reply), "$.citation_indices"), F.lit(""))
    items = F.filter(
        F.split(F.regexp_replace(raw, r"\A\[|\]\z", ""), ","), lambda x: F.rlike(x, F.lit(r"\A\s*-?\d+\s*\z"))
    )
    return F.filter(
        F.transform(items, lambda x: F.trim(x).try_cast("int")), lambda i: i.isNotNull()
    )


def reply_body(reply: Column) -> Column:
    """The first filled text under the known body keys; null when there is none."""
    return T.let(
        F.try_parse_json(T.unfence(reply)),
        lambda v: F.coalesce(*[_text_at(v, key) for key in fixed.REPLY_BODY_KEYS]),
    )


def _text_at(v: Column, key: str) -> Column:
    is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING"
    value = F.try_variant_get(v, f"$.{key}", "string")
    return F.when(is_text & T.present(value).isNotNull(), value)


def _label(s: Column) -> Column:
    pick = lambda n: F.nullif(s[n], F.lit(""))
    return F.coalesce(pick("article_title"), pick("title"), pick("source_doc"))


def source_reference(s: Column) -> Column:
    """Title of a source, as a markdown link when it has an address."""
    url = F.nullif(s["source_url"], F.lit(""))
    return F.when(url.isNull(), _label(s)).otherwise(
        F.concat(F.lit("["), _label(s), F.lit("]("), url, F.lit(")"))
    )


def report_reference(s: Column) -> Column:
    """The same for reports, with brackets in the label escaped."""
    label = F.coalesce(_label(s), F.lit("Source"))
    safe = F.replace(F.replace(label, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    url = F.nullif(s["source_url"], F.lit(""))
    return F.when(url.isNull(), safe).otherwise(F.concat(F.lit("["), safe, F.lit("]("), url, F.lit(")")))


def source_list(cited: Column, snippets: Column) -> Column:
    """Lines ``- [n] reference`` of the citations, each pair once, gaps filled from the snippets."""

    def merged(c: Column) -> Column:
        s = F.get(snippets, c["index"] - 1)
        fill = lambda n: F.coalesce(c[n], s[n]).alias(n)
        return F.struct(*[fill(n) for n in ("source_doc", "title", "article_title", "source_url")])

    rows = F.array_distinct(
        F.transform(
            cited,
            lambda c: F.concat(F.lit("- ["), c["index"].cast("string"), F.lit("] "), report_reference(merged(c))),
        )
    )
    return F.when(F.coalesce(F.size(cited), F.lit(0)) <= 0, "").otherwise(
        F.concat(F.lit("\n\n**Sources**\n\n"), F.array_join(rows, "\n"))
    )


def template_draft(product: str = "Editorial", guide: str = "writing guide", guide_nl: str = "schrijfwijzer") -> Column:
    """Draft text without a model, from refined_prompt, language, topic_keywords, workflow, domain_expert and snippets."""

    def text(lang: str) -> Column:
        w = fixed.DRAFT_WORDING[lang]
        fill = lambda s: F.lit(s.format(product=product, guide=guide_nl if lang == "nl" else guide))
        names = F.array_join(F.transform(F.concat("workflow", "domain_expert"), lambda p: p["name"]), ", ")
        title = F.when(F.size("topic_keywords") > 0, F.concat(fill(w["title"]), F.lit(": "), F.col("topic_keywords")[0])).otherwise(fill(w["title"]))
        rows = F.transform(
            F.slice(F.coalesce("snippets", F.array()), 1, fixed.MAX_CITATIONS),
            lambda s, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), source_reference(s)),
        )
        gap = F.lit("\n\n")
        return F.concat(
            F.lit("# "), title, gap, fill(w["intro"]), gap, F.lit(w["instruction"]), gap, F.col("refined_prompt"),
            gap, F.lit(w["profiles"]), gap, F.when(names == "", w["no_profile"]).otherwise(names), gap,
            F.lit(w["sources"]), gap,
            F.when(F.coalesce(F.size("snippets"), F.lit(0)) <= 0, w["no_source"]).otherwise(F.array_join(rows, "\n")),
            gap, fill(w["outro"]),
        )

    return F.when(F.coalesce(F.col("language") == "nl", F.lit(False)), text("nl")).otherwise(text("en"))


def draft(runs: DataFrame, replies: DataFrame | None = None, **wording: str) -> DataFrame:
    """Body, citations and source of every run; ``replies`` may bring a reply per run_id.

    A reply without a usable body gives the template draft.
    """
    rows = runs
    if replies is None:
        rows = rows.withColumn("draft_reply", F.lit(None).cast("string"))
    else:
        rows = rows.join(replies.select("run_id", "draft_reply"), "run_id", "left")
    rows = rows.withColumn("_body", reply_body(F.col("draft_reply")))
    good = F.col("_body").isNotNull()
    empty = F.array().cast(rows.schema["snippets"].dataType)
    have = F.coalesce("snippets", empty)
    return rows.withColumns(
        {
            "body": F.when(good, F.col("_body")).otherwise(template_draft(**wording)),
            "citations": F.when(
                good, citations_from_indices(have, reply_indices(F.col("draft_reply")))
            ).otherwise(citations(have)),
            "draft_source": F.when(good, "llm").otherwise("deterministic"),
        }
    ).drop("_body", "draft_reply")


# ---- texts for models -----------------------------------------------------


def _one_line(c: Column) -> Column:
    return F.replace(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))


def drafting_sources(snippets: Column) -> Column:
    rows = F.transform(
        F.slice(snippets, 1, 8),
        lambda s, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), source_reference(s), F.lit("\n"),
            F.substring(s["content"], 1, 1200),
        ),
    )
    return F.array_join(rows, "\n")


def refinement_sources(snippets: Column) -> Column:
    rows = F.transform(
        F.slice(snippets, 1, 5),
        lambda s: F.concat(
            F.lit("- ["), s["source_doc"], F.lit("::"), s["node_id"], F.lit("] "), s["title"],
            F.lit("\n  reason="), s["reason"], F.lit("\n  excerpt="), F.substring(_one_line(s["content"]), 1, 240),
        ),
    )
    text = F.array_join(rows, "\n")
    return F.when(text == "", "(no snippets retrieved)").otherwise(text)


def judging_sources(snippets: Column, limit: int = 600) -> Column:
    def row(s: Column, i: Column) -> Column:
        body = T.let(
            _one_line(s["content"]),
            lambda b: F.when(F.length(b) > limit, F.concat(F.substring(b, 1, limit), F.lit("…"))).otherwise(b),
        )
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), s["title"], F.lit(" ("), s["source_doc"],
            F.lit("::"), s["node_id"], F.lit(")\n    "), body,
        )

    text = F.array_join(F.transform(snippets, row), "\n")
    return F.when(text == "", "(no evidence snippets)").otherwise(text)


def allowed_values(scale: str) -> str:
    """The values a judge may give, as the judging text shows them."""
    return "[" + ", ".join(f"'{v}'" for v in fixed.SCALES[scale] if v != "unknown") + "]"


def judging_table(runs: DataFrame, kpis: DataFrame, rubrics: dict[str, str] | None = None) -> DataFrame:
    """One row per draft and applicable judge: the text the judge reads.

    ``kpis`` is an applicability table (origin, channel, id and norms).
    """
    from galley.operators.evaluate import channel_norm

    rows = kpis.where(F.col("id").isin(*[k for _, k, _ in fixed.JUDGES]))
    case_rubric = F.create_map(*[F.lit(x) for r, k, _ in fixed.JUDGES for x in (k, r)])
    case_values = F.create_map(*[F.lit(x) for _, k, s in fixed.JUDGES for x in (k, allowed_values(s))])
    texts = rubrics or {}
    pairs = join_skewed(runs, rows, ["origin", "channel"], ["run_id"], rows=100_000).withColumn(
        "rubric", F.element_at(case_rubric, F.col("id"))
    )
    wording = F.concat(
        F.lit("**"), F.col("rubric"), F.lit(".** No detailed rubric was registered — judge on the name alone.")
    )
    if texts:
        known = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
        wording = F.coalesce(F.try_element_at(known, F.col("rubric")), wording)
    norm = F.nullif(channel_norm(F.col("channel")), F.lit(""))
    block = F.when(norm.isNull(), "").otherwise(
        F.concat(F.lit("Bank norm for this KPI ("), F.col("channel"), F.lit(" channel):\n  "), norm, F.lit("\n\n"))
    )
    message = F.concat(
        F.lit("Rubric:\n"), wording, F.lit("\n\n"), block, F.lit("User query:\n  "), F.col("refined_prompt"),
        F.lit("\n\nRetrieved evidence:\n"), judging_sources(F.col("snippets")), F.lit("\n\nGenerated draft:\n"),
        F.col("body"), F.lit("\n\nAllowed indicator values: "), F.element_at(case_values, F.col("id")),
        F.lit("\nReturn one of those values plus a one-sentence reason."),
    )
    return pairs.select("run_id", F.col("id").alias("kpi_id"), "rubric", message.alias("message"))
