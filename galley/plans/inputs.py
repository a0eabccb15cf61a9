"""Inputs derived from the given tables.

The tables hold plain pseudo-words, so markdown, front matter, hint phrases
and replies are added by arithmetic on ids and concatenation. Each derivation
is a list of expressions in SQL that Spark and DuckDB both read, so the two
sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.scale import spread
from galley.plans.registry import table, view

NL = "chr(10)"
HALF = "cast(floor(length(text) / 2) as int)"

TOPIC = (
    "case doc_id % 5 when 0 then 'Cybersecurity in TMT' when 1 then 'Retail media outlook' "
    "when 2 then 'Cloud software costs' when 3 then 'Digital Services Act' else 'Market trends' end"
)
TAG = (
    "case doc_id % 5 when 0 then 'Cybersecurity' when 1 then 'Retail media' when 2 then 'Cloud' "
    "when 3 then 'DSA' else 'Trends' end"
)

ARTICLES = {
    "doc_id": "doc_id",
    "corpus": (
        "case lang when 'en' then 'corpus_en' when 'fr' then 'corpus_nl' "
        "when 'de' then 'writing_guide' else 'schrijfwijzer' end"
    ),
    "lang": "case when lang in ('en', 'de') then 'en' else 'nl' end",
    "slug": "'doc-' || lpad(cast(doc_id as string), 9, '0')",
    "raw": (
        f"'---' || {NL} || 'title: \"' || {TOPIC} || ' ' || doc_id || '\"' || {NL}"
        f" || 'source: \"https://example.org/a/' || doc_id || '\"' || {NL}"
        f" || 'lang: \"' || lang || '\"' || {NL}"
        f" || 'published: ' || (2015 + doc_id % 9) || '-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10) || {NL}"
        f" || 'author:' || {NL} || '  - \"[[Author ' || (doc_id % 7) || ']]\"' || {NL}"
        f" || case when doc_id % 3 = 0 then '' else 'description: \"About [[' || {TOPIC} || ']] by ' || source || '\"' || {NL} end"
        f" || 'tag:' || {NL} || '  - \"[[' || {TAG} || ']]\"' || {NL} || '  - \"[[' || source || ']]\"' || {NL}"
        f" || '---' || {NL} || '# ' || {TOPIC} || ' ' || doc_id || {NL} || {NL}"
        f" || '![cover](https://example.org/i/' || doc_id || '.png)' || {NL}"
        f" || '13/01/20' || (10 + doc_id % 10) || ' • 3 minutes read' || {NL} || {NL}"
        f" || '<iframe src=\"x\"></iframe>' || {NL} || {NL} || {NL}"
        f" || '## Background of ' || source || {NL} || {NL} || substr(text, 1, {HALF}) || {NL} || {NL} || {NL} || {NL}"
        f" || '## Outlook ' || lang || {NL} || substr(text, {HALF} + 1) || {NL}"
        f" || case when doc_id % 4 = 0 then {NL} || '## Lees meer' || {NL} || '- more' || {NL}"
        f" when doc_id % 4 = 1 then {NL} || '## Read more in' || {NL} || 'x' || {NL} || '## Meer informatie' || {NL} else '' end"
    ),
}

GUIDES = {
    "doc_id": "doc_id",
    "lang": "case when lang in ('en', 'de') then 'en' else 'nl' end",
    "raw": (
        f"replace(text, {NL}, {NL} || (doc_id % 90) || ' ' || {NL} || chr(12) || 'Guide 2025' || {NL}"
        f" || case doc_id % 3 when 0 then 'Structuur' when 1 then '2.1 Tone' else '7 8' end || {NL} || {NL})"
    ),
    "marked": (
        "'## Page 1: Start of ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10)"
        " || '## Page ' || (2 + doc_id % 5) || ':  Part ' || lang || ' ' || chr(10))"
    ),
}

#: Requests from the benchmark texts: what retrieval is asked for.
VERB = (
    "case item_id % 5 when 0 then 'Write a draft article about ' when 1 then 'Translate to Dutch the text on ' "
    "when 2 then 'Search related reports on ' when 3 then 'Check compliance and quality of ' "
    "else 'Renew the old article on ' end"
)
ASK = (
    "case item_id % 4 when 0 then 'cybersecurity in TMT' when 1 then 'retail media' "
    "when 2 then 'cloud software' else 'market trends' end"
)
REQUESTS = {
    "run_id": "item_id",
    "user_prompt": (
        f"{VERB} || {ASK} || ' for the companies. ' || text"
        " || case item_id % 6 when 0 then ' The output must be in English' when 1 then ' Schrijf het in het Nederlands' else '' end"
    ),
    "output_language": "case when item_id % 11 = 10 then 'both' else null end",
    "k": "cast(3 + item_id % 5 as int)",
    "backend": "case when item_id % 3 = 0 then 'pageindex' else 'vector_rag' end",
    "refinement_policy": "case when item_id % 2 = 0 then 'ask_first' else 'skip' end",
}

#: Requests from the user turns of conversations: a larger set for the text rules.
CHATS = {
    "run_id": "conv_id * 1000 + turn",
    "user_prompt": (
        "case (conv_id + turn) % 9 when 0 then 'Write a report in English on Agentic AI for Dutch companies. '"
        " when 1 then 'Schrijf een analyse over cyberveiligheid voor de bedrijven. '"
        " when 2 then 'Vertaal het artikel naar het Nederlands. '"
        " when 3 then 'Search the corpus for retail media and SaaS and check the KPI list. '"
        " when 4 then 'Renew old article: Digital Services Act, both English and Dutch. '"
        " when 5 then 'What about digital media and media monetisation for the suppliers? '"
        " when 6 then 'Draft must be written in Dutch. Draft a text in English on chip-industrie. '"
        " when 7 then 'Draft a text in English. The final draft is in Dutch. ' else '' end || text"
    ),
    "output_language": "case when (conv_id + turn) % 13 = 0 then 'en' else null end",
    "refinement_policy": "case when turn % 4 = 0 then 'ask_first' else 'skip' end",
}

#: Drafts from documents: a body with every shape the checks look at.
DRAFTS = {
    "run_id": "doc_id",
    "body": (
        f"case when doc_id % 10 = 9 then '' else '# ' || {TOPIC} || ' by ' || source || {NL} || {NL} end"
        f" || case when doc_id % 10 = 8 then '# Second title' || {NL} else '' end"
        f" || substr(text, 1, {HALF}) || {NL} || {NL}"
        f" || case doc_id % 4 when 0 then 'The plan was approved by the companies and was rewritten. '"
        f" when 1 then 'Het plan wordt door de bedrijven voor klanten niet gebruikt. '"
        f" when 2 then 'You can use the cloud and retail media with your customers. ' else '' end || {NL} || {NL}"
        f" || '## More on ' || {TOPIC} || {NL} || {NL}"
        f" || repeat('- a point of note' || {NL}, cast(doc_id % 8 as int)) || {NL}"
        f" || '![' || case when doc_id % 3 = 0 then '' else 'chart' end || '](img' || doc_id || '.png)' || {NL}"
        f" || repeat('See [the page](https://example.org/p). ', cast(doc_id % 5 as int))"
        f" || 'Evidence [' || (1 + doc_id % 7) || '] and [2]. ' || {NL}"
        f" || '* one' || {NL} || '* two' || {NL} || '* three' || {NL} || {NL}"
        f" || 'Use `code here` *now*. ' || substr(text, {HALF} + 1)"
    ),
    "channel": (
        "case doc_id % 5 when 0 then 'web' when 1 then 'chat' when 2 then 'messages' "
        "when 3 then 'employee' else 'app_ib' end"
    ),
    "origin": "case doc_id % 3 when 0 then 'instant' when 1 then 'genai_knowledge' else 'human' end",
    "language": (
        "case doc_id % 6 when 0 then 'en' when 1 then 'nl' when 2 then 'both' when 3 then null else 'en' end"
    ),
    "strict_mode": "doc_id % 7 = 0",
    "n_snippets": "cast(doc_id % 6 as int)",
    "n_citations": "cast(doc_id % 4 as int)",
}


def select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])


def as_view(name: str, source: str, exprs: dict[str, str], where: str = "") -> None:
    cols = ", ".join(f"{e} as {n}" for n, e in exprs.items())
    view(name, f"select {cols} from {source}" + (f" where {where}" if where else ""))


as_view("articles_in", "documents", ARTICLES)
as_view("guides_in", "documents", GUIDES)
as_view("requests_in", "benchmark", REQUESTS)
as_view("chats_in", "conversations", CHATS, "role = 'user'")
as_view("drafts_in", "documents", DRAFTS)


def articles(spark: SparkSession, sf: str, even: bool = True) -> DataFrame:
    """The articles; ``even`` spreads them over all cores, which who deals them out anyway does not need."""
    documents = table(spark, sf, "documents")
    return select(spread(documents) if even else documents, ARTICLES)


def guides(spark: SparkSession, sf: str) -> DataFrame:
    return select(spread(table(spark, sf, "documents")), GUIDES)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return select(table(spark, sf, "benchmark"), REQUESTS)


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return select(spread(table(spark, sf, "conversations").where("role = 'user'")), CHATS)


def drafts_base(spark: SparkSession, sf: str) -> DataFrame:
    return select(spread(table(spark, sf, "documents")), DRAFTS)
