"""Refinement turns over user requests, and drafts from retrieved snippets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from galley import fixed
from galley.operators import drafts as D
from galley.operators import evaluate as G
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import refine as X
from galley.operators import retrieval as R
from galley.plans import assets, inputs, retrieval_queries
from galley.plans import sqltext as Q
from galley.plans.intent_queries import intent_views, profile_views
from galley.plans.registry import VIEWS, query, view
from galley.session import cut_lineage

# ---- derived answers ------------------------------------------------------

ANSWERS = {
    "run_id": "run_id",
    "question": "case run_id % 3 when 0 then 'Which topic?? ' when 1 then 'Which language?' else 'Scope' end",
    "answer": (
        "case run_id % 5 when 0 then ' ' when 1 then 'retail media and DSA in Dutch' when 2 then 'check the KPI list' "
        "when 3 then 'keep it' else ' cloud software, billboards ' end"
    ),
}
inputs.as_view("answers_in", "chats_in", ANSWERS, "run_id % 4 <> 0")
view("o_chat_counts", "select *, (run_id % 5)::BIGINT as snippet_count from o_chat_intent")


def answers_of(df):
    rows = inputs.select(df.where("run_id % 4 <> 0"), ANSWERS)
    return rows.select("run_id", F.array(F.struct("question", "answer")).alias("answers"))


def chat_rows(spark, sf):
    return I.classify(inputs.chats(spark, sf)).withColumn("snippet_count", F.col("run_id") % 5)


# ---- check SQL ------------------------------------------------------------

_DUTCH = "coalesce(coalesce(prompt_language, language) = 'nl', false)"


def _ask(kind: str) -> str:
    return (
        f"case when {_DUTCH} then {Q.lit(fixed.QUESTION_WORDING[kind]['nl'][0].format(product=X.PRODUCT) + '=' + '/'.join(fixed.QUESTION_WORDING[kind]['nl'][1]))} "
        f"else {Q.lit(fixed.QUESTION_WORDING[kind]['en'][0].format(product=X.PRODUCT) + '=' + '/'.join(fixed.QUESTION_WORDING[kind]['en'][1]))} end"
    )


view(
    "o_questions",
    f"""select run_id, case when len(asked) = 0 then [{_ask('scope')}] else asked[1:3] end as asked from (
  select *, list_filter([case when language is null then {_ask('language')} end,
    case when not contains(lower(array_to_string(topic_keywords, '|')), 'audience') then {_ask('audience')} end,
    case when snippet_count = 0 then {_ask('sources')} end], lambda q: q is not null) as asked from o_chat_counts)""",
)
view(
    "o_turn",
    f"""select c.*, coalesce(trim(a.answer) <> '', false) as answered,
  case when a.answer is not null and trim(a.answer) <> '' then {Q.strip('c.user_prompt')} || chr(10) || chr(10) ||
    case when coalesce(prompt_language, language) = 'nl' then 'Verduidelijkingen:' else 'Clarifications:' end || chr(10) ||
    '- ' || rtrim(trim(a.question), '?') || ': ' || trim(a.answer) else {Q.strip('c.user_prompt')} end as refined,
  refinement_policy = 'ask_first' and a.run_id is null as ask
from o_chat_counts c left join answers_in a on a.run_id = c.run_id""",
)
view("o_refined_in", "select run_id, refined as user_prompt, null::VARCHAR as output_language from o_turn")
intent_views("o_ref", "o_refined_in")


def _pivot(a: str, b: str) -> str:
    return (
        f"(len(list_filter({a}.task_codes, lambda c: not list_contains({b}.task_codes, c))) > 0 or "
        f"len(list_filter({b}.task_codes, lambda c: not list_contains({a}.task_codes, c))) > 0 or "
        f"coalesce({a}.sector, '') <> coalesce({b}.sector, '') or coalesce("
        f"len(list_intersect({a}.topic_keywords, {b}.topic_keywords)) / nullif(len(list_distinct({a}.topic_keywords || {b}.topic_keywords)), 0) < 0.5, false))"
    )


# ---- queries --------------------------------------------------------------


@query(
    "conversation_language",
    "select run_id, coalesce(prompt_language, language, '-') as conversation_language from o_chat_intent",
)
def conversation_language(spark, sf):
    return chat_rows(spark, sf).select(
        "run_id",
        F.coalesce(X.conversation_language(F.col("user_prompt"), F.col("language")), F.lit("-")).alias("conversation_language"),
    )


def _show_questions(c):
    return F.array_join(
        F.transform(c, lambda q: F.concat(q["question"], F.lit("="), F.array_join(q["choices"], "/"))), "|"
    )


@query("questions", "select run_id, array_to_string(asked, '|') as questions from o_questions")
def questions(spark, sf):
    rows = chat_rows(spark, sf).withColumn(
        "conversation_language", X.conversation_language(F.col("user_prompt"), F.col("language"))
    )
    return rows.select("run_id", _show_questions(X.questions()).alias("questions"))


def refined(spark, sf):
    rows = chat_rows(spark, sf)
    return X.refine(rows, answers_of(rows))


_SAID = "run_id % 6 between 2 and 5"
_PROPOSED = "case run_id % 6 when 2 then ' New prompt on retail media ' when 5 then 'X' else '' end"


@query(
    "refine_replies",
    f"""select t.run_id, case when t.{_SAID} then 'llm' else 'deterministic' end as source, not ask or t.run_id % 6 = 2 as done,
  case when not ask then '' when t.{_SAID} then case when t.run_id % 6 = 3 then 'Q1=a/b/c/d|Q2=' else '' end
    else array_to_string(asked, '|') end as questions,
  md5(case when t.{_SAID} and proposed <> '' then case when ask then proposed else trim(proposed) end
    when ask then {Q.strip('t.user_prompt')} else refined end) as refined_md5,
  case when t.run_id % 6 = 2 then 'because' when t.{_SAID} then case when ask then '{fixed.MODEL_ASK_NOTE}' else '{fixed.MODEL_LOCK_NOTE}' end
    when t.run_id % 6 = 1 then case when ask then '{fixed.ASK_FAILED_NOTE}' else '{fixed.LOCK_FAILED_NOTE}' end || 'boom'
    when ask then '{fixed.ASK_NOTE}' else '{fixed.LOCK_NOTE}' end as reasoning
from (select *, {_PROPOSED} as proposed from o_turn) t join o_questions q on q.run_id = t.run_id""",
)
def refine_replies(spark, sf):
    """Good, broken and missing replies of a model."""
    rows = chat_rows(spark, sf)
    kind = F.col("run_id") % 6
    four = F.expr(
        "array(named_struct('question', 'Q1', 'choices', array('a', ' ', 'b', 'c', 'd', 'e')), "
        "named_struct('question', ' ', 'choices', array('x')), named_struct('question', 'Q2', 'choices', cast(array() as array<string>)), "
        "named_struct('question', 'Q3', 'choices', array('y')))"
    )
    replies = rows.where(kind != 0).select(
        "run_id",
        F.when(kind == 3, four).otherwise(F.array().cast(X.QUESTIONS)).alias("questions"),
        F.expr(_PROPOSED).alias("proposed_prompt"), kind.isin(2, 3).alias("done"),
        F.when(kind == 2, "because").when(kind == 4, "").alias("reasoning"), F.when(kind == 1, "boom").alias("error"),
    )
    done = X.refine(rows, answers_of(rows), replies=replies)
    return done.select(
        "run_id", "source", "done", _show_questions(F.col("questions")).alias("questions"),
        F.md5("refined_prompt").alias("refined_md5"), "reasoning",
    )


@query("apply_answers", "select run_id, case when ask then trim(user_prompt, " + Q.WS + ") else refined end as refined_prompt from o_turn")
def apply_answers(spark, sf):
    return refined(spark, sf).select("run_id", "refined_prompt")


@query(
    "pivot",
    f"""select t.run_id, not t.ask and {_pivot('t', 'n')} as pivot, array_to_string(n.task_codes, ',') as new_task_codes,
  coalesce(n.language, '-') as new_language from o_turn t join o_ref_intent n on n.run_id = t.run_id""",
)
def pivot(spark, sf):
    return refined(spark, sf).select(
        "run_id", F.col("needs_re_retrieval").alias("pivot"), F.array_join("new_task_codes", ",").alias("new_task_codes"),
        F.coalesce("new_language", F.lit("-")).alias("new_language"),
    )


@query(
    "run_status",
    """select run_id, case when ask then 'needs_clarification' else 'completed' end as status, not ask as done,
  (case when ask then (select len(asked) from o_questions q where q.run_id = t.run_id) else 0 end)::BIGINT as questions from o_turn t""",
)
def run_status(spark, sf):
    return refined(spark, sf).select(
        "run_id", X.run_status().alias("status"), "done", F.size("questions").cast("bigint").alias("questions")
    )


#: Questions proposed from outside, as JSON made from the chats.
PROPOSED = (
    "'[{\"question\":\" Which length? \",\"choices\":[\"short\",\" \",\"long\",\"a\",\"b\",\"c\",\"d\",\"e\"]},'"
    " || '{\"question\":\"\",\"choices\":[\"x\"]},{\"question\":\"Select all topics ' || run_id || '\",\"choices\":[\" cloud \"]},'"
    " || '{\"question\":\"Tone\",\"choices\":[]},{\"question\":\"Five\",\"choices\":[\"y\"]},{\"question\":\"Six\",\"choices\":[\"z\"]}]'"
)
_KEPT = "list_filter({c}, lambda c: trim(c) <> '')"


@query(
    "question_normalise",
    f"""select run_id,
  array_to_string(list_transform(list_filter(qs[1:3], lambda q: trim(q.question) <> ''), lambda q: q.question || '=' || array_to_string(list_filter(q.choices, lambda c: trim(c) <> '')[1:4], '/')), '|') as service,
  array_to_string(list_transform(list_filter(qs, lambda q: trim(q.question) <> '')[1:5], lambda q: trim(q.question) || '=' ||
    array_to_string(list_filter(list_transform(q.choices, lambda c: trim(c)), lambda c: c <> '')[1:6], '/') ||
    case when {Q.any_in('lower(q.question)', fixed.MULTIPLE_PHRASES)} then '*' else '' end), '|') as chat
from (select run_id, from_json({PROPOSED}, '[{{"question":"VARCHAR","choices":["VARCHAR"]}}]') as qs from chats_in)""",
)
def question_normalise(spark, sf):
    rows = inputs.chats(spark, sf).select(
        "run_id", F.from_json(F.expr(PROPOSED), X.QUESTIONS).alias("asked")
    )
    chat = F.array_join(
        F.transform(
            X.normalise_chat(F.col("asked")),
            lambda q: F.concat(q["question"], F.lit("="), F.array_join(q["choices"], "/"), F.when(q["multiple"], "*").otherwise("")),
        ),
        "|",
    )
    return rows.select("run_id", _show_questions(X.normalise_service(F.col("asked"))).alias("service"), chat.alias("chat"))


#: Assistant turns with clarification forms in front of the text.
FORMS = {
    "run_id": "conv_id * 1000 + turn",
    "content": (
        "case when turn % 3 = 0 then '' when turn % 3 = 1 then 'I have a few clarifying questions before drafting:' || chr(10) || chr(10)"
        " else 'Preferred tone?' || chr(10) || 'Formal: always' || chr(10) end"
        " || case when conv_id % 4 = 0 then '1) Which aspects of item ' || conv_id || ' matter? (pick one or more)' || chr(10) || 'A) First' || chr(10)"
        " || '- second option' || chr(10) || '3. third' || chr(10) || '* e' || chr(10) || 'Choose one of these' || chr(10) || 'Desired length:' || chr(10) || 'B: ~500 words' || chr(10)"
        " when conv_id % 4 = 1 then 'What specific parts:' || chr(10) || 'Tone' || chr(10) || 'Formal' || chr(10) || '(note)' || chr(10) || 'Select all topics?' || chr(10) || 'x' || chr(10)"
        " else '' end || text || chr(10) || 'Please reply with your choices.'"
    ),
}
inputs.as_view("forms_in", "conversations", FORMS, "role = 'assistant'")


def _starts(x: str, heads) -> str:
    return "(" + " or ".join(f"starts_with({x}, {Q.lit(h)})" for h in heads) + ")"


def _instr_sql(x: str) -> str:
    return _starts(f"trim(lower({x}))", fixed.INSTRUCTION_STARTS)


def _q_sql(x: str) -> str:
    c = rf"rtrim(trim(regexp_replace({x}, '^[0-9]+[).:-]\s*', '')), ':')"
    return (
        f"case when {c} <> '' and not {_instr_sql(c)} and (contains({c}, '?') or (length({c}) <= 90 and not {_starts(f'lower({c})', fixed.HEADING_STARTS_BARRED)} "
        f"and (lower({c}) in ({', '.join(Q.lit(h) for h in fixed.HEADINGS)}) or {_starts(f'lower({c})', fixed.HEADING_STARTS)}))) then {c} end"
    )


_LAB = r"^(?:[-*]\s*)?(?:[A-Za-z]|[0-9]+)[).:]\s*(.+)$"
_BUL = r"^[-*]\s+(.+)$"
view(
    "o_form_lines",
    f"""select *, {_q_sql('l')} as q, case when regexp_matches(l, '{_LAB}') then trim(regexp_extract(l, '{_LAB}', 1))
  when regexp_matches(l, '{_BUL}') then trim(regexp_extract(l, '{_BUL}', 1)) else l end as o0 from (
  select run_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as i from (
    select run_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls
    from forms_in where {Q.any_in('lower(content)', fixed.FORM_PHRASES)}))""",
)
view(
    "o_form_groups",
    f"""select *, sum((q is not null)::int) over (partition by run_id order by i) as g,
  case when q is null and o0 <> '' and not {_instr_sql('l')} and ({_q_sql('o0')}) is null then o0 end as o from o_form_lines""",
)


@query(
    "extract_questions",
    f"""select run_id, question, array_to_string(choices[1:6], '/') as choices, {Q.any_in('lower(question)', fixed.MULTIPLE_PHRASES)} as multiple from (
  select run_id, g, any_value(q) as question, coalesce(list(o order by i) filter (where o is not null), []) as choices
  from o_form_groups where g between 1 and 5 group by all) where len(choices) > 0""",
)
def extract_questions(spark, sf):
    base = inputs.spread(inputs.table(spark, sf, "conversations").where("role = 'assistant'"))
    found = X.extract_questions(F.col("content"))
    rows = inputs.select(base, FORMS).select("run_id", found.alias("qs"))
    return (
        rows.select("run_id", F.posexplode_outer("qs").alias("i", "q")).where(F.col("q").isNotNull())
        .select("run_id", "q.question", F.array_join("q.choices", "/").alias("choices"), "q.multiple")
    )


_ZIPPED = "case run_id % 3 when 0 then 'yes' when 1 then ' ' else 'later' end || '#' || case run_id % 2 when 0 then 'no' else '' end"


@query(
    "answers_zip",
    f"""select run_id, array_to_string(list_filter(list_transform(range(1, least(len(asked), 2) + 1), lambda i:
    case when trim(string_split({_ZIPPED}, '#')[i]) <> '' then string_split(asked[i], '=')[1] || '>' || trim(string_split({_ZIPPED}, '#')[i]) end),
    lambda x: x is not null), '|') as answers from o_questions""",
)
def answers_zip(spark, sf):
    rows = chat_rows(spark, sf).withColumn(
        "conversation_language", X.conversation_language(F.col("user_prompt"), F.col("language"))
    ).withColumn("asked", X.questions())
    pairs = X.zip_answers(F.col("asked"), F.split(F.expr(_ZIPPED), "#"))
    return rows.select(
        "run_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["question"], F.lit(">"), p["answer"])), "|").alias("answers")
    )


# ---- drafts over the retrieved snippets -----------------------------------


def _renamed(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\bo_\w+\b", lambda m: names.get(m.group(0), m.group(0)), sql)


#: The retrieval views again, for the pivoted requests.
view(
    "p_turn",
    f"""select r.*, {Q.strip('user_prompt')} || case when a.answer is not null and trim(a.answer) <> '' then chr(10) || chr(10) ||
    case when coalesce(prompt_language, language) = 'nl' then 'Verduidelijkingen:' else 'Clarifications:' end || chr(10) ||
    '- ' || rtrim(trim(a.question), '?') || ': ' || trim(a.answer) else '' end as refined,
  refinement_policy = 'ask_first' and a.run_id is null as ask
from o_req_intent r left join (select {", ".join(f"{e} as {n}" for n, e in ANSWERS.items())} from requests_in where run_id % 4 <> 0) a on a.run_id = r.run_id""",
)
view("p_refined_in", "select run_id, refined as user_prompt, null::VARCHAR as output_language, k, backend from p_turn")
intent_views("p_all", "p_refined_in")
view(
    "p_req_intent",
    f"select n.* from p_all_intent n join p_turn t on n.run_id = t.run_id where not t.ask and {_pivot('t', 'n')}",
)
profile_views("p_req")
_SHARED = (
    "o_query", "o_routed", "o_flags", "o_kw_scores", "o_kw_best", "o_qvec", "o_dots", "o_vec_best",
)
_NAMES = {n: "p" + n[1:] for n in (*_SHARED, "o_req_profiles", "o_req_intent")}
for _n in _SHARED:
    view(_NAMES[_n], _renamed(VIEWS[_n], _NAMES))


def request_turns(spark, sf):
    """Refined requests of the benchmark with their first retrieval."""
    rows = retrieval_queries.selected(spark, sf).withColumn("snippet_count", F.lit(1).cast("bigint"))
    return cut_lineage(X.refine(rows, answers_of(rows)))


_AGAIN = _renamed(retrieval_queries._RETRIEVED, _NAMES)
_SHOWN = "run_id, rank, source_doc, node_id, score, reason"


@query(
    "rerun_on_pivot",
    f"""select {_SHOWN}, false as again from ({retrieval_queries._RETRIEVED}) where run_id not in (select run_id from p_req_intent)
union all select {_SHOWN}, true from ({_AGAIN})""",
)
def rerun_on_pivot(spark, sf):
    nodes, chunks = assets.nodes(spark, sf), assets.chunks(spark, sf)
    first, _ = R.retrieve(retrieval_queries.queries_of(spark, sf), nodes, chunks)
    rows = X.rerun_on_pivot(request_turns(spark, sf), first, nodes, chunks, retrieval_queries.AVAILABLE)
    return rows.select("run_id", F.col("rank").cast("bigint").alias("rank"), "source_doc", "node_id", "score", "reason", "again")


view(
    "o_snips",
    """select b.run_id, b.rank, b.corpus as source_doc, c.node_id, c.title, c.article_title, c.content, c.line_num, b.rel as score,
  'sparse vector overlap: ' || array_to_string(b.terms[1:8], ', ') as reason,
  c.source_url from o_vec_best b join o_chunks c on c.id = b.id""",
)
_REPLY = (
    "case run_id % 6 when 0 then '```json' || chr(10) || '{\"draft\":\"Body [1]\",\"citation_indices\":[2,1,99,\"3\",2.5]}' || chr(10) || '```'"
    " when 1 then '{\"body\":\"  \",\"text\":\"Late text\",\"citation_indices\":[0]}' when 2 then '{\"body\":7}' when 3 then 'broken'"
    " when 4 then '{\"markdown\":\"Some [2] text\"}' else '{\"body\":\"\"}' end"
)


def snippets(spark, sf):
    return R.topk_vector(retrieval_queries.queries_of(spark, sf), assets.chunks(spark, sf))


def runs(spark, sf):
    """Requests with profiles and their snippets as arrays."""
    rows = retrieval_queries.selected(spark, sf).withColumn("refined_prompt", F.col("user_prompt"))
    return rows.join(D.snippet_arrays(snippets(spark, sf)), "run_id", "left")


def run_replies(spark, sf):
    return inputs.select(inputs.requests(spark, sf).where("run_id % 7 <> 6"), {"run_id": "run_id", "draft_reply": _REPLY})


_CITE = "run_id, n::BIGINT as n, source_doc, node_id, title, article_title, source_url"


def _cited(df):
    return (
        df.select("run_id", F.posexplode_outer("c").alias("i", "c")).where(F.col("c").isNotNull())
        .select("run_id", F.col("i").cast("bigint").alias("place"), F.col("c.index").cast("bigint").alias("n"),
                *[F.col(f"c.{x}").alias(x) for x in ("source_doc", "node_id", "title", "article_title", "source_url")])
    )


@query("citations", f"select {_CITE} from (select *, rank as n from o_snips where rank <= 5)")
def citations(spark, sf):
    arrays = D.snippet_arrays(snippets(spark, sf))
    return _cited(arrays.select("run_id", D.citations(F.col("snippets")).alias("c"))).drop("place")


view(
    "o_parsed_reply",
    f"""select run_id, j, case {" ".join(f"when json_type(j, '$.{k}') = 'VARCHAR' and trim(j ->> '$.{k}') <> '' then j ->> '$.{k}'" for k in fixed.REPLY_BODY_KEYS)} end as body
from (select run_id, case when json_valid(t) then t::JSON end as j from (
  select run_id, case when r like '```%' then {Q.strip("regexp_replace(trim(r, '`'), '^json', '')")} else r end as t
  from (select run_id, {_REPLY} as r from requests_in where run_id % 7 <> 6)))""",
)
view(
    "o_indices",
    """select run_id, place, n from (
  select run_id, generate_subscripts(l, 1) as place, unnest(l) as n from (
    select run_id, list_transform(list_filter(string_split(trim(j -> '$.citation_indices', '[]'), ','), lambda x: regexp_matches(x, '^\\s*-?[0-9]+\\s*$')), lambda x: x::BIGINT) as l
    from o_parsed_reply where body is not null))""",
)
view(
    "o_chosen",
    """select i.run_id, i.n, i.place, s.* exclude (run_id) from o_indices i join o_snips s on s.run_id = i.run_id and s.rank = i.n""",
)
view(
    "o_draft_cites",
    """select run_id, n, source_doc, node_id, title, article_title, source_url from o_chosen
union all select run_id, rank, source_doc, node_id, title, article_title, source_url from o_snips where rank <= 5 and run_id not in (select run_id from o_chosen)""",
)


@query("citations_from_indices", f"select {_CITE} from o_draft_cites")
def citations_from_indices(spark, sf):
    drafted = D.draft(runs(spark, sf), run_replies(spark, sf))
    return _cited(drafted.select("run_id", F.col("citations").alias("c"))).drop("place")


@query(
    "parse_reply",
    """select r.run_id, coalesce(p.body, '-') as body, p.body is not null as usable from requests_in r left join o_parsed_reply p on p.run_id = r.run_id""",
)
def parse_reply(spark, sf):
    rows = inputs.requests(spark, sf).select("run_id").join(run_replies(spark, sf), "run_id", "left")
    body = D.reply_body(F.col("draft_reply"))
    return rows.select("run_id", F.coalesce(body, F.lit("-")).alias("body"), body.isNotNull().alias("usable"))


_REF = "'[' || article_title || '](' || source_url || ')'"
_REF2 = "'[' || replace(replace(article_title, '[', '\\['), ']', '\\]') || '](' || source_url || ')'"


@query("source_reference", f"select run_id, rank, {_REF} as reference, {_REF2} as report_reference from o_snips")
def source_reference(spark, sf):
    rows = snippets(spark, sf)
    s = F.struct("article_title", "title", "source_doc", "source_url")
    return rows.select(
        "run_id", F.col("rank").cast("bigint").alias("rank"), D.source_reference(s).alias("reference"),
        D.report_reference(s).alias("report_reference"),
    )


_NAMES_OF = "map {" + ", ".join(f"'{p['id']}': {Q.lit(p['name'])}" for p in fixed.PROFILES) + "}"


def _body_sql(lang: str) -> str:
    w = {k: v.format(product="Editorial", guide="schrijfwijzer" if lang == "nl" else "writing guide") for k, v in fixed.DRAFT_WORDING[lang].items()}
    gap = "chr(10) || chr(10)"
    return (
        f"'# ' || {Q.lit(w['title'])} || case when len(topic_keywords) > 0 then ': ' || topic_keywords[1] else '' end || {gap} || {Q.lit(w['intro'])} || {gap} || "
        f"{Q.lit(w['instruction'])} || {gap} || user_prompt || {gap} || {Q.lit(w['profiles'])} || {gap} || "
        f"coalesce(nullif(array_to_string(list_transform(workflow_ids || expert_ids, lambda i: {_NAMES_OF}[i]), ', '), ''), {Q.lit(w['no_profile'])}) || {gap} || "
        f"{Q.lit(w['sources'])} || {gap} || coalesce(refs, {Q.lit(w['no_source'])}) || {gap} || {Q.lit(w['outro'])}"
    )


view(
    "o_bodies",
    f"""select p.run_id, case when language = 'nl' then {_body_sql('nl')} else {_body_sql('en')} end as body
from o_req_profiles p left join (select run_id, string_agg('- [' || rank || '] ' || {_REF}, chr(10) order by rank) as refs
  from o_snips where rank <= 5 group by 1) s on s.run_id = p.run_id""",
)


@query("template_draft", "select run_id, body from o_bodies")
def template_draft(spark, sf):
    return D.draft(runs(spark, sf)).select("run_id", "body")


@query(
    "source_list",
    f"""select r.run_id, coalesce(chr(10) || chr(10) || '**Sources**' || chr(10) || chr(10) || l, '') as sources from requests_in r left join (
  select run_id, string_agg(line, chr(10) order by place) as l from (
    select run_id, '- [' || n || '] ' || {_REF2} as line, min(place) as place from o_chosen
    group by all) group by 1
  union all select run_id, string_agg('- [' || rank || '] ' || {_REF2}, chr(10) order by rank) from o_snips
    where rank <= 5 and run_id not in (select run_id from o_chosen) group by 1) s on s.run_id = r.run_id""",
)
def source_list(spark, sf):
    drafted = D.draft(runs(spark, sf), run_replies(spark, sf))
    # the report has the numbers of the citations, and takes the rest from the snippets
    bare = F.transform(
        "citations",
        lambda c: F.struct(
            c["index"].alias("index"),
            *[F.lit(None).cast("string").alias(n) for n in ("source_doc", "title", "article_title", "source_url")],
        ),
    )
    return drafted.select("run_id", D.source_list(bare, F.col("snippets")).alias("sources"))


_LINE = "replace(trim(content), chr(10), ' ')"


@query(
    "prompt_tables",
    f"""select r.run_id,
  coalesce(string_agg('[' || rank || '] ' || {_REF} || chr(10) || substr(content, 1, 1200), chr(10) order by rank) filter (where rank <= 8), '') as drafting,
  coalesce(string_agg('- [' || source_doc || '::' || node_id || '] ' || title || chr(10) || '  reason=' || reason || chr(10) || '  excerpt=' || substr({_LINE}, 1, 240), chr(10) order by rank) filter (where rank <= 5), '(no snippets retrieved)') as refining,
  coalesce(string_agg('[' || rank || '] ' || title || ' (' || source_doc || '::' || node_id || ')' || chr(10) || '    ' || substr({_LINE}, 1, 600) || case when length({_LINE}) > 600 then '…' else '' end, chr(10) order by rank), '(no evidence snippets)') as judging
from requests_in r left join o_snips s on s.run_id = r.run_id group by r.run_id""",
)
def prompt_tables(spark, sf):
    s = F.col("snippets")
    return runs(spark, sf).select(
        "run_id", D.drafting_sources(s).alias("drafting"), D.refinement_sources(s).alias("refining"),
        D.judging_sources(s).alias("judging"),
    )


@query(
    "judging_prompts",
    "select r.run_id, j.kpi_id, j.rubric from requests_in r, (values "
    + ", ".join(f"('{k}', '{r}')" for r, k, _ in fixed.JUDGES)
    + ") j(kpi_id, rubric) where not (r.run_id % 2 = 1 and j.kpi_id = 'groundedness_source')",
)
def judging_prompts(spark, sf):
    """One judging text per draft and judge that applies to it."""
    drafted = D.draft(runs(spark, sf)).withColumns(
        {"origin": F.when(F.col("run_id") % 2 == 1, "human").otherwise("instant"), "channel": F.lit("chat")}
    )
    kpis = spark.createDataFrame(
        [(k["id"], "norm", "chat norm", None, k["relevance"]) for k in G.seed_kpis()],
        "id string, norm string, norm_chat string, norm_messages string, relevance map<string,string>",
    )
    return D.judging_table(drafted, G.applicability(kpis)).where(
        F.contains("message", F.lit("chat norm"))
    ).select("run_id", "kpi_id", "rubric")
