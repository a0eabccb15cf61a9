"""Request understanding and profile matching over the user turns of conversations."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators.scale import join_small
from galley.plans import inputs
from galley.plans import sqltext as Q
from galley.plans.registry import query, view
from galley.sources import files

# ---- derived model replies ------------------------------------------------

REPLIES = {
    "run_id": "run_id",
    "intent_reply": (
        "case run_id % 6 when 0 then '```json' || chr(10) || '{\"role\":\"Editor\",\"task_codes\":[\"T1_SEARCH\"],"
        "\"confidence\":0.9,\"task_reason\":\"model\",\"sector\":null,\"topic_keywords\":[\"cloud\",\"AI\"],"
        "\"language\":\"nl\"}' || chr(10) || '```'"
        " when 1 then '{\"role\":\"Editor\",\"task_codes\":[\"T9_OTHER\"],\"confidence\":0.9,\"task_reason\":\"model\"}'"
        " when 2 then 'no json here'"
        " when 3 then '{\"role\":\"Editor\",\"task_codes\":[\"T2_COMPLIANCE\",\"T1_DRAFT\"],\"confidence\":0.5,"
        "\"task_reason\":\"model\",\"sector\":\"Other\",\"language\":\"both\"}'"
        " when 4 then '{\"task_codes\":[\"T1_DRAFT\"],\"confidence\":0.5}'"
        " else '{\"role\":\"Editor\",\"task_codes\":[\"T4_RENEWAL\"],\"confidence\":1.5,\"task_reason\":\"model\"}' end"
    ),
    "profile_reply": (
        "case run_id % 5 when 0 then '{\"workflow_ids\":[\"reviewer\",\"nobody\",\"curator\"],\"domain_expert_ids\":[],"
        "\"reasons\":{\"reviewer\":\"fits\"}}'"
        " when 1 then '{\"workflow_ids\":[\"nobody\"],\"domain_expert_ids\":[]}'"
        " when 2 then 'broken' when 3 then '{\"workflow_ids\":[],\"domain_expert_ids\":[\"expert_tmt_generalist\"]}'"
        " else '```json' || chr(10) || '{\"workflow_ids\":[\"drafter\"],\"domain_expert_ids\":[\"expert_tmt_media_advertising\",\"drafter\"]}' || chr(10) || '```' end"
    ),
}
inputs.as_view("replies_in", "chats_in", REPLIES, "run_id % 7 <> 0")


def replies(spark, sf):
    return inputs.select(inputs.chats(spark, sf).where("run_id % 7 <> 0"), REPLIES)


# ---- check SQL ------------------------------------------------------------

_TASKS = ", ".join(f"case when {Q.any_in('p', h)} then '{c}' end" for c, h in fixed.TASK_HINTS)


def task_sql(p: str = "p") -> str:
    return f"list_filter([{_TASKS}], lambda c: c is not null)"


def _keyword_hit(k: str) -> str:
    low = k.lower()
    parts = [x for x in re.split(r"[^a-z0-9]+", low) if len(x) >= 3][:2]
    hit = f"contains(p, {Q.lit(low)})"
    if parts:
        hit += " or (" + " and ".join(f"contains(p, {Q.lit(x)})" for x in parts) + ")"
    return f"case when {hit} then {Q.lit(k)} end"


KEYWORDS = (
    "list_filter([" + ", ".join(_keyword_hit(k) for k in I.keyword_vocabulary()) + "]::VARCHAR[], "
    "lambda k: k is not null)"
)
_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.LANGUAGE_NAMES.items()) + "}"


def _last(i: int) -> str:
    p = Q.lit(fixed.TARGET_LANGUAGE[i])
    return (
        f"case when regexp_matches(p, {p}) then "
        f"length(p) - length(regexp_split_to_array(p, {p})[-1]) - length(regexp_extract_all(p, {p}, 0)[-1]) end as at{i}, "
        f"{_NAMES}[regexp_extract_all(p, {p}, 1)[-1]] as lang{i}"
    )


def intent_views(prefix: str, source: str) -> None:
    """Views of the intents of a request table."""
    view(
        f"{prefix}_raw",
        f"""select *, {_last(0)}, {_last(1)},
  {Q.hits("' ' || p || ' '", fixed.PROMPT_SIGNALS['nl'])} as nl,
  {Q.hits("' ' || p || ' '", fixed.PROMPT_SIGNALS['en'])} as en
from (select *, lower(user_prompt) as p from {source})""",
    )
    view(
        f"{prefix}_intent",
        f"""select *, coalesce(output_language, target_language, prompt_language) as language,
  case when task_codes[1] <> 'T1_DRAFT' or contains(p, 'write') then 0.86::DOUBLE else 0.72::DOUBLE end as confidence
from (select *,
  case when len({task_sql()}) = 0 then ['T1_DRAFT'] else {task_sql()} end as task_codes,
  case when {Q.any_in('p', fixed.SECTOR_HINTS)} then {Q.lit(fixed.SECTOR)} end as sector,
  {KEYWORDS} as topic_keywords,
  case when regexp_matches(p, {Q.lit(fixed.BOTH_LANGUAGES)}) or contains(' ' || p || ' ', ' both ') then 'both'
    when at0 is null then lang1 when at1 is null then lang0 when at0 > at1 then lang0 else lang1 end as target_language,
  case when nl >= 2 and nl > en then 'nl' when en >= 2 and en > nl then 'en' end as prompt_language
  from {prefix}_raw)""",
    )


def profile_views(prefix: str) -> None:
    """Views of the profiles of a request table that has an intent view."""
    work = ", ".join(
        f"case when list_has_any(task_codes, {Q.lits(p['codes'])}) then '{p['id']}' end"
        for p in fixed.PROFILES if p["category"] == "workflow"
    )
    experts = ", ".join(
        f"case when sector = {Q.lit(p['sector'])} and (len(topic_keywords) = 0 or list_has_any("
        f"list_transform(topic_keywords, lambda k: lower(k)), {Q.lits(k.lower() for k in p['keywords'])})) then '{p['id']}' end"
        for p in fixed.PROFILES if p["category"] == "domain_expert"
    )
    view(
        f"{prefix}_profiles",
        f"""select *, list_filter([{work}], lambda i: i is not null) as workflow_ids,
  list_filter([{experts}], lambda i: i is not null) as expert_ids from {prefix}_intent""",
    )


intent_views("o_chat", "chats_in")
profile_views("o_chat")
intent_views("o_req", "requests_in")
profile_views("o_req")


# ---- queries --------------------------------------------------------------


def chat_intents(spark, sf):
    return I.classify(inputs.chats(spark, sf))


@query("task_codes", "select run_id, array_to_string(task_codes, ',') as task_codes from o_chat_intent")
def task_codes(spark, sf):
    return inputs.chats(spark, sf).select(
        "run_id", F.array_join(I.task_codes(F.lower("user_prompt")), ",").alias("task_codes")
    )


@query("sector", "select run_id, coalesce(sector, '-') as sector from o_chat_intent")
def sector(spark, sf):
    return inputs.chats(spark, sf).select(
        "run_id", F.coalesce(I.sector(F.lower("user_prompt")), F.lit("-")).alias("sector")
    )


@query("target_language", "select run_id, coalesce(target_language, '-') as target_language from o_chat_intent")
def target_language(spark, sf):
    return inputs.chats(spark, sf).select(
        "run_id",
        F.coalesce(I.target_language(F.lower("user_prompt")), F.lit("-")).alias("target_language"),
    )


@query("prompt_language", "select run_id, coalesce(prompt_language, '-') as prompt_language from o_chat_intent")
def prompt_language(spark, sf):
    return inputs.chats(spark, sf).select(
        "run_id",
        F.coalesce(I.prompt_language(F.lower("user_prompt")), F.lit("-")).alias("prompt_language"),
    )


@query("language", "select run_id, coalesce(language, '-') as language from o_chat_intent")
def language(spark, sf):
    return chat_intents(spark, sf).select(
        "run_id", F.coalesce("language", F.lit("-")).alias("language")
    )


@query("keywords", "select run_id, array_to_string(topic_keywords, '|') as keywords from o_chat_intent")
def keywords(spark, sf):
    return inputs.chats(spark, sf).select(
        "run_id", F.array_join(I.keywords(F.lower("user_prompt")), "|").alias("keywords")
    )


_INTENT_OUT = """run_id, array_to_string(task_codes, ',') as task_codes, coalesce(sector, '-') as sector,
  array_to_string(topic_keywords, '|') as keywords, coalesce(language, '-') as language, confidence"""


def _intent_cols(df):
    return df.select(
        "run_id", F.array_join("task_codes", ",").alias("task_codes"),
        F.coalesce("sector", F.lit("-")).alias("sector"), F.array_join("topic_keywords", "|").alias("keywords"),
        F.coalesce("language", F.lit("-")).alias("language"), "confidence", "task_reason",
        F.col("intent_source").alias("source"), "role",
    )


@query(
    "intent",
    f"""select {_INTENT_OUT}, 'Detected ' || task_codes[1] || ' from keyword and task-shape heuristics.' as task_reason,
  'deterministic' as source, '{fixed.ROLE}' as role from o_chat_intent""",
)
def intent(spark, sf):
    return _intent_cols(chat_intents(spark, sf))


view(
    "o_reply",
    f"""select run_id, case when json_valid(t) then t::JSON end as j from (
  select run_id, case when intent_reply like '```%' then
    {Q.strip("regexp_replace(trim(intent_reply, '`'), '^json', '')")} else intent_reply end as t
  from replies_in)""",
)
view(
    "o_merged",
    """select i.*, j,
  coalesce(j ->> '$.role' is not null and json_array_length(j, '$.task_codes') > 0
    and len(list_filter((j -> '$.task_codes')::VARCHAR[], lambda c: not list_contains(
      ['T1_DRAFT', 'T1_TRANSLATE', 'T1_SEARCH', 'T2_COMPLIANCE', 'T4_RENEWAL'], c))) = 0
    and (j ->> '$.confidence')::DOUBLE between 0 and 1 and j ->> '$.task_reason' is not null, false) as good
from o_chat_intent i left join o_reply r using (run_id)""",
)


@query(
    "intent_merge",
    f"""select run_id,
  case when good then array_to_string((j -> '$.task_codes')::VARCHAR[], ',') else array_to_string(task_codes, ',') end as task_codes,
  case when good then coalesce(j ->> '$.sector', '-') else coalesce(sector, '-') end as sector,
  case when good then coalesce(array_to_string((j -> '$.topic_keywords')::VARCHAR[], '|'), '') else array_to_string(topic_keywords, '|') end as keywords,
  case when good then coalesce(output_language, target_language, j ->> '$.language', '-') else coalesce(language, '-') end as language,
  case when good then (j ->> '$.confidence')::DOUBLE else confidence end as confidence,
  case when good then j ->> '$.task_reason' else 'Detected ' || task_codes[1] || ' from keyword and task-shape heuristics.' end as task_reason,
  case when good then 'llm' else 'deterministic' end as source,
  case when good then j ->> '$.role' else '{fixed.ROLE}' end as role
from o_merged""",
)
def intent_merge(spark, sf):
    return _intent_cols(I.merge_replies(chat_intents(spark, sf), replies(spark, sf)))


# ---- profiles -------------------------------------------------------------


def chat_profiles(spark, sf):
    return P.select_profiles(chat_intents(spark, sf))


@query("match_workflow", "select run_id, unnest(workflow_ids) as profile_id from o_chat_profiles")
def match_workflow(spark, sf):
    return chat_profiles(spark, sf).select("run_id", F.explode(P.ids(F.col("workflow"))).alias("profile_id"))


@query("match_expert", "select run_id, unnest(expert_ids) as profile_id from o_chat_profiles")
def match_expert(spark, sf):
    return chat_profiles(spark, sf).select("run_id", F.explode(P.ids(F.col("domain_expert"))).alias("profile_id"))


@query(
    "profile_bundle",
    "select run_id, array_to_string(workflow_ids || expert_ids, ',') as bundle from o_chat_profiles",
)
def profile_bundle(spark, sf):
    both = F.concat(P.ids(F.col("workflow")), P.ids(F.col("domain_expert")))
    return chat_profiles(spark, sf).select("run_id", F.array_join(both, ",").alias("bundle"))


_KNOWN_W = Q.lits(p["id"] for p in fixed.PROFILES if p["category"] == "workflow")
_KNOWN_D = Q.lits(p["id"] for p in fixed.PROFILES if p["category"] == "domain_expert")


@query(
    "profile_pick_reconcile",
    f"""select run_id, array_to_string(list_transform(case when n > 0 then w || d else workflow_ids || expert_ids end,
    lambda i: i || case when n > 0 then '=' || coalesce(j ->> ('$.reasons.' || i), 'Selected by LLM.') else '' end), ',') as picks,
  case when n > 0 then 'llm' else 'deterministic' end as source
from (select *, len(w) + len(d) as n from (
  select p.run_id, workflow_ids, expert_ids, j,
    coalesce(list_filter((j -> '$.workflow_ids')::VARCHAR[], lambda i: list_contains({_KNOWN_W}, i)), []) as w,
    coalesce(list_filter((j -> '$.domain_expert_ids')::VARCHAR[], lambda i: list_contains({_KNOWN_D}, i)), []) as d
  from o_chat_profiles p left join (
    select run_id, case when json_valid(t) then t::JSON end as j from (
      select run_id, case when profile_reply like '```%' then
        {Q.strip("regexp_replace(trim(profile_reply, '`'), '^json', '')")} else profile_reply end as t from replies_in)) r
  using (run_id)))""",
)
def profile_pick_reconcile(spark, sf):
    both = F.concat("workflow", "domain_expert")
    shown = F.transform(
        both, lambda p: F.concat(p["id"], F.when(p["reason"].isNull(), "").otherwise(F.concat(F.lit("="), p["reason"])))
    )
    return P.reconcile_picks(chat_profiles(spark, sf), replies(spark, sf)).select(
        "run_id", F.array_join(shown, ",").alias("picks"), F.col("profile_source").alias("source")
    )


@query(
    "src_profiles",
    "select profile_id, count(*) as runs from (select unnest(workflow_ids || expert_ids) as profile_id from o_chat_profiles) group by 1",
)
def src_profiles(spark, sf):
    """Profiles read from JSON lines, joined by intent code, sector and keyword."""
    path = files.scratch(spark, "profiles")
    rows = [
        json.dumps(
            {
                "id": p["id"], "name": p["name"], "description": p["name"], "category": p["category"],
                "activates_on": {"intent_codes": list(p["codes"])} if p["category"] == "workflow"
                else {"sector": p["sector"], "topic_keywords": list(p["keywords"])},
            }
        )
        for p in fixed.PROFILES
    ]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
    known, _ = files.read_profiles(spark, path)
    intents = chat_intents(spark, sf)
    work = join_small(
        intents.select("run_id", F.explode("task_codes").alias("code")),
        known.where("category = 'workflow'").select(F.col("id").alias("profile_id"), F.explode("codes").alias("code")),
        ["code"],
    ).select("run_id", "profile_id").distinct()
    experts = known.where("category = 'domain_expert'")
    lower = F.transform(F.col("keywords"), F.lower)
    expert = (
        join_small(
            intents.select("run_id", "sector", "topic_keywords"),
            experts.select(F.col("id").alias("profile_id"), "sector", lower.alias("have")),
            ["sector"],
        )
        .where((F.size("topic_keywords") == 0) | F.arrays_overlap(F.transform("topic_keywords", F.lower), "have"))
        .select("run_id", "profile_id")
    )
    return work.unionByName(expert).groupBy("profile_id").agg(F.count(F.lit(1)).alias("runs"))


CATALOGUE = {
    "id": "'profile_' || doc_id",
    "name": "'Profile ' || doc_id",
    "description": "'About ' || source",
    "category": "case when doc_id % 2 = 0 then 'workflow' else 'domain_expert' end",
}
CHANGES = {
    "change_id": "doc_id",
    "op": "case doc_id % 3 when 0 then 'create' when 1 then 'update' else 'delete' end",
    "target_category": "case when doc_id % 4 < 2 then 'workflow' else 'domain_expert' end",
    "target_id": "'profile_' || (doc_id % 400)",
    "category": "case when doc_id % 5 = 4 then 'other' when doc_id % 4 < 2 then 'workflow' else 'domain_expert' end",
    "id": "case when doc_id % 7 = 6 then 'Bad-Id' when doc_id % 3 = 0 then ' new_' || (doc_id % 300) || ' ' else 'profile_' || (doc_id % 400 + case when doc_id % 11 = 0 then 1 else 0 end) end",
    "name": "case when doc_id % 13 = 0 then ' ' else 'Name ' || doc_id end",
    "description": "text",
    "word": "case when doc_id % 2 = 0 then ' ' else ' cloud ' end",
}
inputs.as_view("catalogue_in", "documents", CATALOGUE, "doc_id % 4 <> 3")
inputs.as_view("changes_in", "documents", CHANGES)

def _judged_sql(changes: str, catalogue: str) -> str:
    """The changes of each id one by one: a walk from change to change that carries the id's category."""
    return f"""with recursive c as (
  select *, op = 'delete' or (coalesce(length(id), 0) between 1 and 80 and regexp_matches(id, '^[a-z][a-z0-9_]*$')
    and length(name) between 1 and 160 and length(description) between 1 and 2000
    and category in ('workflow', 'domain_expert')) as valid
  from (select change_id, op, target_category, target_id, category, trim(id) as id, trim(name) as name,
    {Q.strip('description')} as description, trim(word) as word from {changes})
), k as (
  select *, case when op = 'create' then id else target_id end as key,
    case when not valid then 'invalid' when op = 'update' and (category <> target_category or id <> target_id) then 'rejected' end as static
  from c
), n as (select *, row_number() over (partition by key order by change_id) as rn from k),
walk as (
  select key, 0::BIGINT as rn, any_value(h.category) as place, null::VARCHAR as outcome from n left join {catalogue} h on h.id = n.key group by key
  union all
  select n.key, n.rn,
    case when static is not null then place when op = 'create' then coalesce(place, n.category)
      when op = 'delete' and place = target_category then null else place end,
    case when static is not null then static when op = 'create' then case when place is null then 'applied' else 'conflict' end
      when place = target_category then 'applied' else 'not_found' end
  from walk join n on n.key = walk.key and n.rn = walk.rn + 1
)
select n.* exclude (rn, key, static), walk.outcome from n join walk using (key, rn)"""


view("o_judged", _judged_sql("changes_in", "catalogue_in"))

#: One feed in which ids come and go: a third of all changes are about one id.
HISTORY = CHANGES | {
    "op": "case when doc_id % 17 = 0 then 'update' when floor(doc_id / 9) % 2 = 0 then 'create' else 'delete' end",
    "target_category": "case when doc_id % 5 = 0 then 'domain_expert' else 'workflow' end",
    "category": "case when doc_id % 5 = 0 then 'domain_expert' else 'workflow' end",
    "target_id": "case when doc_id % 3 = 0 then 'profile_hot' else 'profile_' || (doc_id % 7) end",
    "id": "case when doc_id % 3 = 0 then 'profile_hot' else 'profile_' || (doc_id % 7) end",
    "name": "case when doc_id % 29 = 0 then ' ' else 'Name ' || doc_id end",
    "description": "'About ' || source",
}
inputs.as_view("history_in", "documents", HISTORY)
view("o_history", _judged_sql("history_in", "catalogue_in"))


@query("profile_history", "select change_id, op, id, outcome from o_history")
def profile_history(spark, sf):
    """Changes of ids that are created, deleted and created again."""
    docs = inputs.spread(inputs.table(spark, sf, "documents"))
    changes = inputs.select(docs, HISTORY).withColumn("keywords", F.array("word")).drop("word")
    return P.judge_changes(_changes(spark, sf)[0], changes).select("change_id", "op", "id", "outcome")


def _changes(spark, sf):
    docs = inputs.spread(inputs.table(spark, sf, "documents"))
    changes = inputs.select(docs, CHANGES).withColumn("keywords", F.array("word", F.lit(" ai "))).drop("word")
    catalogue = inputs.select(docs.where("doc_id % 4 <> 3"), CATALOGUE).withColumn("keywords", T.strings([]))
    return catalogue, changes


@query("profile_changes", "select change_id, op, id, outcome from o_judged")
def profile_changes(spark, sf):
    return P.judge_changes(*_changes(spark, sf)).select("change_id", "op", "id", "outcome")


@query(
    "profile_apply",
    """select id, name, category, keywords from (
  select id, name, category, '' as keywords from catalogue_in where id not in (
    select case when op = 'create' then id else target_id end from o_judged where outcome = 'applied')
  union all
  select id, name, category, case when word = '' then 'ai' else word || ',ai' end from (
    select *, row_number() over (partition by case when op = 'create' then id else target_id end order by change_id desc) as rk
    from o_judged where outcome = 'applied') where rk = 1 and op <> 'delete')""",
)
def profile_apply(spark, sf):
    catalogue, changes = _changes(spark, sf)
    return P.apply_changes(catalogue, P.judge_changes(catalogue, changes)).select(
        "id", "name", "category", F.array_join("keywords", ",").alias("keywords")
    )
