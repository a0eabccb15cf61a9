"""Whole runs over the benchmark requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import runs
from galley.plans import assets, inputs, refine_queries, retrieval_queries
from galley.plans import sqltext as Q
from galley.plans.intent_queries import intent_views
from galley.plans.registry import query, view

view("r_in", f"select run_id, {Q.strip('user_prompt')} as user_prompt, null::VARCHAR as output_language from requests_in")
intent_views("r_new", "r_in")
view(
    "r_snips",
    f"select run_id, rank, node_id, source_doc, article_title, source_url from ({retrieval_queries._RETRIEVED})",
)
view(
    "r_bodies",
    f"""select run_id, case when language = 'nl' then {refine_queries._body_sql('nl')} else {refine_queries._body_sql('en')} end as body
from (select n.*, p.workflow_ids, p.expert_ids, s.refs from r_new_intent n join o_req_profiles p on p.run_id = n.run_id
  left join (select run_id, string_agg('- [' || rank || '] ' || {refine_queries._REF}, chr(10) order by rank) as refs
    from r_snips where rank <= 5 group by 1) s on s.run_id = n.run_id)""",
)


def _runs(spark, sf):
    return runs.run(
        inputs.requests(spark, sf), assets.nodes(spark, sf), assets.chunks(spark, sf), retrieval_queries.AVAILABLE
    )


@query(
    "full_run",
    """select r.run_id, case when refinement_policy = 'ask_first' then 'needs_clarification' else 'completed' end as status,
  coalesce(c.n, 0) as snippets, case when refinement_policy = 'ask_first' then '-' else coalesce(n.language, '-') end as language,
  case when refinement_policy = 'ask_first' then '-' else md5(b.body) end as body_md5,
  case when refinement_policy = 'ask_first' then 0 else least(coalesce(c.n, 0), 5) end as citations,
  refinement_policy <> 'ask_first' as passed
from requests_in r join r_new_intent n on n.run_id = r.run_id join r_bodies b on b.run_id = r.run_id
left join (select run_id, count(*) as n from r_snips group by 1) c on c.run_id = r.run_id""",
)
def full_run(spark, sf):
    rows, _ = _runs(spark, sf)
    return rows.select(
        "run_id", "status", F.col("snippet_count").alias("snippets"), F.coalesce("language", F.lit("-")).alias("language"),
        F.coalesce(F.md5("body"), F.lit("-")).alias("body_md5"),
        F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)).cast("bigint").alias("citations"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
    )


@query(
    "full_run_events",
    """select stage, count(*) as events from (
  select unnest(case when refinement_policy = 'ask_first' then ['intent', 'profiles', 'retrieval', 'refinement', 'run_pipeline']
    else ['intent', 'profiles', 'retrieval', 'refinement', 'generation', 'evaluation', 'run_pipeline'] end) as stage from requests_in) group by 1""",
)
def full_run_events(spark, sf):
    _, events = _runs(spark, sf)
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("events"))
