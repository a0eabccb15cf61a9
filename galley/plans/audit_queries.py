"""Audit logs, histories, tool events and corpus questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from galley import fixed
from galley.operators import audit as A
from galley.operators import coverage as V
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import refine as X
from galley.operators import retrieval as R
from galley.operators.scale import spread
from galley.plans import assets, corpus_queries, inputs, refine_queries, retrieval_queries
from galley.plans.registry import query, table, view
from galley.sources import files
from galley.streaming import audit_stream as S

# ---- derived events -------------------------------------------------------

STAGE = (
    "case event_type when 'view' then 'intent' when 'click' then 'profiles' when 'purchase' then 'retrieval' "
    "when 'signup' then 'content' else 'snippets' end"
)
LOG = {
    "event_id": "event_id",
    "ts": "ts",
    "run_id": "'run_' || user_id",
    "stage": STAGE,
    "kind": "'audit'",
    "source": "case when event_id % 3 = 0 then 'llm' else 'deterministic' end",
    "input_summary": "props",
    "output_summary": "'{\"value\":' || event_id || '}'",
    "error": "case when event_type = 'error' then 'failed' else null end",
}
inputs.as_view("log_in", "events", LOG)

_FULL = {
    "intent": '{"role":"R","task_codes":["T1_SEARCH"],"confidence":0.5,"task_reason":"e#"}',
    "profiles": '{"workflow":[{"id":"a#","name":"n","description":"d","category":"workflow"}]}',
    "retrieval": '{"query":{"k":5},"snippets":[],"provider":"p#"}',
    "content": '{"body":"text #"}',
    "snippets": '[{"source_doc":"d","node_id":"n#","title":"t","content":"c","score":1,"reason":"r"}]',
}
_PART = {
    "intent": '{"role":"R","task_codes":[]}',
    "profiles": '{"workflow":[{"id":"a","name":""}]}',
    "retrieval": '{"query":{},"snippets":[]}',
    "content": '{"body":7}',
    "snippets": '[{"source_doc":"d"}]',
}


def _with_id(s: str) -> str:
    return "'" + s.replace("#", "' || event_id || '") + "'"


def _by_stage(t: dict[str, str]) -> str:
    return f"case {STAGE} " + " ".join(f"when '{k}' then {_with_id(v)}" for k, v in t.items()) + " end"


PAYLOADS = {
    "run_id": "'run_' || user_id",
    "stage": STAGE,
    "seq": "event_id",
    "payload": (
        f"case event_id % 4 when 0 then {_by_stage(_FULL)} when 1 then {_by_stage(_PART)} "
        f"when 2 then '{{\"ok\":true,\"result\":{{\"' || {STAGE} || '\":' || {_by_stage(_FULL)} || '}}}}' else 'oops' end"
    ),
}
inputs.as_view(
    "payloads_in", "events",
    {**PAYLOADS, "bare": f"case event_id % 4 when 1 then {_by_stage(_PART)} when 3 then 'oops' else {_by_stage(_FULL)} end"},
)

_TOOLS = (
    "retrieve_context", "run_fallback", "select_profiles", "refine_prompt", "generate_draft", "evaluate_draft",
    "classify_intent", "health_check",
)
_ARGS = (
    '{"user_prompt":" Ask # about\\ncloud "}', '{"user_prompt":"x","refinement_policy":"ask_first"}',
    '{"intent":{"task_codes":["T1_DRAFT","T1_SEARCH"],"sector":null}}',
    '{"answers":{"a":"b","c":"d"},"regenerate_on_pivot":true}', '{"snippets":[{"a":1},{"a":2}]}', '{"body":"x"}',
    '{"user_prompt":"' + "long words " * 12 + '#"}', "{}",
)
_CALLED = (
    "k=5, backend=pageindex, prompt=Ask # about cloud",
    "fallback full pipeline, refinement_policy=ask_first, prompt=x",
    "tasks=[''T1_DRAFT'', ''T1_SEARCH''], sector=None", "answers=2, regenerate_on_pivot=True", "snippets=2",
    "channel=web, origin=instant, strict=False", "prompt=" + ("long words " * 12)[:93].rstrip() + "...", "starting",
)
_OUTS = (
    '{"ok":true,"result":{"retrieval":{"snippets":[1,2,3],"provider":"vector_rag"}}}',
    '{"ok":true,"result":{"status":"completed","run_id":"r#","refinement":{"questions":[]},"evaluation":{"passed":true}}}',
    '{"result":{"profiles":{"workflow":[{"id":"a"}],"domain_expert":[]}}}',
    '{"ok":true,"result":{"done":true,"questions":[],"needs_re_retrieval":false}}',
    '{"ok":true,"result":{"body":"abc","citations":[1]}}',
    '{"passed":false,"failed_blocking":["x"],"dclp_steps_required":[]}',
    '{"ok":true,"result":{"task_codes":["T1_DRAFT"],"language":null}}',
    '{"ok":true,"result":{"version":1,"status":"ok"}}',
)
_GAVE = (
    "snippets=3, provider=vector_rag", "fallback status=completed, run_id=r#, questions=0, passed=True",
    "workflow=1, experts=0", "done=True, questions=0, needs_re_retrieval=False", "body_chars=3, citations=1",
    "passed=False, blocking=1, tier3=0", "tasks=[''T1_DRAFT''], language=None", "status, version",
)
#: What an output without its call shows: the tool is not known, so the keys of the result.
_ALONE = (
    "retrieval", "evaluation, refinement, run_id, status", "profiles", "done, needs_re_retrieval, questions",
    "body, citations", "dclp_steps_required, failed_blocking, passed", "language, task_codes", "status, version",
)
_PAIR = "cast(floor(event_id / 2) as bigint)"


def _by_tool(texts) -> str:
    return f"case {_PAIR} % 8 " + " ".join(f"when {n} then {_with_id(t)}" for n, t in enumerate(texts)) + " end"


TOOLS = {
    "run_id": f"'run_' || ({_PAIR} % 50)",
    "call_id": f"'call_' || {_PAIR}",
    "kind": "case when event_id % 2 = 0 then 'call' else 'output' end",
    "tool_name": f"case when event_id % 2 = 0 then {_by_tool(_TOOLS)} when event_id % 3 = 0 then null else 'other' end",
    "payload": (
        f"case when event_id % 2 = 0 then {_by_tool(_ARGS)} when event_id % 5 = 4 then "
        f"'{{\"ok\":false,\"error\":\"boom ' || event_id || '\"}}' else {_by_tool(_OUTS)} end"
    ),
    "seq": "event_id",
    "ts": "ts",
}
_KEPT = "event_id % 10 <> 0"
inputs.as_view(
    "tools_in", "events",
    {
        **TOOLS,
        "line": f"case when event_id % 2 = 0 then {_by_tool(_CALLED)} when event_id % 5 = 4 then 'failed: boom ' || event_id else {_by_tool(_GAVE)} end",
        "alone": f"case when event_id % 5 = 4 then 'failed: boom ' || event_id else {_by_tool(_ALONE)} end",
        "named": f"{_by_tool(_TOOLS)}",
    },
    _KEPT,
)


def log(spark, sf):
    return inputs.select(spread(table(spark, sf, "events")), LOG)


def tools(spark, sf):
    return inputs.select(spread(table(spark, sf, "events").where(_KEPT)), TOOLS)


# ---- audit log ------------------------------------------------------------


@query("sink_audit", "select stage, source, count(*) as events, count(error) as errors, max(event_id) as last from log_in group by all")
def sink_audit(spark, sf):
    """Two appends to one log, read back."""
    path = files.scratch(spark, "audit")
    rows = log(spark, sf)
    columns = [f.name for f in spark.createDataFrame([], files.AUDIT_SCHEMA).schema]
    for part in (0, 1):
        files.append_audit(rows.where(F.col("event_id") % 2 == part).select(*columns), path)
    read = files.read_audit(spark, path)
    number = F.get_json_object("output_summary", "$.value").cast("bigint")
    return read.groupBy("stage", "source").agg(
        F.count(F.lit(1)).alias("events"), F.count("error").alias("errors"), F.max(number).alias("last")
    )


@query(
    "audit_events",
    """select run_id, 'intent' as stage, 'deterministic' as source, '{"prompt_chars":' || length(user_prompt) || '}' as input_summary,
  to_json({'task_codes': task_codes, 'sector': sector, 'keywords': topic_keywords, 'language': language})::VARCHAR as output_summary from o_chat_profiles
union all
select run_id, 'profiles', 'deterministic', to_json({'task_codes': task_codes, 'sector': sector})::VARCHAR,
  to_json({'workflow_profile_ids': workflow_ids, 'expert_profile_ids': expert_ids})::VARCHAR from o_chat_profiles
union all
select t.run_id, 'refinement', 'deterministic', to_json({'answers_count': (t.run_id % 4 <> 0)::INT, 'ask_questions': refinement_policy = 'ask_first'})::VARCHAR,
  to_json({'done': not ask, 'question_count': case when ask then len(asked) else 0 end,
    'needs_re_retrieval': not ask and """
    + refine_queries._pivot("t", "n")
    + """,
    'reasoning': case when ask then 'Clarification questions generated before lock-in.' else 'Prompt locked after deterministic refinement.' end})::VARCHAR
from o_turn t join o_questions q on q.run_id = t.run_id join o_ref_intent n on n.run_id = t.run_id""",
)
def audit_events(spark, sf):
    rows = refine_queries.chat_rows(spark, sf)
    selected = P.select_profiles(rows)
    refined = X.refine(rows, refine_queries.answers_of(rows))
    events = A.all_events(A.intent_events(rows), A.profile_events(selected), A.refinement_events(refined))
    return events.select("run_id", "stage", "source", "input_summary", "output_summary")


_PLACE = "case stage when 'intent' then 0 when 'profiles' then 1 else 2 end"


@query(
    "audit_flow",
    """select run_id, stage, 'audit' as kind, case when stage = 'refinement' and n % 7 = 0 then 'boom ' || n end as error,
  row_number() over (partition by run_id order by """
    + _PLACE
    + """) as seq from (select run_id::VARCHAR as run_id, unnest(['intent', 'profiles', 'refinement']) as stage, run_id as n from o_turn)""",
)
def audit_flow(spark, sf):
    """Events of all stages and of failed ones, appended to a log, read back and numbered."""
    rows = refine_queries.chat_rows(spark, sf)
    fails = F.col("run_id") % 7 == 0
    events = A.all_events(
        A.intent_events(rows),
        A.profile_events(P.select_profiles(rows)),
        A.refinement_events(X.refine(rows.where(~fails), refine_queries.answers_of(rows))),
        A.failed_events(rows.where(fails).select("run_id", F.concat(F.lit("boom "), F.col("run_id").cast("string")).alias("error")), "refinement"),
    )
    path = files.scratch(spark, "flow")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 60 + F.expr(_PLACE))
    files.append_audit(A.for_log(events, at), path)
    return A.trace(files.read_audit(spark, path), ["ts"]).select(
        "run_id", "stage", "kind", "error", F.col("seq").cast("bigint").alias("seq")
    )


@query("audit_trace", "select run_id, event_id, row_number() over (partition by run_id order by ts, event_id) as seq from log_in")
def audit_trace(spark, sf):
    return A.trace(log(spark, sf), ["ts", "event_id"]).select("run_id", "event_id", F.col("seq").cast("bigint").alias("seq"))


@query(
    "audit_unknown",
    "select distinct 'run_' || c_custkey as run_id from customer where 'run_' || c_custkey not in (select run_id from log_in)",
)
def audit_unknown(spark, sf):
    asked = table(spark, sf, "customer").select(F.concat(F.lit("run_"), F.col("c_custkey").cast("string")).alias("run_id"))
    return A.unknown_runs(asked, log(spark, sf))


@query(
    "latest_stage",
    """select run_id, stage, coalesce(max_by(bare, seq) filter (where seq % 4 in (0, 2)), max_by(bare, seq)) as payload, bool_or(seq % 4 in (0, 2)) as complete
from payloads_in group by all""",
)
def latest_stage(spark, sf):
    return A.latest_stage(inputs.select(spread(table(spark, sf, "events")), PAYLOADS))


view(
    "o_tools",
    """select *, case when kind = 'call' or (seq - 1) % 10 <> 0 then named else coalesce(tool_name, 'tool') end as tool from tools_in""",
)


@query(
    "tool_pairing",
    """select run_id, call_id, kind, tool as tool_name, case when kind = 'call' then '-> ' else '<- ' end || tool as label,
  case when kind = 'call' then 'running' when seq % 5 = 4 then 'error' else 'complete' end as status from o_tools""",
)
def tool_pairing(spark, sf):
    return A.pair_tools(tools(spark, sf)).select("run_id", "call_id", "kind", "tool_name", "label", "status")


@query("event_summaries", "select call_id, kind, case when kind = 'call' or (seq - 1) % 10 <> 0 then line else alone end as summary from o_tools")
def event_summaries(spark, sf):
    settings = {
        "k": F.lit(5), "backend": F.lit("pageindex"), "channel": F.lit("web"), "origin": F.lit("instant"),
        "strict_mode": F.lit(False),
    }
    rows = A.pair_tools(tools(spark, sf)).withColumns(settings)
    tool, payload = F.col("tool_name"), F.col("payload")
    line = F.when(F.col("kind") == "call", A.call_summary(tool, payload)).otherwise(A.output_summary(tool, payload))
    return rows.select("call_id", "kind", line.alias("summary"))


_TIMED = {**PAYLOADS, "ts": "ts"}


@query(
    "latest_stage_stream",
    """select run_id, stage, coalesce(max_by(bare, seq) filter (where seq % 4 in (0, 2)), max_by(bare, seq)) as payload, bool_or(seq % 4 in (0, 2)) as complete
from payloads_in group by all""",
)
def latest_stage_stream(spark, sf):
    """The payloads arrive in two runs of the stream, the second from its checkpoint."""
    base = files.scratch(spark, "latest-stream")
    rows = inputs.select(spread(table(spark, sf, "events")), _TIMED)
    middle = table(spark, sf, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    cut = F.lit(middle["lo"] + (middle["hi"] - middle["lo"]) / 2) if middle["lo"] else F.lit(None).cast("timestamp")
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        rows.where(part).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema("run_id string, stage string, seq bigint, payload string, ts timestamp").json(f"{base}/in")
        S.keep_latest(S.latest_partials(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return S.read_latest(spark, f"{base}/out")


_LATE = "5 minutes"


@query(
    "tool_pairing_stream",
    f"""select coalesce(c.call_id, o.call_id) as call_id, c.tool_name, o.payload,
  case when o.call_id is null then 'no output' when c.call_id is null then 'no call' else 'paired' end as state
from (select * from tools_in where kind = 'call') c full join (select * from tools_in where kind = 'output') o on c.call_id = o.call_id and o.ts between c.ts and c.ts + interval {_LATE}""",
)
def tool_pairing_stream(spark, sf):
    """All calls and outputs, those without the other and those too late too; a last event of each kind closes the log."""
    base = files.scratch(spark, "pair-stream")
    columns = (F.col("ts").cast("timestamp").alias("ts"), "kind", "call_id", "tool_name", "payload")
    tools(spark, sf).select(*columns).write.parquet(f"{base}/in")
    read = lambda: spark.readStream.schema("ts timestamp, kind string, call_id string, tool_name string, payload string").parquet(f"{base}/in")

    def run():
        pairs = S.pair_tools(read(), _LATE, "full")
        return pairs.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    run().awaitTermination()
    close = spark.createDataFrame([(kind,) for kind in ("call", "output")], "kind string")
    nothing = [F.lit(None).cast("string").alias(n) for n in ("call_id", "tool_name", "payload")]
    at = F.timestamp_seconds(F.lit(4_102_444_800)).alias("ts")
    close.select(at, "kind", *nothing).write.mode("append").parquet(f"{base}/in")
    run().awaitTermination()
    pairs = spark.read.schema(
        "call_id string, called_at timestamp, tool_name string, output_id string, done_at timestamp, payload string"
    ).parquet(f"{base}/out").where("call_id is not null or output_id is not null")  # what closes the log has no id
    state = F.when(F.col("output_id").isNull(), "no output").when(F.col("call_id").isNull(), "no call").otherwise("paired")
    return pairs.select(F.coalesce("call_id", "output_id").alias("call_id"), "tool_name", "payload", state.alias("state"))


@query(
    "audit_stream",
    """select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, stage, count(*) as events, count(error) as errors from log_in
where time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from log_in) - interval 1 hour group by all""",
)
def audit_stream(spark, sf):
    """Every event arrives twice; windows that the watermark has closed are counted once."""
    base = files.scratch(spark, "stream")
    rows = log(spark, sf).select("event_id", "ts", "run_id", "stage", "error")
    rows.unionByName(rows).write.json(f"{base}/log")
    counts = S.stage_counts(S.read_log(spark, f"{base}/log"))
    S.write_counts(counts, f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    read = spark.read.schema("start timestamp, end timestamp, stage string, events bigint, errors bigint").parquet(f"{base}/counts")
    return read.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "stage", "events", "errors")


@query("sink_audit_stream", "select run_id, stage, count(*) as events, count(error) as errors, max(event_id) as last from log_in group by all")
def sink_audit_stream(spark, sf):
    """The log appended by a stream, two files a batch, its first batch written twice."""
    base = files.scratch(spark, "log-stream")
    log(spark, sf).select("event_id", "ts", "run_id", "stage", "error").write.json(f"{base}/in")
    events = spark.readStream.schema(S.SCHEMA).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    S.append_log(events, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    first = spark.read.schema(S.SCHEMA).json(f"{base}/log/writer=audit/batch=0")
    first.write.json(f"{base}/again")
    S.write_batch(spark.read.schema(S.SCHEMA).json(f"{base}/again"), 0, f"{base}/log", "audit")
    return spark.read.schema(S.SCHEMA).json(f"{base}/log").groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("events"), F.count("error").alias("errors"), F.max("event_id").alias("last")
    )


# ---- corpus questions -----------------------------------------------------

AS_OF = dt.date(2022, 1, 1)


def articles(spark, sf):
    return corpus_queries.parsed(spark, sf)


@query(
    "aging_scan",
    f"""select corpus, slug, title, published, date_diff('day', published::DATE, DATE '{AS_OF}')::BIGINT as age_days, author[1] as original_author
from o_parsed where date_diff('day', published::DATE, DATE '{AS_OF}') > 365""",
)
def aging_scan(spark, sf):
    rows = V.aging_scan(articles(spark, sf), AS_OF)
    return rows.withColumns({"published": F.col("published").cast("string"), "age_days": F.col("age_days").cast("bigint")})


@query(
    "gap_report",
    """select topic, count(slug) as articles from (
  select distinct lower(t) as topic from (select unnest(topic_keywords) as t from o_chat_intent)) k
left join (select distinct slug, lower(unnest(tags)) as tag from o_parsed) a on a.tag = k.topic group by 1""",
)
def gap_report(spark, sf):
    topics = I.classify(inputs.chats(spark, sf)).select(F.explode_outer("topic_keywords").alias("topic")).where(F.col("topic").isNotNull())
    return V.gap_report(articles(spark, sf), topics)


@query(
    "corpus_filter",
    """select corpus, slug, title from o_parsed where list_contains(list_transform(tags, lambda t: lower(t)), 'retail media')
and published between '2016-01-01' and '2020-12-31' and list_contains(author, 'Author 1')""",
)
def corpus_filter(spark, sf):
    rows = V.corpus_filter(articles(spark, sf), "Retail media", dt.date(2016, 1, 1), dt.date(2020, 12, 31), "Author 1")
    return rows.select("corpus", "slug", "title")


@query(
    "corpus_examples",
    """select topic, rank, slug from (select *, row_number() over (partition by topic order by published desc, slug) as rank from (
  select distinct lower(unnest(tags)) as topic, slug, published from o_parsed)
  where topic in (select lower(unnest(topic_keywords)) from o_chat_intent)) where rank <= 3""",
)
def corpus_examples(spark, sf):
    topics = I.classify(inputs.chats(spark, sf)).select(F.explode_outer("topic_keywords").alias("topic")).where(F.col("topic").isNotNull())
    return V.corpus_examples(articles(spark, sf), topics).select("topic", F.col("rank").cast("bigint").alias("rank"), "slug")


@query(
    "corpus_search",
    f"select run_id, rank, source_doc, node_id, score from ({retrieval_queries._vec_out()}) where run_id in (select run_id from o_req_intent where sector is not null)",
)
def corpus_search(spark, sf):
    """Search for the requests of one sector."""
    queries = retrieval_queries.queries_of(spark, sf).where(F.col("sector") == fixed.SECTOR)
    return R.topk_vector(queries, assets.chunks(spark, sf)).select(
        "run_id", F.col("rank").cast("bigint").alias("rank"), "source_doc", "node_id", "score"
    )
