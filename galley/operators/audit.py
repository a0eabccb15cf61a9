"""Audit events, run histories, stage payloads and tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators.scale import number_in_ranges, union_all


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def stage_event(
    rows: DataFrame, stage: str, source: Column, given: Column | None = None, made: Column | None = None,
    error: Column | None = None,
) -> DataFrame:
    """One event per row of a stage, of now and of kind "audit"; summaries are structs."""
    return rows.select(
        F.current_timestamp().alias("ts"),
        F.lit("audit").alias("kind"),
        "run_id",
        F.lit(stage).alias("stage"),
        source.alias("source"),
        (F.lit("{}") if given is None else _json(given)).alias("input_summary"),
        (F.lit("{}") if made is None else _json(made)).alias("output_summary"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


def intent_events(classified: DataFrame) -> DataFrame:
    return stage_event(
        classified, "intent", F.col("intent_source"),
        F.struct(F.length("user_prompt").alias("prompt_chars")),
        F.struct("task_codes", "sector", F.col("topic_keywords").alias("keywords"), "language"),
    )


def profile_events(selected: DataFrame) -> DataFrame:
    ids = lambda c: F.transform(c, lambda p: p["id"])
    return stage_event(
        selected, "profiles", F.col("profile_source"), F.struct("task_codes", "sector"),
        F.struct(ids("workflow").alias("workflow_profile_ids"), ids("domain_expert").alias("expert_profile_ids")),
    )


def retrieval_events(summary: DataFrame) -> DataFrame:
    return stage_event(
        summary, "retrieval", F.lit("deterministic"), None,
        F.struct("provider", F.col("corpora_searched").alias("corpora"), "snippet_count", "reasoning"),
    )


def refinement_events(refined: DataFrame) -> DataFrame:
    return stage_event(
        refined, "refinement", F.col("source"),
        F.struct(F.size("answers").alias("answers_count"), (F.col("refinement_policy") == "ask_first").alias("ask_questions")),
        F.struct("done", F.size("questions").alias("question_count"), "needs_re_retrieval", "reasoning"),
    )


def generation_events(drafted: DataFrame) -> DataFrame:
    return stage_event(
        drafted, "generation", F.col("draft_source"),
        F.struct(
            F.greatest(F.coalesce(F.size("snippets"), F.lit(0)), F.lit(0)).alias("snippet_count"),
            F.length("refined_prompt").alias("refined_prompt_chars"),
        ),
        F.struct(F.length("body").alias("body_chars"), F.size("citations").alias("citation_count")),
    )


def evaluation_events(evaluated: DataFrame) -> DataFrame:
    return stage_event(
        evaluated, "evaluation", F.col("source"), None,
        F.struct("passed", "failed_blocking", F.size("results").alias("kpi_count")),
    )


def failed_events(failures: DataFrame, stage: str, source: str = "system") -> DataFrame:
    """Events of a stage that raised: rows hold run_id and error; there is no output to sum up."""
    return stage_event(failures, stage, F.lit(source), error=F.col("error"))


def for_log(events: DataFrame, at: Column | None = None) -> DataFrame:
    """Events as the audit log stores them; ``at`` sets their time."""
    timed = events if at is None else events.withColumn("ts", at)
    return timed.select(
        "ts", "kind", F.col("run_id").cast("string").alias("run_id"), "stage", "source", "input_summary",
        "output_summary", "error",
    )


def all_events(*stages: DataFrame) -> DataFrame:
    return union_all(list(stages))


# ---- histories ------------------------------------------------------------


def trace(events: DataFrame, order: list[str]) -> DataFrame:
    """Events numbered within their run in time order; one busy run is split into ranges, also within a second."""
    return number_in_ranges(events, ["run_id"], order, "seq")


def unknown_runs(asked: DataFrame, events: DataFrame) -> DataFrame:
    """Asked runs that have no event."""
    return asked.join(events.select("run_id").distinct(), "run_id", "left_anti")


# ---- stage payloads -------------------------------------------------------


def unwrap(payload: Column, stage: Column) -> Column:
    """A payload without the tool envelope and without the stage key around it."""
    ok = (F.get_json_object(payload, "$.ok") == "true") & F.get_json_object(payload, "$.result").isNotNull()
    bare = F.when(ok, F.get_json_object(payload, "$.result")).otherwise(payload)
    return T.let(
        bare,
        lambda b: F.coalesce(
            F.call_function("get_json_object", b, F.concat(F.lit("$."), stage)), b
        ),
    )


def _kind(v: Column, path: str) -> Column:
    """JSON kind of a field: STRING, ARRAY<...>, OBJECT<...>, or null when missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(_kind(v, path), F.lit(kind)), F.lit(False))


GROUP = "array<struct<id:string,name:string,description:string,category:string>>"
SNIPPETS = (
    "array<struct<source_doc:string,node_id:string,title:string,content:string,score:string,reason:string>>"
)


def _filled(items: Column, names: list[str], empty_ok: bool) -> Column:
    def one(p: Column) -> Column:
        ok = p.isNotNull()
        for n in names:
            ok = ok & p[n].isNotNull() & (F.lit(True) if empty_ok else p[n] != "")
        return ok

    return F.coalesce(F.forall(items, one), F.lit(True))


def is_complete(payload: Column, stage: Column) -> Column:
    """Whether a payload holds all a later stage needs."""

    def judge(v: Column) -> Column:
        obj = _is(v, "$", "OBJECT")
        intent = (
            _is(v, "$.role", "STRING")
            & _is(v, "$.task_codes", "ARRAY")
            & F.get_json_object(payload, "$.task_codes[0]").isNotNull()
            & _kind(v, "$.confidence").isNotNull()
            & _is(v, "$.task_reason", "STRING")
        )
        group = lambda n: (
            (_kind(v, f"$.{n}").isNull() | _is(v, f"$.{n}", "ARRAY"))
            & _filled(F.from_json(F.get_json_object(payload, f"$.{n}"), GROUP), ["id", "name", "description", "category"], False)
        )
        retrieval = _is(v, "$.query", "OBJECT") & _is(v, "$.snippets", "ARRAY") & _is(v, "$.provider", "STRING")
        snippets = _is(v, "$", "ARRAY") & _filled(
            F.from_json(payload, SNIPPETS), ["source_doc", "node_id", "title", "content", "score", "reason"], True
        )
        return (
            F.when(stage == "intent", obj & intent)
            .when(stage == "profiles", obj & group("workflow") & group("domain_expert"))
            .when(stage == "retrieval", obj & retrieval)
            .when(stage == "content", obj & _is(v, "$.body", "STRING"))
            .when(stage == "snippets", snippets)
            .otherwise(obj)
        )

    return F.coalesce(T.let(F.try_parse_json(payload), judge), F.lit(False))


def latest_stage(payloads: DataFrame, kept_runs: int | None = None) -> DataFrame:
    """Payload in force per run and stage: the last complete one, else the last one.

    All runs are kept, or the ``kept_runs`` most recently started ones. Rows
    hold run_id, stage, seq (time order) and payload; the aggregates are
    partial, so a run with very many rows is reduced where its rows lie.
    """
    bare = payloads.withColumn("payload", unwrap(F.col("payload"), F.col("stage")))
    judged = bare.withColumn("complete", is_complete(F.col("payload"), F.col("stage")))
    last = judged.groupBy("run_id", "stage").agg(
        F.max_by("payload", F.when(F.col("complete"), F.col("seq"))).alias("whole"),
        F.max_by("payload", "seq").alias("last"),
        F.bool_or("complete").alias("complete"),
    )
    shown = last.select(
        "run_id", "stage", F.when(F.col("complete"), F.col("whole")).otherwise(F.col("last")).alias("payload"),
        "complete",
    )
    if kept_runs is None:
        return shown
    started = (
        payloads.groupBy("run_id").agg(F.min("seq").alias("start"))
        .orderBy(F.desc("start"), "run_id").limit(kept_runs).select("run_id")
    )
    # at most kept_runs rows
    return shown.join(F.broadcast(started), "run_id", "left_semi")


# ---- tool events ----------------------------------------------------------


def output_ok(output: Column) -> Column:
    ok = F.get_json_object(output, "$.ok")
    return F.coalesce(~ok.isin("false", "0", ""), F.lit(True))


def pair_tools(events: DataFrame) -> DataFrame:
    """Tool events with label and status; an output takes the name its call gave.

    Rows hold run_id, call_id, kind (call or output), tool_name, payload and seq.
    """
    calls = (
        events.where(F.col("kind") == "call").groupBy("run_id", "call_id")
        .agg(F.max_by("tool_name", "seq").alias("called"))
    )
    is_call = F.col("kind") == "call"
    return (
        events.join(calls, ["run_id", "call_id"], "left")
        .withColumn(
            "tool_name",
            F.when(is_call, F.coalesce("tool_name", F.lit("tool"))).otherwise(
                F.coalesce("called", "tool_name", F.lit("tool"))
            ),
        )
        .drop("called")
        .withColumns(
            {
                "label": F.concat(F.when(is_call, "-> ").otherwise("<- "), F.col("tool_name")),
                "status": F.when(is_call, "running").when(output_ok(F.col("payload")), "complete").otherwise("error"),
            }
        )
    )


def short_text(c: Column, limit: int = 96) -> Column:
    return T.let(
        F.replace(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(T.rstrip(F.substring(t, 1, limit - 3)), F.lit("..."))
        ),
    )


def _shown(c: Column) -> Column:
    """A JSON field as a log line shows it: None when missing, True and False for booleans."""
    return F.when(c.isNull(), "None").when(c == "true", "True").when(c == "false", "False").otherwise(c)


def _texts(c: Column) -> Column:
    """A JSON list of texts as a log line shows it."""
    return F.when(c.isNull(), "None").otherwise(T.list_repr(F.from_json(c, "array<string>"), "'"))


def _count(c: Column) -> Column:
    """Items of a JSON list, or keys of a JSON object, 0 when it is neither."""
    n = F.when(F.startswith(c, F.lit("{")), F.size(F.json_object_keys(c))).otherwise(F.json_array_length(c))
    return F.coalesce(n, F.lit(0)).cast("string")


def _keys(c: Column, other: str, limit: int = 96) -> Column:
    names = F.array_join(F.array_sort(F.json_object_keys(c)), ", ")
    return short_text(F.when(F.coalesce(names, F.lit("")) == "", other).otherwise(names), limit)


def call_summary(tool: Column, args: Column) -> Column:
    """One line about a tool call; rows also hold k, backend, channel, origin and strict_mode."""
    at = lambda p: F.get_json_object(args, f"$.{p}")
    prompt = short_text(at("user_prompt"))
    boolean = lambda c: F.when(F.coalesce(c, F.lit("false")).isin("false", "0", ""), "False").otherwise("True")
    intent = at("intent")
    chosen = F.when(
        intent.isNull() | F.startswith(intent, F.lit("{")),
        F.concat(F.lit("tasks="), _texts(at("intent.task_codes")), F.lit(", sector="), _shown(at("intent.sector"))),
    ).otherwise("selecting profiles from intent")
    said = F.coalesce(F.json_object_keys(args), T.strings([]))
    return (
        F.when(~F.coalesce(F.startswith(F.ltrim(args), F.lit("{")), F.lit(False)), short_text(args))
        .when(tool == "retrieve_context", F.concat(F.lit("k="), F.col("k").cast("string"), F.lit(", backend="), F.col("backend"), F.lit(", prompt="), prompt))
        .when(tool == "run_fallback", F.concat(F.lit("fallback full pipeline, refinement_policy="), F.coalesce(at("refinement_policy"), F.lit("skip")), F.lit(", prompt="), prompt))
        .when(tool == "select_profiles", chosen)
        .when(tool == "refine_prompt", F.concat(F.lit("answers="), _count(at("answers")), F.lit(", regenerate_on_pivot="), boolean(at("regenerate_on_pivot"))))
        .when(tool == "generate_draft", F.concat(F.lit("snippets="), _count(at("snippets"))))
        .when(tool == "evaluate_draft", F.concat(F.lit("channel="), F.col("channel"), F.lit(", origin="), F.col("origin"), F.lit(", strict="), _shown(F.col("strict_mode").cast("string"))))
        .when(F.array_contains(said, "user_prompt"), F.concat(F.lit("prompt="), prompt))
        .otherwise(_keys(args, "starting"))
    )


def output_summary(tool: Column, output: Column) -> Column:
    """One line about what a tool gave back."""
    failed = F.get_json_object(output, "$.ok") == "false"
    keys = F.coalesce(F.json_object_keys(output), T.strings([]))
    result = F.when(F.array_contains(keys, "result"), F.get_json_object(output, "$.result")).otherwise(output)

    def line(r: Column) -> Column:
        at = lambda p: F.get_json_object(r, f"$.{p}")
        either = lambda outer, p: F.when(at(outer).isNotNull(), at(f"{outer}.{p}")).otherwise(at(p))
        say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
        evaluation = F.when(at("evaluation").isNull() | (at("evaluation") == "{}"), "n/a").otherwise(_shown(at("evaluation.passed")))
        return (
            F.when(~F.coalesce(F.startswith(F.ltrim(r), F.lit("{")), F.lit(False)), short_text(F.coalesce(F.nullif(r, F.lit("")), F.lit("done")), 180))
            .when(tool == "run_fallback", say("fallback status=", _shown(at("status")), ", run_id=", _shown(at("run_id")), ", questions=", _count(at("refinement.questions")), ", passed=", evaluation))
            .when(tool == "retrieve_context", say("snippets=", _count(either("retrieval", "snippets")), ", provider=", _shown(either("retrieval", "provider"))))
            .when(tool == "refine_prompt", say("done=", _shown(at("done")), ", questions=", _count(at("questions")), ", needs_re_retrieval=", _shown(at("needs_re_retrieval"))))
            .when(tool == "generate_draft", say("body_chars=", F.length(F.coalesce(at("body"), F.lit(""))).cast("string"), ", citations=", _count(at("citations"))))
            .when(tool == "evaluate_draft", say("passed=", _shown(at("passed")), ", blocking=", _count(at("failed_blocking")), ", tier3=", _count(at("dclp_steps_required"))))
            .when(tool == "classify_intent", say("tasks=", _texts(at("task_codes")), ", language=", _shown(at("language"))))
            .when(tool == "select_profiles", say("workflow=", _count(either("profiles", "workflow")), ", experts=", _count(either("profiles", "domain_expert"))))
            .otherwise(_keys(r, "done", 180))
        )

    error = F.coalesce(F.get_json_object(output, "$.error"), F.lit("unknown error"))
    return F.when(failed, F.concat(F.lit("failed: "), short_text(error, 180))).otherwise(T.let(result, line))
