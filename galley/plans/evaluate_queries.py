"""Catalogue, judge replies, gate, maturity and reports over the drafts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from galley import fixed
from galley.operators import evaluate as G
from galley.operators.scale import join_small
from galley.plans import checks_queries, inputs
from galley.plans import sqltext as Q
from galley.plans.registry import ORACLES, query, table, view
from galley.sources import files

#: Replies of judges, made from the labels: rubric, value, reason, seq, condition.
REPLIES = (
    ("factuality", "'numerous'", 0, "doc_id % 2 = 0"),
    ("factuality", "case when quality = 1 then 'none' when doc_id % 2 = 0 then 'few' else 'several' end", 1, "true"),
    ("truthfullness", "case doc_id % 5 when 0 then 'few' when 1 then 'many' else 'none' end", 0, "true"),
    ("relevancy", "case when doc_id % 9 = 0 then 'off_topic' else 'highly' end", 0, "true"),
    ("privacy_security", "case when toxic = 1 then 'many' else 'none' end", 0, "true"),
    ("groundedness", "case when doc_id % 3 = 0 then 'no such value' else 'full' end", 0, "true"),
    ("comprehensiveness", "'mostly'", 0, "doc_id % 2 = 1"),
    ("unknown rubric", "'none'", 0, "true"),
)
view(
    "replies_of_judges",
    " union all ".join(
        f"select doc_id as run_id, '{r}' as rubric, {v} as value, {s} as seq from labels where {w}"
        for r, v, s, w in REPLIES
    ),
)


def replies(spark, sf):
    rows = ", ".join(
        f"case when {w} then named_struct('rubric', '{r}', 'value', {v}, 'reason', 'judged', 'seq', {s}) end"
        for r, v, s, w in REPLIES
    )
    return (
        table(spark, sf, "labels")
        .select(F.col("doc_id").alias("run_id"), F.explode_outer(F.expr(f"array({rows})")).alias("r"))
        .where(F.col("r").isNotNull())
        .select("run_id", "r.*")
    )


def evaluated(spark, sf):
    return G.evaluate(checks_queries.drafts(spark, sf), replies(spark, sf))


# ---- check SQL ------------------------------------------------------------

_KPIS = G.seed_kpis()
_BY_ID = {k["id"]: (n, k) for n, k in enumerate(_KPIS)}


def _null(v) -> str:
    return "null" if v is None else Q.lit(v)


view(
    "o_kpis",
    "select * from (values "
    + ", ".join(
        f"({n}, {Q.lit(k['id'])}, {_null(k['category'])}, {Q.lit(k['weight'])}, {Q.lit(k['monitoring'])}, "
        f"{Q.lit(k['relevance']['human'])}, {Q.lit(k['relevance']['genai_knowledge'])}, {Q.lit(k['relevance']['instant'])})"
        for n, k in enumerate(_KPIS)
    )
    + ") t(ord, kpi_id, category, weight, monitoring, r_human, r_genai, r_instant)",
)
_CELL = "case origin when 'human' then r_human when 'genai_knowledge' then r_genai else r_instant end"
view(
    "o_applicable",
    f"select run_id, origin, channel, coalesce(strict_mode, false) as strict, k.* from drafts_in, o_kpis k where {_CELL} = 'Applicable'",
)
_CHECKS = {
    "factuality_truthfullness": "chk_citation_markers",
    "images_with_missing_alt_text": "chk_image_alt",
    "language": "chk_language",
    "tracability": "chk_trace",
    "approved_source_content_for_genai": "chk_approved_source",
}
view(
    "o_checked",
    " union all ".join(f"select '{k}' as kpi_id, * from ({ORACLES[q]})" for k, q in _CHECKS.items()),
)
view(
    "o_active",
    """select run_id, kpi_id, ord from o_applicable
union all select d.run_id, 'approved_source_content_for_genai', 100 from drafts_in d
  where n_citations > 0 and not exists (select 1 from o_applicable a where a.run_id = d.run_id and a.kpi_id = 'approved_source_content_for_genai')
union all select d.run_id, 'language', 101 from drafts_in d
  where language is not null and not exists (select 1 from o_applicable a where a.run_id = d.run_id and a.kpi_id = 'language')""",
)
view(
    "o_t1",
    """select c.run_id, 1 as tier, a.ord, c.kpi_id, value, passed, 'deterministic' as source
from o_checked c join o_active a on a.run_id = c.run_id and a.kpi_id = c.kpi_id""",
)
_VALUES = ", ".join(f"('{k}', '{v}')" for k, vs in fixed.BLOCKING_VALUES.items() for v in vs)
_GATE = (
    "(tier <> 3 and ((strict and weight = 'Blocking' and monitoring = 'Mandatory' and not passed) or "
    "(source <> 'skipped' and value <> 'unknown' and case when r.kpi_id = 'tracability' then origin = 'genai_knowledge' "
    f"and value = 'not_used' else (r.kpi_id, value) in ({_VALUES}) end)))"
)
_WITH = (
    "join o_kpis k on k.kpi_id = r.kpi_id join (select run_id, origin, coalesce(strict_mode, false) as strict from drafts_in) d "
    "on d.run_id = r.run_id"
)
view("o_early", f"select distinct r.run_id from o_t1 r {_WITH} where {_GATE}")
_PASS = ", ".join(
    f"('{k}', '{v}')" for _, k, s in fixed.JUDGES for v in fixed.PASSING[s]
)
_ALLOWED = ", ".join(f"('{r}', '{v}')" for r, _, s in fixed.JUDGES for v in fixed.SCALES[s])
view(
    "o_t2",
    f"""select a.run_id, 2 as tier, j.ord, a.kpi_id,
  case when g.run_id is null then 'not_evaluated' when (j.rubric, r.value) in ({_ALLOWED}) then r.value else 'unknown' end as value,
  case when g.run_id is null then not a.strict else coalesce((a.kpi_id, r.value) in ({_PASS}), false) end as passed,
  case when g.run_id is null then 'skipped' else 'llm' end as source
from o_applicable a
join (values {", ".join(f"({n}, '{r}', '{k}')" for n, (r, k, _) in enumerate(fixed.JUDGES))}) j(ord, rubric, kpi_id) on j.kpi_id = a.kpi_id
left join (select distinct run_id from replies_of_judges) g on g.run_id = a.run_id
left join (select run_id, rubric, arg_max(value, seq) as value from replies_of_judges group by all) r on r.run_id = a.run_id and r.rubric = j.rubric
where a.run_id not in (select run_id from o_early)""",
)
view(
    "o_t3",
    f"""select run_id, 3 as tier, list_position({Q.lits(fixed.HUMAN_STEPS)}, kpi_id) as ord, kpi_id, 'no' as value, false as passed, 'deterministic' as source
from o_applicable where kpi_id in ({", ".join(Q.lit(s) for s in fixed.HUMAN_STEPS)})""",
)
view(
    "o_results",
    f"""select r.*, k.category, k.weight, k.monitoring, d.origin, d.strict, {_GATE} as stops from (
  select * from o_t1 union all select * from o_t2 union all select * from o_t3) r {_WITH}""",
)
view(
    "o_maturity",
    """select run_id, coalesce(category, 'Uncategorised') as category,
  case when avg(passed::int) < 0.5 then 'low' when avg(passed::int) < 0.8 then 'medium' else 'high' end as maturity
from o_results where tier <> 3 group by all""",
)
view(
    "o_eval",
    """select d.run_id, coalesce(b.ids, '') as failed_blocking, b.ids is null as passed,
  coalesce(m.levels, '') as maturity, coalesce(s.steps, '') as steps, d.run_id in (select run_id from o_early) as short_circuit,
  case when d.run_id in (select run_id from replies_of_judges) and d.run_id not in (select run_id from o_early) then 'llm' else 'deterministic' end as source
from drafts_in d
left join (select run_id, string_agg(kpi_id, ',' order by tier, ord) as ids from o_results where stops group by 1) b on b.run_id = d.run_id
left join (select run_id, string_agg(category || '=' || maturity, ',' order by category) as levels from o_maturity group by 1) m on m.run_id = d.run_id
left join (select run_id, string_agg(kpi_id, ',' order by ord) as steps from o_t3 group by 1) s on s.run_id = d.run_id""",
)


# ---- queries --------------------------------------------------------------


def _kpi_file(spark):
    path = files.scratch(spark, "kpis")
    rows = []
    for i, cat, w, m, ind, *rel in fixed.KPIS:
        row = {
            "id": i, "name": i, "category": cat, "weight": w, "monitoring": m, "indicator": ind,
            "relevance": dict(zip(fixed.ORIGINS, rel)), "norm": f"norm of {i}",
            "norm_chat": f"chat norm of {i}" if len(i) % 2 else "", "norm_messages": None,
        }
        rows.append({k: v for k, v in row.items() if v is not None})
    spark.createDataFrame([(json.dumps({"kpis": rows}),)], "value string").coalesce(1).write.text(path)
    return files.read_kpis(spark, path)


@query(
    "src_kpis",
    "select weight, monitoring, count(*) as rows from o_applicable group by all",
)
def src_kpis(spark, sf):
    rows = G.applicable_kpis(inputs.drafts_base(spark, sf).select("run_id", "origin", "channel"), _kpi_file(spark))
    return rows.groupBy("weight", "monitoring").agg(F.count(F.lit(1)).alias("rows"))


@query("evaluate_from_file", "select run_id, passed, failed_blocking from o_eval")
def evaluate_from_file(spark, sf):
    """The gate driven by a catalogue file."""
    done = G.evaluate(checks_queries.drafts(spark, sf), replies(spark, sf), _kpi_file(spark))
    return done.select("run_id", "passed", F.array_join("failed_blocking", ",").alias("failed_blocking"))


@query("applicable_kpis", "select run_id, kpi_id from o_applicable")
def applicable_kpis(spark, sf):
    rows = G.applicable_kpis(inputs.drafts_base(spark, sf).select("run_id", "origin", "channel"), _kpi_file(spark))
    return rows.select("run_id", F.col("id").alias("kpi_id"))


@query(
    "kpi_lookup",
    """select coalesce(category, 'Uncategorised') as category, count(*) as rows, count_if(weight = 'Blocking' and monitoring = 'Mandatory')::BIGINT as blocking,
  count_if(weight = 'High')::BIGINT as high, count_if(kpi_id in ('tracability', 'language', 'nothing'))::BIGINT as by_id
from o_applicable group by 1""",
)
def kpi_lookup(spark, sf):
    """Lookups by category, weight, id and blocking state, counted over the drafts they apply to."""
    rows = G.applicable_kpis(inputs.drafts_base(spark, sf).select("run_id", "origin", "channel"), _kpi_file(spark))
    return rows.groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(G.is_blocking()).alias("blocking"),
        F.count_if(F.col("weight") == "High").alias("high"),
        F.count_if(F.col("id").isin("tracability", "language", "nothing")).alias("by_id"),
    )


@query(
    "channel_norm",
    """select run_id, kpi_id, case when channel = 'chat' and length(kpi_id) % 2 = 1 then 'chat norm of ' else 'norm of ' end || kpi_id as norm
from o_applicable""",
)
def channel_norm(spark, sf):
    rows = G.applicable_kpis(inputs.drafts_base(spark, sf).select("run_id", "origin", "channel"), _kpi_file(spark))
    return rows.select("run_id", F.col("id").alias("kpi_id"), G.channel_norm(F.col("channel")).alias("norm"))


def results(spark, sf):
    return G.kpi_results(evaluated(spark, sf))


_RESULT = "run_id, kpi_id, value, passed, source"


@query("run_checks", f"select {_RESULT} from o_results where tier = 1")
def run_checks(spark, sf):
    return results(spark, sf).where("tier = 1").select(*_RESULT.split(", "))


@query("judge_normalise", f"select {_RESULT}, weight, monitoring from o_results where tier = 2")
def judge_normalise(spark, sf):
    return results(spark, sf).where("tier = 2").select(*_RESULT.split(", "), "weight", "monitoring")


_SCALE_ROWS = [(s, v, v in fixed.PASSING.get(s, ())) for s, vs in fixed.SCALES.items() for v in vs]


@query(
    "scale_passing",
    "select r.rubric, scale, r.value, coalesce(passing, false) as passing, count(*) as replies from replies_of_judges r join (values "
    + ", ".join(f"('{r}', '{s}')" for r, _, s in fixed.JUDGES)
    + ") j(rubric, scale) on j.rubric = r.rubric left join (values "
    + ", ".join(f"('{s}', '{v}', {str(p).lower()})" for s, v, p in _SCALE_ROWS)
    + ") s(scale, value, passing) using (scale, value) group by all",
)
def scale_passing(spark, sf):
    """Every reply against the scale of its rubric."""
    scales = spark.createDataFrame(_SCALE_ROWS, "scale string, value string, passing boolean")
    judges = spark.createDataFrame([(r, s) for r, _, s in fixed.JUDGES], "rubric string, scale string")
    counted = replies(spark, sf).groupBy("rubric", "value").agg(F.count(F.lit(1)).alias("replies"))
    named = join_small(counted, judges, ["rubric"], rows=10_000)
    return join_small(named, scales, ["scale", "value"], "left", rows=10_000).select(
        "rubric", "scale", "value", F.coalesce("passing", F.lit(False)).alias("passing"), "replies"
    )


@query("pending_steps", f"select {_RESULT} from o_results where tier = 3")
def pending_steps(spark, sf):
    return results(spark, sf).where("tier = 3").select(*_RESULT.split(", "))


@query("gate", "select run_id, kpi_id, value from o_results where stops")
def gate(spark, sf):
    return G.gate_rows(results(spark, sf)).select("run_id", "kpi_id", "value")


@query("short_circuit", "select run_id, count_if(tier = 2)::BIGINT as judged, count_if(tier = 1)::BIGINT as checked from o_results where run_id in (select run_id from o_early) group by 1")
def short_circuit(spark, sf):
    count = lambda t: F.size(F.filter("results", lambda r: r["tier"] == t)).cast("bigint")
    return evaluated(spark, sf).where("short_circuit").select("run_id", count(2).alias("judged"), count(1).alias("checked"))


@query(
    "strict_flip",
    "select strict, count(*) as rows, count_if(passed)::BIGINT as passed from o_results where source = 'skipped' group by 1",
)
def strict_flip(spark, sf):
    return (
        results(spark, sf).where("source = 'skipped'")
        .groupBy(F.coalesce("strict_mode", F.lit(False)).alias("strict"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("passed").alias("passed"))
    )


@query("maturity", "select run_id, category, maturity from o_maturity")
def maturity(spark, sf):
    return G.maturity_rows(results(spark, sf)).select("run_id", "category", "maturity")


@query("evaluate", "select run_id, passed, failed_blocking, maturity, steps, short_circuit, source from o_eval")
def evaluate(spark, sf):
    shown = F.array_join(
        F.array_sort(F.transform(F.map_entries("maturity_by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","
    )
    return evaluated(spark, sf).select(
        "run_id", "passed", F.array_join("failed_blocking", ",").alias("failed_blocking"), shown.alias("maturity"),
        F.array_join("dclp_steps_required", ",").alias("steps"), "short_circuit", "source",
    )


_COUNTS = """count_if(tier <> 3 and passed and source <> 'skipped')::BIGINT as passed, count_if(tier <> 3 and not passed)::BIGINT as failed,
  count_if(tier <> 3 and passed and source = 'skipped')::BIGINT as skipped, count_if(tier = 3)::BIGINT as pending from o_results group by all"""


@query(
    "report_counts",
    f"select run_id, tier::BIGINT as tier, {_COUNTS} union all select run_id, 0::BIGINT as tier, {_COUNTS}",
)
def report_counts(spark, sf):
    return G.report_counts(results(spark, sf)).withColumn("tier", F.col("tier").cast("bigint"))


@query(
    "report_order",
    """select run_id, kpi_id, case when tier = 3 then 'awaiting signoff' when source = 'skipped' then 'skipped' when passed then 'pass' else 'fail' end as status,
  row_number() over (partition by run_id order by passed, weight <> 'Blocking', kpi_id, tier) as place from o_results""",
)
def report_order(spark, sf):
    """Place of each result in the report of its draft; a draft has few results."""
    rows = evaluated(spark, sf).select(
        "run_id",
        F.posexplode_outer(
            F.array_sort(
                F.transform(
                    "results",
                    lambda r: F.struct(
                        r["passed"].alias("passed"), (r["weight"] != "Blocking").alias("soft"), r["kpi_id"].alias("kpi_id"),
                        r["tier"].alias("tier"), r["source"].alias("source"),
                    ),
                )
            )
        ).alias("i", "r"),
    ).where(F.col("r").isNotNull())
    return rows.select("run_id", "i", "r.*").select(
        "run_id", "kpi_id", G.status().alias("status"), (F.col("i") + 1).cast("bigint").alias("place")
    )


@query(
    "verdict",
    """select run_id, case when passed then '**Review:** Passed. No blocking KPI violations detected.'
  else '**Review:** Blocked by ' || len(string_split(failed_blocking, ',')) || ' KPI failure(s): ' ||
    array_to_string(list_transform(string_split(failed_blocking, ','), lambda i: '`' || i || '`'), ', ') || '.' end ||
  case when steps = '' then '' else chr(10) || chr(10) || '**Human signoff:** ' || len(string_split(steps, ',')) || ' dCLP step(s) still required.' end as verdict
from o_eval""",
)
def verdict(spark, sf):
    return evaluated(spark, sf).select("run_id", G.verdict().alias("verdict"))
