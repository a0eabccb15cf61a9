"""KPI catalogue, judge replies, gate and maturity of drafts.

A draft is evaluated in its own row: the only join brings its judge replies,
at most one row per draft. Long tables come from unnesting the result array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T
from galley.operators import checks
from galley.operators.scale import catalogue, join_skewed

RESULT = (
    "struct<kpi_id:string,name:string,cluster:string,category:string,weight:string,monitoring:string,"
    "indicator:string,value:string,raw_metric:string,reason:string,tier:int,passed:boolean,source:string>"
)


# ---- catalogue ------------------------------------------------------------


def seed_kpis() -> list[dict]:
    """The seed catalogue with its defaults filled in."""
    return [
        {
            "id": i, "name": i, "category": cat, "cluster_short": None,
            "weight": w or "Medium", "monitoring": m or "Optional", "indicator": ind,
            "norm": None, "norm_chat": None, "norm_messages": None,
            "relevance": dict(zip(fixed.ORIGINS, rel)),
        }
        for i, cat, w, m, ind, *rel in fixed.KPIS
    ]


def relevance_state(cell: Column) -> Column:
    """yes, conditional or no; an empty cell means yes."""
    v = F.lower(T.strip(cell))
    return (
        F.when(cell.isNull(), "yes")
        .when(F.startswith(v, F.lit("only applicable")), "conditional")
        .when(F.startswith(v, F.lit("applicable")) | (v == "need"), "yes")
        .otherwise("no")
    )


def applicability(kpis: DataFrame, include_conditional: bool = False) -> DataFrame:
    """(origin, channel, KPI) rows of a catalogue table."""
    allowed = ("yes", "conditional") if include_conditional else ("yes",)
    spread = kpis.withColumns(
        {
            "origin": F.explode(T.strings(fixed.ORIGINS)),
        }
    ).withColumn("channel", F.explode(T.strings(fixed.CHANNELS)))
    cell = lambda c: relevance_state(F.try_element_at("relevance", F.col(c)))
    return spread.where(cell("origin").isin(*allowed) & cell("channel").isin(*allowed))


def applicable_kpis(drafts: DataFrame, kpis: DataFrame, include_conditional: bool = False) -> DataFrame:
    """One row per draft and applicable KPI."""
    return join_skewed(
        drafts, applicability(kpis, include_conditional), ["origin", "channel"], ["run_id"], rows=100_000
    )


def channel_norm(channel: Column) -> Column:
    pick = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(
        F.when(channel == "chat", pick("norm_chat")).when(channel == "messages", pick("norm_messages")),
        F.col("norm"),
    )


def is_blocking() -> Column:
    return (F.col("weight") == "Blocking") & (F.col("monitoring") == "Mandatory")


def by_category(kpis: DataFrame) -> DataFrame:
    return kpis.groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(
        F.count(F.lit(1)).alias("kpis"), F.count_if(is_blocking()).alias("blocking")
    )


def _applies(kpi: dict, include_conditional: bool = False) -> Column:
    """Whether a KPI of a catalogue list applies to the origin and channel of the row."""
    allowed = {"yes", "conditional"} if include_conditional else {"yes"}

    def state(cell: str | None) -> str:
        if cell is None:
            return "yes"
        v = cell.strip().lower()
        if v.startswith("only applicable"):
            return "conditional"
        return "yes" if v.startswith("applicable") or v == "need" else "no"

    def among(column: str, names: Sequence[str]) -> str:
        fit = [n for n in names if state(kpi["relevance"].get(n)) in allowed]
        return f"{column} in ({', '.join(map(_sql, fit))})" if fit else "false"

    return F.expr(f"{among('origin', fixed.ORIGINS)} and {among('channel', fixed.CHANNELS)}")


def _sql(v) -> str:
    """A constant as SQL text."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v).lower()


def _row(kpi: dict, tier: int, value, passed, reason, source, indicator=None, raw=None) -> Column:
    fields = {
        "kpi_id": kpi["id"], "name": kpi["name"], "cluster": kpi["cluster_short"], "category": kpi["category"],
        "weight": kpi["weight"], "monitoring": kpi["monitoring"],
        "indicator": kpi["indicator"] if indicator is None else indicator, "value": value, "raw_metric": raw,
        "reason": reason, "tier": tier, "passed": passed, "source": source,
    }
    if not any(isinstance(v, Column) for v in fields.values()):
        return F.expr(
            "named_struct(" + ", ".join(f"{_sql(n)}, {_sql(v)}" for n, v in fields.items()) + ")"
        ).cast(RESULT)
    lit = lambda v: v if isinstance(v, Column) else F.expr(_sql(v))
    return F.struct(*[lit(v).alias(n) for n, v in fields.items()]).cast(RESULT)


def _some(rows: list[Column]) -> Column:
    if not rows:
        return F.array().cast(f"array<{RESULT}>")
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


# ---- the three tiers ------------------------------------------------------


def tier1(kpis: Sequence[dict], active: Mapping[str, Callable[[], Column]] = checks.ACTIVE) -> Column:
    """Results of the active checks; expects the columns of ``checks.features``.

    A check without a result for a draft gives a failing row there (``checks.isolated``).
    """
    by_id = {k["id"]: k for k in kpis}

    def row(kpi: dict, when: Column) -> Column:
        return F.when(
            when,
            T.let(
                checks.isolated(active[kpi["id"]]()),
                lambda v: _row(
                    kpi, 1, v["value"], v["passed"], v["reason"], v["source"],
                    F.coalesce(v["indicator"], F.lit(kpi["indicator"])), v["raw_metric"],
                ),
            ),
        )

    rows = [row(k, _applies(k)) for k in kpis if k["id"] in active]
    extra = {
        "approved_source_content_for_genai": F.coalesce(F.size("citations"), F.lit(0)) > 0,
        "language": F.coalesce(F.col("language"), F.lit("")) != "",
    }
    for kpi_id, wanted in extra.items():
        if kpi_id in by_id:
            rows.append(row(by_id[kpi_id], wanted & ~_applies(by_id[kpi_id])))
    return _some(rows)


REPLIES = "map<string,struct<value:string,reason:string>>"


def collect_replies(replies: DataFrame) -> DataFrame:
    """One row per run: rubric to (value, reason); of several replies the last by ``seq`` counts.

    A run has at most one entry per known rubric, so the map stays small
    however many replies a run has.
    """
    last = (
        replies.where(F.col("rubric").isin(*[j[0] for j in fixed.JUDGES]))
        .groupBy("run_id", "rubric")
        .agg(F.max_by(F.struct("value", "reason"), "seq").alias("reply"))
    )
    return last.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rubric", "reply"))).cast(REPLIES).alias("judge_replies")
    )


def tier2(kpis: Sequence[dict]) -> Column:
    """Judge results in rubric order; without any reply for a run they are skipped."""
    by_id = {k["id"]: k for k in kpis}
    rows = []
    for rubric, kpi_id, scale in fixed.JUDGES:
        if kpi_id not in by_id:
            continue
        kpi = by_id[kpi_id]
        reply = F.try_element_at("judge_replies", F.lit(rubric))
        skipped = _row(kpi, 2, "not_evaluated", True, "no LLM configured (stub mode)", "skipped", scale)
        good = _row(
            kpi, 2, reply["value"], reply["value"].isin(*fixed.PASSING.get(scale, ("",))),
            F.coalesce(reply["reason"], F.lit("")), "llm", scale,
        )
        bad = _row(kpi, 2, "unknown", False, "judge error: no usable reply", "llm", scale)
        known = F.coalesce(reply["value"].isin(*fixed.SCALES[scale]), F.lit(False))
        rows.append(
            F.when(
                _applies(kpi),
                F.when(F.col("judge_replies").isNull(), skipped).when(known, good).otherwise(bad),
            )
        )
    return _some(rows)


def strict_flip(results: Column, strict: Column) -> Column:
    """Under strict mode a skipped judge counts as failed."""
    reason = F.lit("strict mode: LLM judge required but not configured")
    flipped = F.transform(
        results,
        lambda r: F.when(
            r["source"] == "skipped",
            r.withField("passed", F.lit(False)).withField("reason", reason),
        ).otherwise(r),
    )
    return F.when(strict, flipped).otherwise(results)


def tier3(kpis: Sequence[dict]) -> Column:
    """Human steps still to be signed off."""
    by_id = {k["id"]: k for k in kpis}
    return _some(
        [
            F.when(
                _applies(by_id[s]),
                _row(by_id[s], 3, "no", False, "dCLP step not yet completed", "deterministic", "YesNoScale"),
            )
            for s in fixed.HUMAN_STEPS
            if s in by_id
        ]
    )


# ---- gate and rollup ------------------------------------------------------


def blocks(r, origin: Column, strict: Column) -> Column:
    """Whether one result stops the draft; ``r`` is a result struct or a row's columns."""
    get = (lambda n: r[n]) if isinstance(r, Column) else F.col
    hard = strict & (get("weight") == "Blocking") & (get("monitoring") == "Mandatory") & ~get("passed")
    exempt = (get("source") == "skipped") | (get("value") == "unknown")
    untraced = (origin == "genai_knowledge") & (get("value") == "not_used")
    by_value = F.lit(False)
    for kpi, values in fixed.BLOCKING_VALUES.items():
        by_value = by_value | ((get("kpi_id") == kpi) & get("value").isin(*values))
    soft = F.when(get("kpi_id") == "tracability", untraced).otherwise(by_value)
    return (get("tier") != 3) & (hard | (~exempt & soft))


def gate(results: Column, origin: Column, strict: Column) -> Column:
    """Ids of the KPIs that stop the draft, in result order."""
    return F.transform(
        F.filter(results, lambda r: blocks(r, origin, strict)), lambda r: r["kpi_id"]
    )


def level(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "low").when(ratio < 0.8, "medium").otherwise("high")


def maturity(results: Column) -> Column:
    """map<category, level> of one draft, human steps left out."""
    machine = F.filter(results, lambda r: r["tier"] != 3)
    category = lambda r: F.coalesce(F.nullif(r["category"], F.lit("")), F.lit("Uncategorised"))

    def rate(rows: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(rows, category)),
                lambda c: T.let(
                    F.filter(rows, lambda r: category(r) == c),
                    lambda mine: F.struct(
                        c, level(F.size(F.filter(mine, lambda r: r["passed"])) / F.size(mine))
                    ),
                ),
            )
        )

    return T.let(machine, rate)


def evaluate(drafts: DataFrame, replies: DataFrame | None = None, kpis: Sequence[dict] | DataFrame | None = None) -> DataFrame:
    """The whole evaluation, one row per draft.

    ``replies`` holds run_id, rubric, value, reason and seq. A draft stopped
    by tier 1 gets no judge results.
    """
    kpis = seed_kpis() if kpis is None else catalogue(kpis, "ord")
    # the texts end here: what is joined with the replies are results, a few hundred bytes a draft
    first = checks.features(drafts).select(
        "run_id", "channel", "origin", "strict_mode", tier1(kpis).alias("r1"), tier3(kpis).alias("r3")
    )
    if replies is None:
        first = first.withColumn("judge_replies", F.lit(None).cast(REPLIES))
    else:
        # a stored reply has a few bytes and a map of replies close to a thousand, so Spark would take them for small enough to broadcast
        first = first.join(collect_replies(replies).hint("merge"), "run_id", "left")
    origin, strict = F.col("origin"), F.coalesce("strict_mode", F.lit(False))
    early = first.withColumn("early", gate(F.col("r1"), origin, strict))
    stopped = F.size("early") > 0
    second = early.withColumn(
        "r2",
        F.when(stopped, F.array().cast(f"array<{RESULT}>")).otherwise(strict_flip(tier2(kpis), strict)),
    )
    third = second.withColumn("results", F.concat("r1", "r2", "r3"))
    done = third.withColumns(
        {
            "failed_blocking": F.when(stopped, F.col("early")).otherwise(gate(F.col("results"), origin, strict)),
            "maturity_by_category": maturity(F.col("results")),
            "dclp_steps_required": F.transform("r3", lambda r: r["kpi_id"]),
            "source": F.when(~stopped & F.col("judge_replies").isNotNull(), "llm").otherwise("deterministic"),
            "reasoning": F.when(stopped, "Tier 1 short-circuit on material generation blocker").otherwise(
                "evaluated with softened generation gate across tier 1+2+3"
            ),
            "short_circuit": stopped,
        }
    )
    return done.select(
        "run_id", (F.size("failed_blocking") == 0).alias("passed"), "failed_blocking", "results",
        "maturity_by_category", "dclp_steps_required", "channel", "origin", "strict_mode", "source",
        "reasoning", "short_circuit",
    )


def kpi_results(evaluated: DataFrame) -> DataFrame:
    """One row per draft and KPI result, in result order."""
    return (
        evaluated.select("run_id", "origin", "strict_mode", F.posexplode_outer("results").alias("ord", "r"))
        .where(F.col("r").isNotNull())
        .select("run_id", "origin", "strict_mode", "ord", "r.*")
    )


# ---- the same over a long result table ------------------------------------


def gate_rows(results: DataFrame) -> DataFrame:
    """Blocking rows of a long result table with origin and strict_mode."""
    return results.where(blocks(None, F.col("origin"), F.coalesce("strict_mode", F.lit(False))))


def maturity_rows(results: DataFrame) -> DataFrame:
    return (
        results.where(F.col("tier") != 3)
        .groupBy("run_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorised")).alias("category"))
        .agg(F.avg(F.col("passed").cast("double")).alias("ratio"))
        .withColumn("maturity", level(F.col("ratio")))
    )


def status() -> Column:
    return (
        F.when(F.col("tier") == 3, "awaiting signoff")
        .when(F.col("source") == "skipped", "skipped")
        .when(F.col("passed"), "pass")
        .otherwise("fail")
    )


def report_counts(results: DataFrame) -> DataFrame:
    """Counts per draft and tier, and per draft over all tiers (tier 0)."""
    machine = F.col("_tier") != 3
    skipped = F.col("source") == "skipped"
    # the total rows have a null tier, so tests use a copy
    copied = results.withColumn("_tier", F.col("tier"))
    return (
        copied.groupingSets([["run_id", "tier"], ["run_id"]], "run_id", "tier")
        .agg(
            F.count_if(machine & F.col("passed") & ~skipped).alias("passed"),
            F.count_if(machine & ~F.col("passed")).alias("failed"),
            F.count_if(machine & F.col("passed") & skipped).alias("skipped"),
            F.count_if(~machine).alias("pending"),
        )
        .withColumn("tier", F.coalesce("tier", F.lit(0)))
    )


def report_order() -> list[Column]:
    """Sort keys of a report: failing first, blocking first, then by id."""
    return [F.col("passed").asc(), (F.col("weight") != "Blocking").asc(), F.col("kpi_id").asc()]


def verdict() -> Column:
    """Verdict sentence of an evaluation row."""
    n = F.size("failed_blocking")
    names = F.array_join(F.transform("failed_blocking", lambda i: F.concat(F.lit("`"), i, F.lit("`"))), ", ")
    line = (
        F.when(F.col("passed"), "**Review:** Passed. No blocking KPI violations detected.")
        .when(n > 0, F.concat(F.lit("**Review:** Blocked by "), n.cast("string"), F.lit(" KPI failure(s): "), names, F.lit(".")))
        .otherwise("**Review:** Needs attention. No blocking KPI IDs were returned.")
    )
    steps = F.size("dclp_steps_required")
    signoff = F.concat(
        F.lit("\n\n**Human signoff:** "), steps.cast("string"), F.lit(" dCLP step(s) still required.")
    )
    return F.when(steps > 0, F.concat(line, signoff)).otherwise(line)
