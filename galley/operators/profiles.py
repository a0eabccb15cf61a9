"""Which profiles serve a request, and changes to the profile catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from galley import fixed
from galley.functions import text as T
from galley.operators.scale import catalogue, in_ranges, join_small

BUNDLE = "array<struct<id:string,name:string,category:string,reason:string>>"


def _entry(p: dict) -> Column:
    return F.struct(
        F.lit(p["id"]).alias("id"),
        F.lit(p["name"]).alias("name"),
        F.lit(p["category"]).alias("category"),
        F.lit(None).cast("string").alias("reason"),
    )


def _picked(cases: list[Column]) -> Column:
    if not cases:
        return F.array().cast(BUNDLE)
    return F.filter(F.array(*cases), lambda p: p.isNotNull()).cast(BUNDLE)


def match_workflow(codes: Column, profiles: Sequence[dict] = fixed.PROFILES) -> Column:
    """Workflow profiles that serve one of the task codes, in catalogue order."""
    return _picked(
        [
            F.when(F.arrays_overlap(codes, T.strings(p["codes"])), _entry(p))
            for p in profiles
            if p["category"] == "workflow"
        ]
    )


def match_experts(sector: Column, keywords: Column, profiles: Sequence[dict] = fixed.PROFILES) -> Column:
    """Experts of the sector; with keywords, only those that share one."""
    asked = F.transform(keywords, F.lower)
    return _picked(
        [
            F.when(
                (sector == p["sector"])
                & (
                    (F.size(keywords) == 0)
                    | F.arrays_overlap(asked, T.strings([k.lower() for k in p["keywords"]]))
                ),
                _entry(p),
            )
            for p in profiles
            if p["category"] == "domain_expert" and p["sector"]
        ]
    )


def select_profiles(intents: DataFrame, profiles: Sequence[dict] | DataFrame = fixed.PROFILES) -> DataFrame:
    """Add the matched profiles. The catalogue is configuration, so this is a projection; a table is taken by id."""
    profiles = catalogue(profiles, "id")
    return intents.withColumns(
        {
            "workflow": match_workflow(F.col("task_codes"), profiles),
            "domain_expert": match_experts(F.col("sector"), F.col("topic_keywords"), profiles),
            "profile_source": F.lit("deterministic"),
        }
    )


def ids(bundle: Column) -> Column:
    return F.transform(bundle, lambda p: p["id"])


def names(bundle: Column) -> Column:
    return F.transform(bundle, lambda p: p["name"])


PICKS = "struct<workflow_ids:array<string>,domain_expert_ids:array<string>,reasons:map<string,string>>"


def reconcile_picks(selected: DataFrame, replies: DataFrame, profiles: Sequence[dict] = fixed.PROFILES) -> DataFrame:
    """Take the ids a model proposes, as far as they are known, in its order.

    ``replies`` holds at most one row per run_id with the text ``profile_reply``.
    A run with no usable id keeps the matched profiles.
    """

    def known(proposed: Column, reasons: Column, category: str) -> Column:
        rows = [p for p in profiles if p["category"] == category]
        table = F.create_map(*[c for p in rows for c in (F.lit(p["id"]), F.lit(p["name"]))])
        return F.transform(
            F.filter(F.coalesce(proposed, T.strings([])), lambda i: F.array_contains(F.map_keys(table), i)),
            lambda i: F.struct(
                i.alias("id"),
                F.element_at(table, i).alias("name"),
                F.lit(category).alias("category"),
                F.coalesce(
                    F.nullif(F.element_at(reasons, i), F.lit("")), F.lit("Selected by LLM.")
                ).alias("reason"),
            ),
        ).cast(BUNDLE)

    r = F.from_json(T.unfence(F.col("profile_reply")), PICKS)
    reasons = F.coalesce(F.col("_r.reasons"), F.create_map().cast("map<string,string>"))
    staged = (
        selected.join(replies.select("run_id", "profile_reply"), "run_id", "left")
        .withColumn("_r", r)
        .withColumns(
            {
                "_w": known(F.col("_r.workflow_ids"), reasons, "workflow"),
                "_d": known(F.col("_r.domain_expert_ids"), reasons, "domain_expert"),
            }
        )
    )
    usable = (F.size("_w") + F.size("_d")) > 0
    return staged.withColumns(
        {
            "workflow": F.when(usable, F.col("_w")).otherwise(F.col("workflow")),
            "domain_expert": F.when(usable, F.col("_d")).otherwise(F.col("domain_expert")),
            "profile_source": F.when(usable, "llm").otherwise(F.col("profile_source")),
        }
    ).drop("_r", "_w", "_d", "profile_reply")


# ---- catalogue changes ----------------------------------------------------


def clean_list(items: Column) -> Column:
    return F.filter(
        F.transform(F.coalesce(items, T.strings([])), T.strip), lambda i: i != ""
    )


def _checked(changes: DataFrame) -> DataFrame:
    """Changes with cleaned texts, the id they are about (``_key``), and what can be said without the catalogue (``_static``)."""
    c = changes.withColumns(
        {n: T.strip(F.col(n)) for n in ("id", "name", "description")}
    ).withColumn("keywords", clean_list(F.col("keywords")))
    valid = F.coalesce(
        F.length("id").between(1, 80)
        & F.rlike("id", F.lit(fixed.PROFILE_ID))
        & F.length("name").between(1, 160)
        & F.length("description").between(1, 2000)
        & F.col("category").isin(*fixed.PROFILE_CATEGORIES),
        F.lit(False),
    )
    moved = (F.col("op") == "update") & ~(
        F.col("category").eqNullSafe(F.col("target_category")) & F.col("id").eqNullSafe(F.col("target_id"))
    )
    return c.withColumns({
        "_key": F.when(F.col("op") == "create", F.col("id")).otherwise(F.col("target_id")),
        "_static": F.when(~(valid | (F.col("op") == "delete")), "invalid").when(moved, "rejected"),
    })


#: An id's place: in no category, or in the one of this number from 1.
_PLACES = {c: i + 1 for i, c in enumerate(fixed.PROFILE_CATEGORIES)}


def _step(op: str, target: int, place: int) -> tuple[str, int]:
    """Outcome of a change of an id in ``place``, and the place after it."""
    if op == "create":
        return ("conflict", place) if place else ("applied", target)
    if not target or place != target:
        return "not_found", place
    return "applied", (0 if op == "delete" else place)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _border_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range of changes makes of the places of its first and its last id, for every place before it."""
    part, first, last = None, None, None
    for batch in batches:
        for part, key, static, op, target in _columns(batch, "_part", "_key", "_static", "op", "_target"):
            if last is None or last[0] != key:
                last = [key, list(range(len(_PLACES) + 1))]
                first = first or last
            if static is None:
                last[1] = [_step(op, target, p)[1] for p in last[1]]
    if first:
        out = [first] if first is last else [first, last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(out), pa.int32()), pa.array([k for k, _ in out]).cast(pa.string()), pa.array([m for _, m in out])],
            names=["part", "key", "places"],
        )


def judge_changes(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of each change, one after the other: applied, invalid, conflict, rejected or not_found.

    Changes hold change_id, op (create, update or delete), target_category and
    target_id, and the new category, id, name, description and keywords. They
    take effect in the order of change_id: an id that was deleted may be created
    again. Changes of equal change_id follow in the order of op.

    The feed is cut into ranges of (id, change_id). What a range does to an id is
    a function of the id's place before it (in no category, or in one of them),
    and such functions compose; so an id with most of all changes is judged by
    many tasks, each starting from the place that the ranges before lead to. Only
    an id on the border of two ranges needs that: two small functions per range.
    """
    have = catalogue.select(F.col("id").alias("_key"), F.col("category").alias("_have"))
    number = lambda c: F.coalesce(*[F.when(F.col(c) == name, n) for name, n in _PLACES.items()], F.lit(0))
    target = F.when(F.col("op") == "create", number("category")).otherwise(number("target_category"))
    # many changes may name one id, so the change feed stays put when the catalogue is small
    placed = join_small(_checked(changes), have, ["_key"], "left").withColumns({"_place": number("_have"), "_target": target})
    cut = in_ranges(placed, ["_key"], ["change_id", "op"])
    columns = ["_part", "_key", "_static", "op", "_target", "_place"]
    borders = cut.select(*columns).mapInArrow(_border_ids, "part int, key string, places array<bigint>").orderBy("part").collect()

    # per range: the function of all ranges before on the id it begins with
    carried: dict[int, list[int]] = {}
    key, places = None, None
    by_part: dict[int, list] = {}
    for r in borders:
        by_part.setdefault(r.part, []).append((r.key, r.places))
    for part, ids in sorted(by_part.items()):
        for at, (k, p) in enumerate(ids):
            if places is not None and k == key:
                if at == 0:
                    carried[part] = places
                places = [p[x] for x in places]
            else:
                key, places = k, p

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, started = None, 0, False
        for batch in batches:
            found = []
            for part, key, static, op, target, before in _columns(batch, *columns):
                if not started or key != now:
                    place = carried[part][before] if not started and part in carried else before
                    now, started = key, True
                outcome = static
                if static is None:
                    outcome, place = _step(op, target, place)
                found.append(outcome)
            yield batch.append_column("outcome", pa.array(found, pa.string()))

    schema = S.StructType([*cut.schema.fields, S.StructField("outcome", S.StringType())])
    private = ["_key", "_static", "_have", "_place", "_target", "_part"]
    return cut.mapInArrow(outcomes, schema).drop(*private)


def apply_changes(catalogue: DataFrame, judged: DataFrame) -> DataFrame:
    """The catalogue after the applied changes; of several on one id the last wins."""
    last = (
        judged.where(F.col("outcome") == "applied")
        .withColumn("_key", F.when(F.col("op") == "create", F.col("id")).otherwise(F.col("target_id")))
        .groupBy("_key")
        .agg(F.max_by(F.struct("op", "id", "name", "description", "category", "keywords"), "change_id").alias("c"))
    )
    kept = catalogue.join(last, F.col("id") == F.col("_key"), "left_anti")
    new = last.where(F.col("c.op") != "delete").select(
        "c.id", "c.name", "c.description", "c.category", "c.keywords"
    )
    return kept.select("id", "name", "description", "category", "keywords").unionByName(new)
