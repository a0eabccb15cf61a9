"""Whole runs: from request to evaluated draft, with the events of every stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.operators import audit as A
from galley.operators import drafts as D
from galley.operators import evaluate as G
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import refine as X
from galley.operators import retrieval as R
from galley.session import cut_lineage


def run(
    requests: DataFrame,
    nodes: DataFrame,
    chunks: DataFrame,
    available: Sequence[str],
    draft_replies: DataFrame | None = None,
    judge_replies: DataFrame | None = None,
    profiles: Sequence[dict] = fixed.PROFILES,
    **wording: str,
) -> tuple[DataFrame, DataFrame]:
    """(runs, events) of many requests.

    Requests that are to be asked first stop with their questions. For the
    others the refined prompt is classified again and drafted from the first
    retrieval. Requests are few next to the corpora, so the stages between the
    searches are written once instead of computed by every reader.
    """
    selected = P.select_profiles(I.classify(requests, profiles=profiles), profiles)
    queries = cut_lineage(R.build_query(selected, available))
    snippets, searched = R.retrieve(queries, nodes, chunks)
    arrays = cut_lineage(D.snippet_arrays(snippets))
    counts = arrays.select("run_id", F.size("snippets").cast("bigint").alias("snippet_count"))
    known = queries.join(counts, "run_id", "left").withColumn(
        "snippet_count", F.coalesce("snippet_count", F.lit(0).cast("bigint"))
    )
    refined = cut_lineage(X.refine(known, profiles=profiles).withColumn("status", X.run_status()))

    going = refined.where("done").withColumns(
        {
            "task_codes": F.col("new_task_codes"), "sector": F.col("new_sector"),
            "topic_keywords": F.col("new_topic_keywords"), "language": F.col("new_language"),
        }
    ).join(arrays, "run_id", "left")
    drafted = D.draft(going, draft_replies, **wording)
    flagged = F.transform(
        F.coalesce("snippets", F.array().cast(arrays.schema["snippets"].dataType)),
        lambda s: s.withField("exclude_for_genai", F.lit(False)),
    )
    option = lambda name, default: (
        F.coalesce(name, F.lit(default)) if name in requests.columns else F.lit(default)
    )
    graded = drafted.withColumns(
        {
            "snippets": flagged, "channel": option("channel", "web"), "origin": option("origin", "instant"),
            "strict_mode": option("strict_mode", False),
        }
    )
    evaluated = G.evaluate(graded, judge_replies)
    done = drafted.select("run_id", "body", "citations", "draft_source", "language", "task_codes").join(
        evaluated.select("run_id", "passed", "failed_blocking", "maturity_by_category", "results"), "run_id"
    )
    runs = refined.select(
        "run_id", "status", "questions", "refined_prompt", "needs_re_retrieval", "snippet_count"
    ).join(done, "run_id", "left")
    events = A.all_events(
        A.intent_events(queries), A.profile_events(queries), A.retrieval_events(searched),
        A.refinement_events(refined), A.generation_events(drafted), A.evaluation_events(evaluated),
        A.stage_event(
            runs, "run_pipeline", F.lit("system"), None, F.struct("status", F.col("passed").alias("evaluation_passed"))
        ),
    )
    return runs, events
