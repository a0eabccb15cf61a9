"""What a request asks for: tasks, sector, keywords and language.

All rules are column expressions over the prompt; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T


def task_codes(lower: Column) -> Column:
    found = F.filter(
        F.array(*[F.when(T.contains_any(lower, hints), F.lit(code)) for code, hints in fixed.TASK_HINTS]),
        lambda c: c.isNotNull(),
    )
    return T.let(
        found, lambda a: F.when(F.size(a) == 0, T.strings([fixed.DEFAULT_TASK])).otherwise(a)
    )


def sector(lower: Column) -> Column:
    return F.when(T.contains_any(lower, fixed.SECTOR_HINTS), F.lit(fixed.SECTOR))


def _wide(pattern: str) -> str:
    """Let white space in a pattern match all Unicode spaces, and dots all but newlines."""
    return "(?d)" + pattern.replace(r"\s", fixed.SPACE)


def _last_match(lower: Column, pattern: str) -> Column:
    """struct<start, lang> of the last match, null without one.

    What follows the last match is the last piece of a split, so its end, and
    with the matched text its start, need no search by position.
    """
    p = _wide(pattern)
    name = F.element_at(T.matches(lower, p, 1), -1)
    end = F.length(lower) - F.length(F.element_at(F.split(lower, p), -1))
    start = end - F.length(F.element_at(T.matches(lower, p, 0), -1))
    lang = F.element_at(
        F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_NAMES.items() for x in kv]), name
    )
    return F.when(F.rlike(lower, F.lit(p)), F.struct(start.alias("start"), lang.alias("lang")))


def target_language(lower: Column) -> Column:
    """The output language named in the prompt; the mention that starts last wins."""
    both = F.rlike(lower, F.lit(_wide(fixed.BOTH_LANGUAGES))) | F.contains(
        F.concat(F.lit(" "), lower, F.lit(" ")), F.lit(" both ")
    )
    first, second = [_last_match(lower, p) for p in fixed.TARGET_LANGUAGE]
    pair = F.array(first, second)
    last = T.let(
        pair,
        lambda a: F.when(a[0].isNull(), a[1]["lang"])
        .when(a[1].isNull(), a[0]["lang"])
        .when(a[0]["start"] > a[1]["start"], a[0]["lang"])
        .otherwise(a[1]["lang"]),
    )
    return F.when(both, F.lit("both")).otherwise(last)


def prompt_language(lower: Column) -> Column:
    """The language the prompt is written in, when its signals are clear."""
    padded = F.concat(F.lit(" "), lower, F.lit(" "))
    counts = F.struct(
        T.count_present(padded, fixed.PROMPT_SIGNALS["nl"]).alias("nl"),
        T.count_present(padded, fixed.PROMPT_SIGNALS["en"]).alias("en"),
    )
    return T.let(
        counts,
        lambda c: F.when((c["nl"] >= 2) & (c["nl"] > c["en"]), "nl").when(
            (c["en"] >= 2) & (c["en"] > c["nl"]), "en"
        ),
    )


def keyword_vocabulary(profiles: Sequence[dict] = fixed.PROFILES) -> list[str]:
    """Keywords of the expert profiles in order; the first spelling of a keyword stays."""
    seen: dict[str, str] = {}
    for p in profiles:
        if p["category"] == "domain_expert":
            for k in p["keywords"]:
                seen.setdefault(k.lower(), k)
    return list(seen.values())


def keywords(lower: Column, profiles: Sequence[dict] = fixed.PROFILES) -> Column:
    """Catalogue keywords that occur, whole or by their first two longer parts."""

    def occurs(keyword: str) -> Column:
        low = keyword.lower()
        hit = F.contains(lower, F.lit(low))
        parts = [p for p in re.split(r"[^a-z0-9]+", low) if len(p) >= 3][:2]
        if parts:
            every = F.contains(lower, F.lit(parts[0]))
            for p in parts[1:]:
                every = every & F.contains(lower, F.lit(p))
            hit = hit | every
        return hit

    vocabulary = keyword_vocabulary(profiles)
    if not vocabulary:
        return T.strings([])
    return F.filter(
        F.array(*[F.when(occurs(k), F.lit(k)) for k in vocabulary]), lambda k: k.isNotNull()
    )


def classify(requests: DataFrame, prompt: str = "user_prompt", profiles: Sequence[dict] = fixed.PROFILES) -> DataFrame:
    """Add the intent of each request; a set ``output_language`` wins over the prompt."""
    lower = F.col("_lower")
    staged = requests.withColumn("_lower", F.lower(prompt)).withColumns(
        {
            "task_codes": task_codes(lower),
            "sector": sector(lower),
            "topic_keywords": keywords(lower, profiles),
            "target_language": target_language(lower),
            "prompt_language": prompt_language(lower),
        }
    )
    wanted = F.col("output_language") if "output_language" in requests.columns else F.lit(None)
    clear = (F.col("task_codes")[0] != fixed.DEFAULT_TASK) | F.contains(lower, F.lit("write"))
    return staged.withColumns(
        {
            "role": F.lit(fixed.ROLE),
            "language": F.coalesce(wanted, "target_language", "prompt_language"),
            "confidence": F.when(clear, fixed.CONFIDENCE_CLEAR).otherwise(fixed.CONFIDENCE_PLAIN),
            "task_reason": F.concat(
                F.lit("Detected "), F.col("task_codes")[0], F.lit(" from keyword and task-shape heuristics.")
            ),
            "intent_source": F.lit("deterministic"),
        }
    ).drop("_lower")


REPLY = (
    "struct<role:string,task_codes:array<string>,confidence:double,task_reason:string,"
    "sector:string,topic_keywords:array<string>,language:string>"
)


def merge_replies(intents: DataFrame, replies: DataFrame) -> DataFrame:
    """Take the model's reading of a request where its reply is usable.

    ``replies`` holds at most one row per run_id with the text ``intent_reply``.
    A reply must be complete and use known values; the language the prompt asks
    for, and a set ``output_language``, stay in force.
    """
    joined = intents.join(replies.select("run_id", "intent_reply"), "run_id", "left").withColumn(
        "_r", F.from_json(T.unfence(F.col("intent_reply")), REPLY)
    )
    r = F.col("_r")
    language = F.coalesce("target_language", r["language"])
    good = (
        r["role"].isNotNull()
        & (F.size(r["task_codes"]) > 0)
        & (F.size(F.array_except(r["task_codes"], T.strings(fixed.TASK_CODES))) == 0)
        & r["confidence"].between(0.0, 1.0)
        & r["task_reason"].isNotNull()
        & F.coalesce(language.isin("en", "nl", "both"), F.lit(True))
    )
    good = F.coalesce(good, F.lit(False))
    wanted = F.col("output_language") if "output_language" in intents.columns else F.lit(None)
    take = lambda new, old: F.when(F.col("_good"), new).otherwise(F.col(old))
    return (
        joined.withColumn("_good", good)
        .withColumns(
            {
                "role": take(r["role"], "role"),
                "task_codes": take(r["task_codes"], "task_codes"),
                "confidence": take(r["confidence"], "confidence"),
                "task_reason": take(r["task_reason"], "task_reason"),
                "sector": take(r["sector"], "sector"),
                "topic_keywords": take(
                    F.coalesce(r["topic_keywords"], T.strings([])), "topic_keywords"
                ),
                "language": take(F.coalesce(wanted, language), "language"),
                "intent_source": take(F.lit("llm"), "intent_source"),
            }
        )
        .drop("_r", "_good", "intent_reply")
    )
