"""Clarification questions, answers and topic pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import retrieval as R

QUESTIONS = "array<struct<question:string,choices:array<string>>>"
PRODUCT = "the service"


def conversation_language(prompt: Column, language: Column) -> Column:
    return F.coalesce(I.prompt_language(F.lower(prompt)), language)


def _question(kind: str, dutch: Column, product: str) -> Column:
    def one(lang: str) -> Column:
        text, choices = fixed.QUESTION_WORDING[kind][lang]
        return F.struct(
            F.lit(text.format(product=product)).alias("question"), T.strings(choices).alias("choices")
        )

    return F.when(dutch, one("nl")).otherwise(one("en"))


def questions(product: str = PRODUCT) -> Column:
    """Questions of a request with language, topic_keywords, conversation_language and snippet_count.

    A null snippet_count means that nothing was searched.
    """
    dutch = F.coalesce(F.coalesce("conversation_language", "language") == "nl", F.lit(False))
    audience = F.exists("topic_keywords", lambda k: F.contains(F.lower(k), F.lit("audience")))
    asked = F.filter(
        F.array(
            F.when(F.col("language").isNull(), _question("language", dutch, product)),
            F.when(~audience, _question("audience", dutch, product)),
            F.when(F.col("snippet_count") == 0, _question("sources", dutch, product)),
        ),
        lambda q: q.isNotNull(),
    )
    scope = F.array(_question("scope", dutch, product))
    return T.let(
        asked, lambda a: F.slice(F.when(F.size(a) == 0, scope).otherwise(a), 1, fixed.MAX_QUESTIONS)
    ).cast(QUESTIONS)


def apply_answers(prompt: Column, answers: Column, language: Column) -> Column:
    """The prompt with the non-blank answers listed below it.

    ``answers`` is an array of struct<question, answer> in order.
    """
    label = F.when(language == "nl", fixed.ANSWER_LABEL["nl"]).otherwise(fixed.ANSWER_LABEL["en"])
    kept = F.filter(
        F.coalesce(answers, F.array().cast("array<struct<question:string,answer:string>>")),
        lambda a: T.present(a["answer"]).isNotNull(),
    )
    rows = F.transform(
        kept,
        lambda a: F.concat(
            F.lit("- "), F.rtrim(T.strip(a["question"]), F.lit("?")), F.lit(": "), T.strip(a["answer"])
        ),
    )
    return T.let(
        rows,
        lambda r: F.when(F.size(r) == 0, T.strip(prompt)).otherwise(
            F.concat(T.strip(prompt), F.lit("\n\n"), label, F.lit("\n"), F.array_join(r, "\n"))
        ),
    )


def _keyword_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda k: T.strip(F.lower(k))), lambda k: k != ""))


def needs_re_retrieval(
    codes: Column, sector: Column, keywords: Column, new_codes: Column, new_sector: Column, new_keywords: Column
) -> Column:
    """Whether a refined request has left its topic."""
    tasks = (F.size(F.array_except(codes, new_codes)) > 0) | (F.size(F.array_except(new_codes, codes)) > 0)
    none = F.lit("")
    sectors = F.coalesce(sector, none) != F.coalesce(new_sector, none)
    sets = F.struct(_keyword_set(keywords).alias("a"), _keyword_set(new_keywords).alias("b"))
    drift = T.let(
        sets,
        lambda s: T.let(
            F.size(F.array_union(s["a"], s["b"])),
            lambda n: (n > 0)
            & (F.size(F.array_intersect(s["a"], s["b"])) < fixed.PIVOT_OVERLAP * n),
        ),
    )
    return tasks | sectors | drift


def refine(
    classified: DataFrame,
    answers: DataFrame | None = None,
    product: str = PRODUCT,
    profiles: Sequence[dict] = fixed.PROFILES,
    replies: DataFrame | None = None,
) -> DataFrame:
    """One refinement turn per request.

    ``replies`` holds what a model said, at most one row per run_id: questions,
    proposed_prompt, done, reasoning and error. A reply without an error
    replaces the questions or the prompt; an error is told in the reasoning.

    Requests that are to be asked first and have no answers get questions;
    the others get a locked prompt, its new intent and the pivot flag.
    ``answers`` holds at most one row per run_id with an array ``answers`` of
    struct<question, answer>. Expects snippet_count and refinement_policy.
    """
    none = F.array().cast("array<struct<question:string,answer:string>>")
    if answers is None:
        rows = classified.withColumn("answers", none)
    else:
        rows = classified.join(answers.select("run_id", "answers"), "run_id", "left").withColumn(
            "answers", F.coalesce("answers", none)
        )
    rows = rows.withColumn(
        "conversation_language", conversation_language(F.col("user_prompt"), F.col("language"))
    )
    ask = (F.col("refinement_policy") == "ask_first") & (F.size("answers") == 0)
    reply_kind = f"struct<questions:{QUESTIONS},proposed_prompt:string,done:boolean,reasoning:string,error:string>"
    if replies is None:
        rows = rows.withColumn("reply", F.lit(None).cast(reply_kind))
    else:
        said = F.struct("questions", "proposed_prompt", "done", "reasoning", "error").cast(reply_kind)
        rows = rows.join(replies.select("run_id", said.alias("reply")), "run_id", "left")
    reply = F.col("reply")
    error = reply["error"]
    usable = reply.isNotNull() & error.isNull()
    filled = lambda c: F.nullif(c, F.lit(""))
    asked = F.coalesce(normalise_service(reply["questions"]), F.array()).cast(QUESTIONS)
    rows = rows.withColumns(
        {
            "ask": ask,
            "questions": F.when(~ask, F.array().cast(QUESTIONS)).when(usable, asked).otherwise(questions(product)),
            "refined_prompt": F.when(
                ask, F.coalesce(F.when(usable, filled(reply["proposed_prompt"])), T.strip(F.col("user_prompt")))
            ).otherwise(
                F.coalesce(
                    F.when(usable, T.strip(filled(reply["proposed_prompt"]))),
                    apply_answers(F.col("user_prompt"), F.col("answers"), F.col("conversation_language")),
                )
            ),
        }
    )
    lower = F.lower("refined_prompt")
    fresh = rows.withColumns(
        {
            "new_task_codes": I.task_codes(lower),
            "new_sector": I.sector(lower),
            "new_topic_keywords": I.keywords(lower, profiles),
            "new_language": F.coalesce(I.target_language(lower), I.prompt_language(lower)),
        }
    )
    pivot = needs_re_retrieval(
        *[F.col(c) for c in ("task_codes", "sector", "topic_keywords", "new_task_codes", "new_sector", "new_topic_keywords")]
    )
    return fresh.withColumns(
        {
            "done": ~F.col("ask") | (usable & F.coalesce(reply["done"], F.lit(False)) & (F.size("questions") == 0)),
            "source": F.when(usable, "llm").otherwise("deterministic"),
            "needs_re_retrieval": ~F.col("ask") & pivot,
            "reasoning": F.when(
                F.col("ask"),
                F.when(usable, F.coalesce(filled(reply["reasoning"]), F.lit(fixed.MODEL_ASK_NOTE)))
                .when(error.isNotNull(), F.concat(F.lit(fixed.ASK_FAILED_NOTE), error))
                .otherwise(fixed.ASK_NOTE),
            ).otherwise(
                F.when(usable, F.coalesce(filled(reply["reasoning"]), F.lit(fixed.MODEL_LOCK_NOTE)))
                .when(error.isNotNull(), F.concat(F.lit(fixed.LOCK_FAILED_NOTE), error))
                .otherwise(fixed.LOCK_NOTE)
            ),
        }
    ).drop("ask", "reply")


def run_status() -> Column:
    """Status of a run row with refinement_policy and done."""
    waiting = (F.col("refinement_policy") == "ask_first") & ~F.col("done")
    return F.when(waiting, "needs_clarification").otherwise("completed")


def rerun_on_pivot(
    refined: DataFrame, snippets: DataFrame, nodes: DataFrame, chunks: DataFrame, available: Sequence[str]
) -> DataFrame:
    """The snippets to draft from: searched again for pivoted runs, else as they were."""
    moved = refined.where(F.col("needs_re_retrieval"))
    renamed = moved.select(
        "run_id", "k", "backend",
        F.col("refined_prompt").alias("user_prompt"), F.col("new_task_codes").alias("task_codes"),
        F.col("new_sector").alias("sector"), F.col("new_topic_keywords").alias("topic_keywords"),
        F.col("new_language").alias("language"),
    )
    queries = R.cut_lineage(R.build_query(P.select_profiles(renamed), available))
    fresh, _ = R.retrieve(queries, nodes, chunks)
    kept = snippets.join(moved.select("run_id"), "run_id", "left_anti")
    return kept.withColumn("again", F.lit(False)).unionByName(fresh.withColumn("again", F.lit(True)))


# ---- questions from outside -----------------------------------------------


def allows_multiple(question: Column) -> Column:
    return T.contains_any(F.lower(question), fixed.MULTIPLE_PHRASES)


def normalise_service(asked: Column) -> Column:
    """At most three of the questions a model proposes, each with at most four choices."""
    return F.transform(
        F.filter(F.slice(asked, 1, 3), lambda q: T.present(q["question"]).isNotNull()),
        lambda q: F.struct(
            q["question"].alias("question"),
            F.slice(F.filter(q["choices"], lambda c: T.present(c).isNotNull()), 1, 4).alias("choices"),
        ),
    )


def normalise_chat(asked: Column) -> Column:
    """At most five questions with at most six choices each, and the several-choice flag."""
    kept = F.filter(asked, lambda q: T.present(q["question"]).isNotNull())
    return F.slice(
        F.transform(
            kept,
            lambda q: F.struct(
                T.strip(q["question"]).alias("question"),
                F.slice(
                    F.filter(F.transform(q["choices"], T.strip), lambda c: c != ""), 1, 6
                ).alias("choices"),
                allows_multiple(q["question"]).alias("multiple"),
            ),
        ),
        1,
        5,
    )


def _instruction(line: Column) -> Column:
    return T.starts_with_any(T.strip(F.lower(line)), fixed.INSTRUCTION_STARTS)


def _question_text(line: Column) -> Column:
    """The question a line asks, or null."""
    bare = F.rtrim(T.strip(F.regexp_replace(line, rf"\A\p{{Nd}}+[).:-]{fixed.SPACE}*", "")), F.lit(":"))

    def judge(c: Column) -> Column:
        low = F.lower(c)
        heading = (
            (F.length(c) <= 90)
            & ~T.starts_with_any(low, fixed.HEADING_STARTS_BARRED)
            & (low.isin(*fixed.HEADINGS) | T.starts_with_any(low, fixed.HEADING_STARTS))
        )
        asks = F.contains(c, F.lit("?")) | heading
        return F.when((c != "") & ~_instruction(c) & asks, c)

    return T.let(bare, judge)


def _option_text(line: Column) -> Column:
    """The choice a line offers, or null."""
    s = fixed.SPACE
    labelled = rf"(?d)\A(?:[-*]{s}*)?(?:[A-Za-z]|\p{{Nd}}+)[).:]{s}*(.+)\z"
    bullet = rf"(?d)\A[-*]{s}+(.+)\z"
    text = (
        F.when(F.rlike(line, F.lit(labelled)), T.strip(F.regexp_extract(line, labelled, 1)))
        .when(F.rlike(line, F.lit(bullet)), T.strip(F.regexp_extract(line, bullet, 1)))
        .otherwise(line)
    )
    return T.let(text, lambda c: F.when((c != "") & ~_instruction(line) & _question_text(c).isNull(), c))


def extract_questions(content: Column) -> Column:
    """Questions with choices in a plain-text clarification form, inside the row.

    Lines are classed once; the choices of a question are the option lines up
    to the next question.
    """
    form = T.contains_any(F.lower(content), fixed.FORM_PHRASES)
    rows = F.transform(
        F.filter(F.transform(T.lines(content), T.strip), lambda ln: ln != ""),
        lambda ln: F.struct(_question_text(ln).alias("q"), _option_text(ln).alias("o")),
    )

    def group(ls: Column) -> Column:
        at = F.filter(
            F.transform(ls, lambda r, i: F.when(r["q"].isNotNull(), i)), lambda i: i.isNotNull()
        )

        def build(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.struct(
                    ls[s]["q"].alias("question"),
                    F.filter(
                        F.transform(
                            F.slice(
                                ls, s + 2, F.coalesce(F.get(starts, j + 1), F.size(ls)) - s - 1
                            ),
                            lambda r: r["o"],
                        ),
                        lambda o: o.isNotNull(),
                    ).alias("choices"),
                ),
            )

        return T.let(at, build)

    # blank questions do not occur, so cutting to five comes after the test for choices
    every = F.transform(
        T.let(rows, group),
        lambda q: F.struct(
            q["question"].alias("question"), F.slice(q["choices"], 1, 6).alias("choices"),
            allows_multiple(q["question"]).alias("multiple"),
        ),
    )
    first_five = F.slice(every, 1, 5)
    out = F.filter(first_five, lambda q: F.size(q["choices"]) > 0)
    none = F.array().cast("array<struct<question:string,choices:array<string>,multiple:boolean>>")
    return F.when(form, out).otherwise(none)


def zip_answers(asked: Column, answers: Column) -> Column:
    """array<struct<question, answer>> by position, cut to the shorter, blanks dropped."""
    n = F.least(F.size(asked), F.size(answers))
    pairs = F.zip_with(
        F.slice(asked, 1, n), F.slice(answers, 1, n),
        lambda q, a: F.struct(q["question"].alias("question"), T.strip(a).alias("answer")),
    )
    return F.filter(pairs, lambda p: p["answer"] != "")
