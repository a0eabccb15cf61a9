"""Single rules on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from galley import fixed
from galley.operators import audit as A
from galley.operators import checks as K
from galley.operators import evaluate as G
from galley.operators import intent as I
from galley.operators import profiles as P
from galley.operators import refine as X
from galley.operators import retrieval as R

CITED = "array<struct<index:int,source_doc:string,node_id:string>>"
SNIPS = "array<struct<source_doc:string,node_id:string,exclude_for_genai:boolean>>"


def draft(spark, body, *, language="en", keywords=("agentic ai",), channel="web", cited=2, snips=2, barred=False, origin="instant", strict=False):
    row = (
        1, body, [(i, "corpus_en", f"n{i}") for i in range(1, cited + 1)],
        None if snips is None else [("corpus_en", f"n{i}", barred) for i in range(1, snips + 1)],
        language, None if keywords is None else list(keywords), channel, origin, strict,
    )
    return spark.createDataFrame(
        [row],
        f"run_id int, body string, citations {CITED}, snippets {SNIPS}, language string, topic_keywords array<string>, "
        "channel string, origin string, strict_mode boolean",
    )


def check(spark, fn, body, **kw):
    return K.features(draft(spark, body, **kw)).select(fn().alias("v")).first().v


@pytest.mark.parametrize(
    "fn, body, passed, value, kw",
    [
        (K.sentence_length, "Banks help people save money. Clients read this page with care.", True, "right", {}),
        (K.sentence_length, "No. Nope. Never.", False, "too_long", {}),
        (K.sentence_length, "", False, "unknown", {}),
        (K.sentence_length, "one two three four five six seven eight nine ten eleven twelve thirteen.", False, "too_long", {"channel": "chat"}),
        (K.paragraph_length, "w " * 101, False, "too_long", {}),
        (K.paragraph_length, "a\n\nb\n\nc\n\nd", False, "too_long", {"channel": "chat"}),
        (K.passive_voice, "The plan was approved.", False, "present", {}),
        (K.passive_voice, "Het plan wordt gemaakt.", False, "present", {"language": "nl"}),
        (K.passive_voice, "Teams build tools.", True, "not_present", {}),
        (K.bullet_lists, "- a\n- b\n- c\n", True, "present", {}),
        (K.bullet_lists, "- a\n- b\n", False, "not_present", {}),
        (K.bullet_lists, "plain", False, "not_present", {}),
        (K.h1_count, "# One\n\n# Two", False, "not_present", {}),
        (K.h1_keywords, "# On agentic AI", True, "no", {}),
        (K.h1_keywords, "# On nothing", False, "yes", {}),
        (K.h1_keywords, "# On nothing", True, "unknown", {"keywords": None}),
        (K.image_alt, "![](a.png)", False, "present", {}),
        (K.image_alt, "![x](a.png)", True, "not_present", {}),
        (K.trace, "x", False, "not_used", {"cited": 0}),
        (K.trace, "x", True, "used", {}),
        (K.approved_source, "x", False, "exclusion", {"barred": True}),
        (K.approved_source, "x", True, "no_exclusion", {"cited": 0}),
        (K.citation_markers, "see [1] and [2]", True, "none", {}),
        (K.citation_markers, "See [9].", False, "several", {"snips": None}),
        (K.citation_markers, "no marker", True, "none", {"snips": None}),
        (K.citation_markers, "see [3] and [12345678901234567890123]", False, "several", {}),
        (K.output_language, "de klanten van het bedrijf", True, "nl", {"language": "nl"}),
        (K.output_language, "the and for you", False, "en", {"language": "nl"}),
        (K.output_language, "x", True, "unknown", {"language": None}),
        (K.reading_level, "", False, "unknown", {}),
        (K.referrals, "[a](b) ![c](d)", True, "no", {}),
        (K.subheading_count, "## a", True, "no", {}),
        (K.heading_length, "# One two three", True, "no", {}),
        (K.heading_length, "# One", False, "yes", {}),
        (K.keyword_density, "agentic ai", True, "no", {}),
        (K.keyword_opening, "w " * 50 + "agentic ai", False, "yes", {}),
        (K.word_count, "w " * 300, True, "right", {}),
        (K.sentence_count, "a b. " * 101, False, "too_long", {}),
    ],
)
def test_check(spark, fn, body, passed, value, kw):
    v = check(spark, fn, body, **kw)
    assert (v.passed, v.value) == (passed, value)


def evaluated(spark, body="# T\n\nText [1].", replies=None, **kw):
    table = None
    if replies is not None:
        table = spark.createDataFrame([(1, r, v, "why", 0) for r, v in replies.items()], "run_id int, rubric string, value string, reason string, seq int")
    return G.evaluate(draft(spark, body, **kw), table).first()


GOOD = {"factuality": "none", "truthfullness": "none", "relevancy": "highly", "privacy_security": "none", "groundedness": "full", "comprehensiveness": "full"}


def test_gate_and_tiers(spark):
    r = evaluated(spark)
    assert r.passed and r.source == "deterministic" and {x.value for x in r.results if x.tier == 2} == {"not_evaluated"}
    r = evaluated(spark, body="[9]")
    assert r.failed_blocking == ["factuality_truthfullness"] and r.short_circuit and not [x for x in r.results if x.tier == 2]
    r = evaluated(spark, replies={**GOOD, "relevancy": "off_topic", "groundedness": "odd"})
    assert r.failed_blocking == ["relevancy"] and r.source == "llm"
    assert [x.value for x in r.results if x.kpi_id == "groundedness_source"] == ["unknown"]
    r = evaluated(spark, origin="genai_knowledge", cited=0)
    assert r.failed_blocking == ["tracability"] and list(r.dclp_steps_required) == list(fixed.HUMAN_STEPS)
    assert evaluated(spark, cited=0).passed
    assert evaluated(spark, barred=True).failed_blocking == ["approved_source_content_for_genai"]


def test_judge_replies_are_not_broadcast(spark):
    """The replies of a draft take some hundred times what their size in a file lets Spark expect."""
    replies = spark.range(1, 3).selectExpr("int(id) as run_id", "'factuality' as rubric", "'none' as value", "'why' as reason", "0 as seq")
    done = G.evaluate(draft(spark, "[9]"), replies)
    for rows in (done, done.where("short_circuit").select("run_id", "results")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert rows.count() == 1


def test_strict_mode_blocks_at_least_as_much(spark):
    for kw in ({}, {"replies": GOOD}, {"replies": {**GOOD, "factuality": "few", "truthfullness": "many"}}, {"body": "[9]"}):
        soft, hard = evaluated(spark, **kw), evaluated(spark, strict=True, **kw)
        assert set(soft.failed_blocking) <= set(hard.failed_blocking)
    hard = evaluated(spark, strict=True)
    assert all(not x.passed for x in hard.results if x.tier == 2) and not hard.passed


def test_human_text_has_no_grounding_judge(spark):
    ids = [x.kpi_id for x in evaluated(spark, origin="human").results if x.tier == 2]
    assert "groundedness_source" not in ids and len(ids) == len(fixed.JUDGES) - 1


def classify(spark, prompt, language=None):
    df = spark.createDataFrame([(1, prompt, language)], "run_id int, user_prompt string, output_language string")
    return P.select_profiles(I.classify(df)).first()


@pytest.mark.parametrize(
    "prompt, language",
    [
        ("Schrijf een stuk over cloud voor de klanten", "nl"),
        ("Write an article in English on how suppliers work. The final draft is in dutch", "nl"),
        ("Schrijf een kort stuk in het Engels voor de bedrijven", "en"),
        ("Translate to Dutch; the answer must be in English", "en"),
        ("A piece in both English and Dutch", "both"),
        ("hello", None),
    ],
)
def test_language(spark, prompt, language):
    assert classify(spark, prompt).language == language


def test_intent_and_profiles(spark):
    r = classify(spark, "Check the KPI list and find cyberveiligheid items")
    assert r.task_codes == ["T2_COMPLIANCE", "T1_SEARCH"] and r.sector == fixed.SECTOR and r.confidence == 0.86
    assert r.topic_keywords == ["cyberveiligheid"]
    assert [p.id for p in r.workflow] == ["curator", "reviewer"] and [p.id for p in r.domain_expert] == ["expert_tmt_generalist"]
    plain = classify(spark, "hello there")
    assert plain.task_codes == ["T1_DRAFT"] and plain.confidence == 0.72 and plain.domain_expert == []


def test_routes(spark):
    have = ("corpus_en", "corpus_nl", "schrijfwijzer", "writing_guide", "insights_stijlgids_nl")

    def route(codes, lang, available=have):
        df = spark.createDataFrame([(codes, lang)], "c array<string>, l string")
        return df.select(R.routes(F.col("c"), F.col("l"), available).alias("r")).first().r

    assert route(["T1_DRAFT"], "nl") == ["corpus_nl", "schrijfwijzer", "insights_stijlgids_nl"]
    assert route(["T2_COMPLIANCE"], None) == ["writing_guide", "corpus_en"]
    assert route(["T1_TRANSLATE"], "en") == ["corpus_en", "writing_guide", "corpus_nl", "schrijfwijzer", "insights_stijlgids_nl"]
    assert route(["T1_SEARCH"], "nl", ("z", "a")) == ["a", "z"]


def test_tag_pairs_by_equality_match_substring_search(spark):
    tags = ["ai", "generative ai", "", "cloud", "retail media"]
    terms = ["ai", "media", "cloud software", "x"]
    got = R._matching_tags(
        spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(t,) for t in terms], "term string")
    )
    assert {tuple(r) for r in got.select("tag", "term").collect()} == {(t, k) for t in tags for k in terms if t in k or k in t}


def test_search_without_broadcast_is_the_same(spark, monkeypatch):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    for name in ("topk_vector", "topk_keyword"):
        want = sorted(map(tuple, entry.queries()[name](spark, sf).collect()))
        with monkeypatch.context() as m:
            m.setattr("galley.operators.scale.fits", lambda df, rows=0: False)
            m.setattr("galley.operators.retrieval.fits", lambda df, rows=0: False)
            got = sorted(map(tuple, entry.queries()[name](spark, sf).collect()))
        assert got == want


def test_question_form(spark):
    form = (
        "Some clarifying questions before I write:\n\n1. Which readers do you mean? (select all)\n- Bankers\n- b) Clients\n"
        "Please pick.\nTone:\nA) Plain\nB) Formal\nAny deadline?\nReply with your choices."
    )
    df = spark.createDataFrame([(form,), ("What can we do?\nAct now.",)], "c string")
    qs, none = [r.q for r in df.select(X.extract_questions(F.col("c")).alias("q")).collect()]
    assert [(q.question, q.choices, q.multiple) for q in qs] == [
        ("Which readers do you mean? (select all)", ["Bankers", "Clients"], True),
        ("Tone", ["Plain", "Formal"], False),
    ]
    assert none == []


def test_pivot_is_symmetric(spark):
    rows = [(["a"], None, ["x", "y"], ["a"], None, ["x"]), (["a"], None, [], ["a"], "", []), (["a", "b"], "s", ["x"], ["b", "a"], "s", ["X ", "z", "q"])]
    df = spark.createDataFrame(rows, "c array<string>, s string, k array<string>, c2 array<string>, s2 string, k2 array<string>")
    one = X.needs_re_retrieval(*[F.col(c) for c in ("c", "s", "k", "c2", "s2", "k2")])
    two = X.needs_re_retrieval(*[F.col(c) for c in ("c2", "s2", "k2", "c", "s", "k")])
    got = [tuple(r) for r in df.select(one, two).collect()]
    assert got == [(False, False), (False, False), (True, True)]


def test_latest_stage_keeps_the_last_complete_payload(spark):
    full = '{"body":"one"}'
    rows = [("r", "content", 1, full), ("r", "content", 2, '{"body":2}'), ("s", "content", 3, "broken"), ("s", "intent", 4, '{"ok":true,"result":{"intent":{"role":"x","task_codes":["T"],"confidence":1,"task_reason":""}}}')]
    df = spark.createDataFrame(rows, "run_id string, stage string, seq int, payload string")
    got = {(r.run_id, r.stage): (r.payload, r.complete) for r in A.latest_stage(df).collect()}
    assert got["r", "content"] == (full, True) and got["s", "content"] == ("broken", False)
    assert got["s", "intent"][1] and A.latest_stage(df, 1).select("run_id").distinct().count() == 1


def test_a_check_that_fails_for_one_draft_fails_alone(spark):
    def share():
        """Divides by the number of citations."""
        rate = F.try_divide(F.lit(1), F.size("citations"))
        return K.verdict(F.when(rate.isNotNull(), "right"), rate <= 1, F.lit("share"), "PresenceScale")

    both = draft(spark, "# T\n\nText.", cited=1).withColumn("run_id", F.lit("one")).unionByName(
        draft(spark, "# T\n\nText.", cited=0).withColumn("run_id", F.lit("none"))
    )
    got = {r.run_id: (r.value, r.passed, r.reason) for r in K.audit(both, {"share": share}).collect()}
    assert got == {"one": ("right", True, "share"), "none": ("unknown", False, fixed.CHECK_ERROR)}
    # the same within the evaluation, where the other checks stay as they are
    kpis = G.seed_kpis()
    name = next(k["id"] for k in kpis if k["id"] in K.ACTIVE)
    rows = lambda active: {
        (r.run_id, x.kpi_id): (x.value, x.passed)
        for r in K.features(both).select("run_id", G.tier1(kpis, active).alias("rows")).collect() for x in r.rows
    }
    plain, changed = rows(K.ACTIVE), rows({**K.ACTIVE, name: share})
    assert plain.keys() == changed.keys() and changed[("none", name)] == ("unknown", False)
    assert all(plain[k] == changed[k] for k in plain if k[1] != name)
