"""Deterministic text checks of drafts, each one column expression.

A draft row holds run_id, body, citations, snippets, language, topic_keywords
(null when the request is not known) and channel. A check gives a struct of
value, passed, reason, indicator, raw_metric (JSON) and source. ``features``
computes what the checks share once per draft.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T

VERDICT = (
    "struct<value:string,passed:boolean,reason:string,indicator:string,raw_metric:string,source:string>"
)
NONSPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
H1 = rf"(?md)^#{fixed.SPACE}+(.+)$"
HEADING = rf"(?md)^#{{1,6}}{fixed.SPACE}+(.+)$"
SUBHEADING = rf"(?md)^#{{2,6}}{fixed.SPACE}+{NONSPACE}"
BULLET = rf"\A{fixed.SPACE}*[-*+]{fixed.SPACE}+{NONSPACE}"


def features(drafts: DataFrame) -> DataFrame:
    """Add bare text, sentences, paragraphs, headings and counts."""
    bare = drafts.withColumn("f_bare", T.md_strip(F.col("body")))
    split = bare.withColumns(
        {
            "f_sentences": T.split_sentences(F.col("f_bare")),
            "f_paragraphs": T.split_paragraphs(F.col("f_bare")),
            "f_speech": T.speech_words(F.col("f_bare")),
            "f_h1": T.matches(F.col("body"), H1, 1),
            "f_keywords": _keywords(F.col("topic_keywords")),
        }
    )
    counted = split.withColumns(
        {
            "f_lengths": F.transform("f_sentences", T.count_words),
            "f_n_sentences": F.size("f_sentences"),
        }
    )
    # sentences end between words, so their words are those of the text
    return counted.withColumn("f_words", F.aggregate("f_lengths", F.lit(0), lambda acc, n: acc + n))


def _keywords(c: Column) -> Column:
    low = F.filter(F.transform(c, F.lower), lambda k: k != "")
    return T.let(low, lambda a: F.when(F.size(a) > 0, a))


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def verdict(value, passed, reason: Column, indicator: str | None = None, raw=None, source="deterministic") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(value).alias("value"),
        lit(passed).alias("passed"),
        reason.alias("reason"),
        lit(indicator).cast("string").alias("indicator"),
        (F.to_json(raw) if raw is not None else F.lit(None).cast("string")).alias("raw_metric"),
        F.lit(source).alias("source"),
    ).cast(VERDICT)


def isolated(check: Column) -> Column:
    """A check that fails by itself: where it has no value or no decision, a failing row says so.

    Checks use the ``try_`` forms of what can raise an error, so an error in one
    draft is a null there, and neither the job nor other drafts see it.
    """
    failed = verdict("unknown", False, F.lit(fixed.CHECK_ERROR))
    return T.let(check.cast(VERDICT), lambda v: F.when(v["value"].isNull() | v["passed"].isNull(), failed).otherwise(v))


def _scaled(passed: Column, good: str, bad: str, reason: Column, indicator: str, raw=None) -> Column:
    return T.let(
        F.coalesce(passed, F.lit(False)),
        lambda p: verdict(F.when(p, good).otherwise(bad), p, reason, indicator, raw),
    )


def _skipped(indicator: str, reason: str) -> Column:
    return verdict("unknown", True, F.lit(reason), indicator, None, "skipped")


def _count_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def sentence_length() -> Column:
    top = F.when(F.col("channel") == "chat", 12).otherwise(15)
    n = F.col("f_n_sentences")
    counts = F.struct(
        _count_where(F.col("f_lengths"), lambda x: x > top).alias("long"),
        _count_where(F.col("f_lengths"), lambda x: x < 5).alias("short"),
    )
    judged = T.let(
        counts,
        lambda c: T.let(
            F.try_divide(c["long"] + c["short"], n),
            lambda ratio: _scaled(
                ratio <= 0.10,
                "right",
                "too_long",
                say(c["long"], "/", n, " sentences exceed ", top, " words, ", c["short"], " below 5 words"),
                "LengthScale",
                F.struct(
                    c["long"].alias("long"), c["short"].alias("short"), n.alias("total"),
                    ratio.alias("ratio"), top.alias("max_words"),
                ),
            ),
        ),
    )
    none = verdict("unknown", False, F.lit("no sentences found in body"), "LengthScale")
    return F.when(n == 0, none).otherwise(judged)


def paragraph_length() -> Column:
    paras = F.col("f_paragraphs")
    n = F.size(paras)
    bubbles = T.let(
        _count_where(paras, lambda p: F.length(p) > 160),
        lambda long: _scaled(
            (long == 0) & (n <= 3), "right", "too_long",
            say(long, "/", n, " bubbles exceed 160 characters; ", n, " bubbles (max 3)"),
            "LengthScale", F.struct(long.alias("long"), n.alias("bubbles")),
        ),
    )
    blocks = T.let(
        # 101 words have 201 characters at least
        _count_where(paras, lambda p: (F.length(p) > 200) & (T.word_count(p) > 100)),
        lambda long: _scaled(
            long == 0, "right", "too_long",
            say(long, "/", n, " paragraphs exceed 100 words"),
            "LengthScale", F.struct(long.alias("long"), n.alias("total")),
        ),
    )
    none = verdict("unknown", False, F.lit("no paragraphs found"), "LengthScale")
    return F.when(n == 0, none).when(F.col("channel") == "chat", bubbles).otherwise(blocks)


def output_language() -> Column:
    wanted = F.lower(F.coalesce("language", F.lit("")))
    found = F.transform(
        F.filter(T.matches(F.col("f_bare"), fixed.WORD + "+"), lambda w: F.rlike(w, F.lit(r"\A[A-Za-zÀ-ÿ]+\z"))),
        F.lower,
    )

    def count(ws: Column, markers) -> Column:
        table = T.strings(markers)
        return _count_where(ws, lambda w: F.array_contains(table, w))

    def judge(c: Column) -> Column:
        seen = (
            F.when(c["total"] == 0, "unknown")
            .when((c["nl"] >= 3) & (c["nl"] >= c["en"]), "nl")
            .when((c["en"] >= 3) & (c["en"] > c["nl"]), "en")
            .otherwise("unknown")
        )
        return T.let(
            seen,
            lambda s: verdict(
                s, (wanted == "both") | (s == wanted),
                say("expected ", wanted, ", detected ", s, " from language markers"),
                "PresenceScale", c,
            ),
        )

    counts = T.let(
        found,
        lambda ws: F.struct(
            count(ws, fixed.MARKERS_NL).alias("nl"),
            count(ws, fixed.MARKERS_EN).alias("en"),
            F.size(ws).alias("total"),
        ),
    )
    return F.when(
        ~wanted.isin("en", "nl", "both"), _skipped("PresenceScale", "no requested output language supplied")
    ).otherwise(T.let(counts, judge))


def passive_voice() -> Column:
    dutch = F.startswith(F.lower(F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))), F.lit("nl"))
    bare = F.col("f_bare")
    hits = F.when(dutch, F.regexp_count(bare, F.lit("(?iU)" + fixed.PASSIVE_NL))).otherwise(
        F.regexp_count(bare, F.lit("(?iU)" + fixed.PASSIVE_EN))
    )
    n = F.greatest(F.lit(1), F.col("f_n_sentences"))
    return T.let(
        hits,
        lambda h: _scaled(
            h == 0, "not_present", "present",
            say(h, " passive markers across ", n, " sentences (norm: 0)"),
            "PresenceScale", F.struct(h.alias("hits"), n.alias("sentences")),
        ),
    )


def bullet_runs(body: Column) -> Column:
    """Lengths of the runs of bullet lines: lines become marks, runs of marks are matched."""
    marks = F.transform(T.lines(body), lambda ln: F.when(F.rlike(ln, F.lit(BULLET)), "b").otherwise("."))
    return F.transform(T.matches(F.array_join(marks, ""), "b+"), F.length)


def bullet_lists() -> Column:
    def judge(runs: Column) -> Column:
        odd = F.filter(runs, lambda n: (n < 3) | (n > 6))
        return T.let(
            odd,
            lambda o: F.when(
                F.size(runs) == 0,
                verdict("not_present", False, F.lit("no bullet list detected"), "PresenceScale",
                        F.struct(runs.alias("runs"))),
            ).otherwise(
                _scaled(
                    F.size(o) == 0, "present", "not_present",
                    F.when(F.size(o) == 0, say(F.size(runs), " list(s); all within 3-6 items")).otherwise(
                        say(F.size(o), "/", F.size(runs), " list(s) outside 3-6 items: ", T.list_repr(o))
                    ),
                    "PresenceScale", F.struct(runs.alias("runs")),
                )
            ),
        )

    return T.let(bullet_runs(F.col("body")), judge)


def h1_count() -> Column:
    n = F.size("f_h1")
    return _scaled(
        n == 1, "present", "not_present", say(n, " H1 headings (expected 1)"), "PresenceScale",
        F.struct(n.alias("count")),
    )


def h1_keywords() -> Column:
    text = F.lower(F.array_join("f_h1", " "))
    judged = T.let(
        _count_where(F.col("f_keywords"), lambda k: F.contains(text, k)),
        lambda n: _scaled(
            n.between(1, 2), "no", "yes", say(n, " keyword(s) in H1 (norm: 1-2)"), "DeviationYesNo",
            F.struct(F.col("f_h1").alias("h1s"), F.col("f_keywords").alias("keywords"), n.alias("count")),
        ),
    )
    skip = _skipped("DeviationYesNo", "no intent keywords supplied; H1 keyword check skipped")
    return F.when(F.col("f_keywords").isNull(), skip).otherwise(judged)


def image_alt() -> Column:
    pairs = F.arrays_zip(
        T.matches(F.col("body"), T.IMAGE, 1).alias("alt"), T.matches(F.col("body"), T.IMAGE, 2).alias("url")
    )

    def judge(images: Column) -> Column:
        missing = F.transform(F.filter(images, lambda i: T.strip(i["alt"]) == ""), lambda i: i["url"])
        return F.when(
            F.size(images) == 0,
            verdict("not_present", True, F.lit("no images in body (vacuous pass)"), "PresenceScale",
                    F.struct(F.lit(0).alias("images"))),
        ).otherwise(
            T.let(
                missing,
                lambda m: _scaled(
                    F.size(m) == 0, "not_present", "present",
                    say(F.size(m), "/", F.size(images), " images missing alt text"), "PresenceScale",
                    F.struct(m.alias("missing"), F.size(images).alias("total")),
                ),
            )
        )

    return T.let(pairs, judge)


def trace() -> Column:
    cited = F.col("citations")
    unique = F.size(F.array_distinct(F.transform(cited, lambda c: F.struct(c["source_doc"], c["node_id"]))))
    none = verdict("not_used", False, F.lit("generated content carries no source citations"), "UsedScale")
    return F.when(F.coalesce(F.size(cited), F.lit(0)) <= 0, none).otherwise(
        verdict(
            "used", True, say(unique, " unique source ID(s) cited"), "UsedScale",
            F.struct(unique.alias("unique_sources"), F.size(cited).alias("citations")),
        )
    )


def approved_source() -> Column:
    def barred(c: Column) -> Column:
        first = F.get(
            F.filter(
                "snippets",
                lambda s: (s["source_doc"] == c["source_doc"]) & (s["node_id"] == c["node_id"]),
            ),
            F.lit(0),
        )
        return F.coalesce(first["exclude_for_genai"], F.lit(False))

    names = F.transform(
        F.filter("citations", barred),
        lambda c: F.concat(c["source_doc"], F.lit("::"), c["node_id"]),
    )
    return T.let(
        names,
        lambda x: _scaled(
            F.size(x) == 0, "no_exclusion", "exclusion",
            F.when(F.size(x) == 0, "all cited sources approved").otherwise(
                say(F.size(x), " excluded source(s) cited: ", T.list_repr(x, "'"))
            ),
            "ExclusionScale", F.struct(x.alias("excluded")),
        ),
    )


def citation_markers() -> Column:
    n = F.coalesce(F.size("snippets"), F.lit(0))
    found = F.array_sort(
        F.array_distinct(
            F.transform(T.matches(F.col("body"), r"\[(\d+)\]", 1), lambda d: d.try_cast("decimal(38,0)"))
        )
    )

    def judge(marks: Column) -> Column:
        bad = F.filter(marks, lambda m: m.isNull() | (m < 1) | (m > n))
        return T.let(
            bad,
            lambda b: F.when(
                F.size(b) == 0,
                verdict(
                    "none", True, F.lit("no out-of-range citation markers (deterministic floor only)"),
                    "ErrorScale", F.struct(marks.alias("markers"), n.alias("snippet_count")),
                ),
            ).otherwise(
                verdict(
                    "several", False, say("hallucinated citation indices: ", T.list_repr(b)), "ErrorScale",
                    F.struct(b.alias("invalid"), n.alias("snippet_count")),
                )
            ),
        )

    return T.let(found, judge)


def flesch() -> Column:
    """Reading ease of the bare text; null without sentences or words."""
    return flesch_of(*averages())


def averages() -> tuple[Column, Column]:
    """Words per sentence and syllables per word; null without sentences or words."""
    words, sentences = F.size("f_speech"), F.col("f_n_sentences")
    total = T.syllables_of(F.col("f_speech"))
    some = (words > 0) & (sentences > 0)
    return F.when(some, F.try_divide(words, sentences)), F.when(some, F.try_divide(total, words))


def flesch_of(sentence: Column, word: Column) -> Column:
    return 206.835 - 1.015 * sentence - 84.6 * word


def reading_level() -> Column:
    def judge(m: Column) -> Column:
        s = flesch_of(m["sentence"], m["word"])
        band = (
            F.when(s >= 90, "A1").when(s >= 80, "A2").when(s >= 60, "B1").when(s >= 50, "B2")
            .when(s >= 30, "C1").otherwise("C2")
        )
        return F.when(
            s.isNull(), verdict("unknown", False, F.lit("body too short to measure reading level"), "LanguageLevelScale")
        ).otherwise(
            verdict(
                band, s >= 60, say("Flesch score ", F.format_string("%.1f", s), " → ", band),
                "LanguageLevelScale",
                F.struct(
                    F.round(s, 1).alias("flesch"), F.round(m["sentence"], 2).alias("avg_sentence_len"),
                    F.round(m["word"], 2).alias("avg_syllables_per_word"),
                ),
            )
        )

    sentence, word = averages()
    return T.let(F.struct(sentence.alias("sentence"), word.alias("word")), judge)


def sentence_count() -> Column:
    n = F.col("f_n_sentences")
    return _scaled(
        n <= 100, "right", "too_long", say(n, " sentences (norm: max 100)"), "LengthScale",
        F.struct(n.alias("sentences")),
    )


def referrals() -> Column:
    urls = T.matches(F.regexp_replace("body", T.IMAGE, ""), T.LINK, 2)
    return T.let(
        urls,
        lambda u: _scaled(
            F.size(u).between(1, 3), "no", "yes", say(F.size(u), " referral link(s) in body (norm: 1-3)"),
            "DeviationYesNo", F.struct(u.alias("links")),
        ),
    )


def subheading_count() -> Column:
    return T.let(
        F.regexp_count("body", F.lit(SUBHEADING)),
        lambda n: _scaled(
            n.between(1, 14), "no", "yes", say(n, " H2-H6 heading(s) (norm: 1-14)"), "DeviationYesNo",
            F.struct(n.alias("count")),
        ),
    )


def word_count() -> Column:
    n = F.col("f_words")
    return _scaled(
        n >= 300, "right", "too_long", say(n, " words in body (norm: min 300)"), "LengthScale",
        F.struct(n.alias("words")),
    )


def heading_length() -> Column:
    def judge(heads: Column) -> Column:
        bad = F.filter(
            heads, lambda h: (F.length(T.strip(h)) > 45) | ~T.count_words(h).between(3, 8)
        )
        return F.when(
            F.size(heads) == 0,
            verdict("no", True, F.lit("no headings in body (vacuous pass)"), "DeviationYesNo",
                    F.struct(F.lit(0).alias("headings"))),
        ).otherwise(
            T.let(
                bad,
                lambda b: _scaled(
                    F.size(b) == 0, "no", "yes",
                    F.when(
                        F.size(b) == 0, say("all ", F.size(heads), " heading(s) within 45 chars / 3-8 words")
                    ).otherwise(say(F.size(b), "/", F.size(heads), " heading(s) outside 45 chars / 3-8 words")),
                    "DeviationYesNo",
                    F.struct(F.size(heads).alias("total"), F.slice(b, 1, 5).alias("out_of_norm")),
                ),
            )
        )

    return T.let(T.matches(F.col("body"), HEADING, 1), judge)


def keyword_density() -> Column:
    words = F.col("f_words")
    need = F.when(words < 200, 1).when(words < 1500, 2).otherwise(3)
    low = F.lower("f_bare")
    total = T.let(
        low,
        lambda b: F.aggregate("f_keywords", F.lit(0), lambda acc, k: acc + T.occurrences(b, k)),
    )
    judged = T.let(
        total,
        lambda n: _scaled(
            n >= need, "no", "yes",
            say(n, " keyword occurrence(s) in ", words, " words (norm: min ", need, ")"), "DeviationYesNo",
            F.struct(n.alias("count"), words.alias("words"), need.alias("required")),
        ),
    )
    skip = _skipped("DeviationYesNo", "no intent keywords supplied; density check skipped")
    return F.when(F.col("f_keywords").isNull(), skip).otherwise(judged)


def keyword_opening() -> Column:
    opening = F.lower(F.array_join(F.slice("f_speech", 1, 50), " "))
    hit = T.let(
        opening, lambda o: F.get(F.filter("f_keywords", lambda k: F.contains(o, k)), F.lit(0))
    )
    judged = T.let(
        hit,
        lambda h: _scaled(
            h.isNotNull(), "no", "yes",
            F.when(h.isNull(), "no topic keyword in first 50 words").otherwise(
                say("keyword '", h, "' in first 50 words")
            ),
            "DeviationYesNo", F.struct(F.col("f_keywords").alias("keywords"), F.lit(50).alias("window")),
        ),
    )
    skip = _skipped("DeviationYesNo", "no intent keywords supplied; first-words check skipped")
    return F.when(F.col("f_keywords").isNull(), skip).otherwise(judged)


#: Checks of the default stage by KPI.
ACTIVE: dict[str, Callable[[], Column]] = {
    "factuality_truthfullness": citation_markers,
    "images_with_missing_alt_text": image_alt,
    "language": output_language,
    "tracability": trace,
    "approved_source_content_for_genai": approved_source,
}

#: All checks, for audits beyond the default stage.
AUDIT: dict[str, Callable[[], Column]] = {
    **ACTIVE,
    "sentence_number_of_words": sentence_length,
    "paragraph_bubble_number_of_words_sentences": paragraph_length,
    "writing_style_active": passive_voice,
    "bullet_list_points": bullet_lists,
    "h1_header_presence": h1_count,
    "h1_header_keywords": h1_keywords,
    "reading_level": reading_level,
    "text_number_of_sentences": sentence_count,
    "referrals": referrals,
    "h2_h6_headers_number": subheading_count,
    "text_number_of_words": word_count,
    "headers_and_titles": heading_length,
    "body_content_key_word_density": keyword_density,
    "body_content_key_words_in_first_words": keyword_opening,
}


def audit(drafts: DataFrame, checks: dict[str, Callable[[], Column]] = AUDIT) -> DataFrame:
    """One row per draft and check."""
    rows = F.array(
        *[F.struct(F.lit(kpi).alias("kpi_id"), isolated(fn()).alias("v")) for kpi, fn in checks.items()]
    )
    return (
        features(drafts).select("run_id", F.explode_outer(rows).alias("r")).select("run_id", "r.kpi_id", "r.v.*")
    )
