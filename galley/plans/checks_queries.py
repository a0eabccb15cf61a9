"""Text helpers and deterministic checks over drafts made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley import fixed
from galley.functions import text as T
from galley.operators import checks as K
from galley.plans import inputs
from galley.plans import sqltext as Q
from galley.plans.registry import ORACLES, query, view

KEYWORDS = (
    "case doc_id % 4 when 0 then 'Cybersecurity|TMT' when 1 then 'Retail media|page' "
    "when 2 then 'cloud' else null end"
)


def drafts(spark, sf):
    """Drafts with citations, snippets and request keywords."""
    base = inputs.select(
        inputs.spread(inputs.table(spark, sf, "documents")),
        {**inputs.DRAFTS, "keyword_text": KEYWORDS, "doc_id": "doc_id"},
    )
    return base.withColumns(
        {
            "topic_keywords": F.split("keyword_text", r"\|"),
            "snippets": F.expr(
                "transform(filter(sequence(1, 6), i -> i <= n_snippets), i -> named_struct("
                "'source_doc', 'corpus', 'node_id', 'n' || ((doc_id + i) % 50), "
                "'exclude_for_genai', (doc_id + i) % 7 = 0))"
            ),
            "citations": F.expr(
                "transform(filter(sequence(1, 6), j -> j <= n_citations), j -> named_struct("
                "'index', j, 'source_doc', 'corpus', 'node_id', 'n' || ((doc_id + (j * j) % 5 + 1) % 50)))"
            ),
        }
    ).drop("keyword_text", "doc_id", "n_snippets", "n_citations")


# ---- check SQL ------------------------------------------------------------

view(
    "o_drafts",
    f"""select *, string_split({KEYWORDS.replace('doc_id', 'run_id')}, '|') as keywords,
  list_transform(range(1, n_snippets + 1), lambda i: {{'node': 'n' || ((run_id + i) % 50), 'ex': (run_id + i) % 7 = 0}}) as snippets,
  list_transform(range(1, n_citations + 1), lambda j: 'n' || ((run_id + (j * j) % 5 + 1) % 50)) as cited
from drafts_in""",
)
view("o_bare", f"select *, {Q.md_strip('body')} as bare from o_drafts")
view(
    "o_feat",
    rf"""select *, list_transform(sents, lambda s: {Q.n_words('s')}) as lens from (
  select *, {Q.sentences('bare')} as sents, {Q.paragraphs('bare')} as paras, {Q.n_words('bare')} as nwords,
    regexp_extract_all(bare, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_'']*[\p{{L}}\p{{N}}_])?') as speech,
    regexp_extract_all(body, '(?m)^#\s+(.+)$', 1) as h1,
    list_transform(keywords, lambda k: lower(k)) as kws from o_bare)""",
)


def _count(items: str, test: str, v: str) -> str:
    return f"len(list_filter({items}, lambda {v}: {test}))"


def _check(name: str, fn, sql: str) -> None:
    """Register a check with SQL that gives run_id, value, passed and reason."""

    def run(spark, sf):
        rows = K.features(drafts(spark, sf)).select("run_id", fn().alias("v"))
        return rows.select("run_id", "v.value", "v.passed", "v.reason")

    query(name, sql)(run)


def _yn(good: str, bad: str) -> str:
    return f"case when ok then '{good}' else '{bad}' end as value, ok as passed"


@query("md_strip", "select run_id, md5(bare) as bare_md5 from o_bare")
def md_strip(spark, sf):
    return inputs.drafts_base(spark, sf).select("run_id", F.md5(T.md_strip(F.col("body"))).alias("bare_md5"))


@query(
    "sentences",
    """select run_id, len(sents) as sentences, len(paras) as paragraphs, nwords as words,
  md5(array_to_string(sents, '|')) as sentences_md5, md5(array_to_string(paras, '|')) as paragraphs_md5 from o_feat""",
)
def sentences(spark, sf):
    f = K.features(drafts(spark, sf))
    return f.select(
        "run_id", F.size("f_sentences").cast("bigint").alias("sentences"),
        F.size("f_paragraphs").cast("bigint").alias("paragraphs"), F.col("f_words").cast("bigint").alias("words"),
        F.md5(F.array_join("f_sentences", "|")).alias("sentences_md5"),
        F.md5(F.array_join("f_paragraphs", "|")).alias("paragraphs_md5"),
    )


_SYL = (
    "greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - case when lower(w) like '%e' "
    "and len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 then 1 else 0 end)"
)
_SYLS = f"coalesce(list_sum(list_transform(speech, lambda w: {_SYL})), 0)::BIGINT"


@query("syllables", f"select run_id, {_SYLS} as syllables from o_feat")
def syllables(spark, sf):
    total = F.aggregate("f_speech", F.lit(0), lambda acc, w: acc + T.syllables(w))
    return K.features(drafts(spark, sf)).select("run_id", total.cast("bigint").alias("syllables"))


_check(
    "chk_sentence_length", K.sentence_length,
    f"""select run_id, case when n = 0 then 'unknown' when ok then 'right' else 'too_long' end as value,
  n > 0 and ok as passed, case when n = 0 then 'no sentences found in body' else
  long || '/' || n || ' sentences exceed ' || top || ' words, ' || short || ' below 5 words' end as reason
from (select *, (long + short) / n <= 0.10::DOUBLE as ok from (
  select run_id, top, len(lens) as n, {_count('lens', 'x > top', 'x')} as long, {_count('lens', 'x < 5', 'x')} as short
  from (select *, case when channel = 'chat' then 12 else 15 end as top from o_feat)))""",
)
_check(
    "chk_paragraph_length", K.paragraph_length,
    f"""select run_id, case when n = 0 then 'unknown' when ok then 'right' else 'too_long' end as value, n > 0 and ok as passed,
  case when n = 0 then 'no paragraphs found' when channel = 'chat' then long || '/' || n || ' bubbles exceed 160 characters; ' || n || ' bubbles (max 3)'
    else wide || '/' || n || ' paragraphs exceed 100 words' end as reason
from (select *, case when channel = 'chat' then long = 0 and n <= 3 else wide = 0 end as ok from (
  select run_id, channel, len(paras) as n, {_count('paras', 'length(p) > 160', 'p')} as long,
    {_count('paras', Q.n_words(Q.md_strip('p')) + ' > 100', 'p')} as wide from o_feat))""",
)
view(
    "o_lang",
    f"""select *, case when total = 0 then 'unknown' when nl >= 3 and nl >= en then 'nl' when en >= 3 and en > nl then 'en' else 'unknown' end as seen
from (select run_id, lower(coalesce(language, '')) as wanted, len(ws) as total,
  {_count('ws', f"list_contains({Q.lits(fixed.MARKERS_NL)}, w)", 'w')} as nl,
  {_count('ws', f"list_contains({Q.lits(fixed.MARKERS_EN)}, w)", 'w')} as en
from (select *, list_transform(list_filter(regexp_extract_all(bare, '[\\p{{L}}\\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[A-Za-zÀ-ÿ]+')), lambda w: lower(w)) as ws from o_feat))""",
)
_check(
    "chk_language", K.output_language,
    """select run_id, case when wanted = '' then 'unknown' else seen end as value,
  wanted in ('', 'both') or wanted = seen as passed,
  case when wanted = '' then 'no requested output language supplied'
    else 'expected ' || wanted || ', detected ' || seen || ' from language markers' end as reason from o_lang""",
)
_WIDE = r"regexp_replace(' ' || bare || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g')"
_EDGE = r"[^\p{L}\p{N}_]"
_check(
    "chk_passive", K.passive_voice,
    f"""select run_id, {_yn('not_present', 'present')}, hits || ' passive markers across ' || n || ' sentences (norm: 0)' as reason
from (select *, hits = 0 as ok from (select run_id, greatest(1, len(sents)) as n, len(case when language = 'nl'
    then regexp_extract_all({_WIDE}, '(?i){_EDGE}(?:worden|wordt|werd|werden|geworden){_EDGE}')
    else regexp_extract_all({_WIDE}, '(?i){_EDGE}(?:is|are|was|were|be|been|being)\\s+[\\p{{L}}\\p{{N}}_]+(?:ed|en){_EDGE}') end) as hits
  from o_feat))""",
)
view(
    "o_runs",
    r"""select run_id, list_transform(regexp_extract_all(array_to_string(list_transform(string_split(body, chr(10)),
  lambda l: case when regexp_matches(l, '^\s*[-*+]\s+\S') then 'b' else '.' end), ''), 'b+'), lambda r: length(r)) as runs from o_drafts""",
)
_check(
    "chk_bullets", K.bullet_lists,
    f"""select run_id, {_yn('present', 'not_present')}, case when len(runs) = 0 then 'no bullet list detected'
  when ok then len(runs) || ' list(s); all within 3-6 items'
  else len(odd) || '/' || len(runs) || ' list(s) outside 3-6 items: [' || array_to_string(odd, ', ') || ']' end as reason
from (select *, len(runs) > 0 and len(odd) = 0 as ok from (
  select *, list_filter(runs, lambda n: n < 3 or n > 6) as odd from o_runs))""",
)
_check(
    "chk_h1_count", K.h1_count,
    f"select run_id, {_yn('present', 'not_present')}, len(h1) || ' H1 headings (expected 1)' as reason from (select *, len(h1) = 1 as ok from o_feat)",
)
_check(
    "chk_h1_keywords", K.h1_keywords,
    f"""select run_id, case when kws is null then 'unknown' when ok then 'no' else 'yes' end as value, kws is null or ok as passed,
  case when kws is null then 'no intent keywords supplied; H1 keyword check skipped' else n || ' keyword(s) in H1 (norm: 1-2)' end as reason
from (select *, n between 1 and 2 as ok from (select *, {_count('kws', "contains(lower(array_to_string(h1, ' ')), k)", 'k')} as n from o_feat))""",
)
_check(
    "chk_image_alt", K.image_alt,
    rf"""select run_id, {_yn('not_present', 'present')}, case when len(alts) = 0 then 'no images in body (vacuous pass)'
  else bad || '/' || len(alts) || ' images missing alt text' end as reason
from (select *, bad = 0 as ok from (select *, {_count('alts', "trim(a) = ''", 'a')} as bad from (
  select run_id, regexp_extract_all(body, '!\[([^\]]*)\]\(([^)]+)\)', 1) as alts from o_drafts)))""",
)
_check(
    "chk_trace", K.trace,
    f"""select run_id, {_yn('used', 'not_used')}, case when ok then len(list_distinct(cited)) || ' unique source ID(s) cited'
  else 'generated content carries no source citations' end as reason from (select *, len(cited) > 0 as ok from o_drafts)""",
)
view(
    "o_barred",
    """select run_id, list_filter(cited, lambda c: coalesce(list_filter(snippets, lambda s: s.node = c)[1].ex, false)) as bad from o_drafts""",
)
_check(
    "chk_approved_source", K.approved_source,
    f"""select run_id, {_yn('no_exclusion', 'exclusion')}, case when ok then 'all cited sources approved'
  else len(bad) || ' excluded source(s) cited: [' || array_to_string(list_transform(bad, lambda b: '''corpus::' || b || ''''), ', ') || ']' end as reason
from (select *, len(bad) = 0 as ok from o_barred)""",
)
view(
    "o_marks",
    r"""select run_id, list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(body, '\[(\d+)\]', 1), lambda m: m::BIGINT))),
  lambda m: m < 1 or m > n_snippets) as bad from o_drafts""",
)
_check(
    "chk_citation_markers", K.citation_markers,
    f"""select run_id, {_yn('none', 'several')}, case when ok then 'no out-of-range citation markers (deterministic floor only)'
  else 'hallucinated citation indices: [' || array_to_string(bad, ', ') || ']' end as reason from (select *, len(bad) = 0 as ok from o_marks)""",
)
_FLESCH = (
    f"206.835::DOUBLE - 1.015::DOUBLE * (len(speech) / len(sents)) - 84.6::DOUBLE * ({_SYLS} / len(speech))"
)


@query(
    "chk_reading_level",
    f"""select run_id, case when s is null then 'unknown' when s >= 90 then 'A1' when s >= 80 then 'A2' when s >= 60 then 'B1'
  when s >= 50 then 'B2' when s >= 30 then 'C1' else 'C2' end as value, coalesce(s >= 60, false) as passed,
  coalesce(round(s, 6), 0.0::DOUBLE) as flesch, coalesce(round(a, 2), 0.0::DOUBLE) as avg_sentence_len,
  coalesce(round(b, 2), 0.0::DOUBLE) as avg_syllables_per_word
from (select run_id, case when len(speech) > 0 and len(sents) > 0 then len(speech)::DOUBLE / len(sents) end as a,
  case when len(speech) > 0 and len(sents) > 0 then {_SYLS}::DOUBLE / len(speech) end as b, case when len(speech) > 0 and len(sents) > 0 then {_FLESCH} end as s from o_feat)""",
)
def chk_reading_level(spark, sf):
    rows = K.features(drafts(spark, sf)).select(
        "run_id", K.reading_level().alias("v"), F.coalesce(F.round(K.flesch(), 6), F.lit(0.0)).alias("flesch")
    )
    metric = lambda n: F.coalesce(F.get_json_object("v.raw_metric", f"$.{n}").cast("double"), F.lit(0.0)).alias(n)
    return rows.select("run_id", "v.value", "v.passed", "flesch", metric("avg_sentence_len"), metric("avg_syllables_per_word"))


_check(
    "chk_sentence_count", K.sentence_count,
    f"select run_id, {_yn('right', 'too_long')}, len(sents) || ' sentences (norm: max 100)' as reason from (select *, len(sents) <= 100 as ok from o_feat)",
)
_check(
    "chk_referrals", K.referrals,
    rf"""select run_id, {_yn('no', 'yes')}, n || ' referral link(s) in body (norm: 1-3)' as reason
from (select *, n between 1 and 3 as ok from (select run_id, len(regexp_extract_all(
  regexp_replace(body, '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '\[([^\]]+)\]\(([^)]+)\)', 2)) as n from o_drafts))""",
)
_check(
    "chk_h2_h6_count", K.subheading_count,
    rf"""select run_id, {_yn('no', 'yes')}, n || ' H2-H6 heading(s) (norm: 1-14)' as reason
from (select *, n between 1 and 14 as ok from (select run_id, len(regexp_extract_all(body, '(?m)^#{{2,6}}\s+\S')) as n from o_drafts))""",
)
_check(
    "chk_word_count", K.word_count,
    f"select run_id, {_yn('right', 'too_long')}, nwords || ' words in body (norm: min 300)' as reason from (select *, nwords >= 300 as ok from o_feat)",
)
_check(
    "chk_heading_length", K.heading_length,
    rf"""select run_id, {_yn('no', 'yes')}, case when len(h) = 0 then 'no headings in body (vacuous pass)'
  when ok then 'all ' || len(h) || ' heading(s) within 45 chars / 3-8 words'
  else bad || '/' || len(h) || ' heading(s) outside 45 chars / 3-8 words' end as reason
from (select *, bad = 0 as ok from (select run_id, h, {_count('h', f"length(trim(x)) > 45 or not {Q.n_words('x')} between 3 and 8", 'x')} as bad
  from (select run_id, regexp_extract_all(body, '(?m)^#{{1,6}}\s+(.+)$', 1) as h from o_drafts)))""",
)
_check(
    "chk_keyword_density", K.keyword_density,
    """select run_id, case when kws is null then 'unknown' when n >= need then 'no' else 'yes' end as value, kws is null or n >= need as passed,
  case when kws is null then 'no intent keywords supplied; density check skipped'
    else n || ' keyword occurrence(s) in ' || nwords || ' words (norm: min ' || need || ')' end as reason
from (select *, case when nwords < 200 then 1 when nwords < 1500 then 2 else 3 end as need,
  list_sum(list_transform(kws, lambda k: (length(lower(bare)) - length(replace(lower(bare), k, ''))) // length(k)))::BIGINT as n from o_feat)""",
)
_check(
    "chk_keyword_opening", K.keyword_opening,
    """select run_id, case when kws is null then 'unknown' when hit is not null then 'no' else 'yes' end as value, kws is null or hit is not null as passed,
  case when kws is null then 'no intent keywords supplied; first-words check skipped'
    when hit is not null then 'keyword ''' || hit || ''' in first 50 words' else 'no topic keyword in first 50 words' end as reason
from (select *, list_filter(kws, lambda k: contains(lower(array_to_string(speech[1:50], ' ')), k))[1] as hit from o_feat)""",
)


@query(
    "audit_checks",
    f"""select 'tracability' as kpi_id, count_if(len(cited) > 0)::BIGINT as passed, count(*) as drafts from o_drafts
union all select 'approved_source_content_for_genai', count_if(len(bad) = 0)::BIGINT, count(*) from o_barred
union all select 'factuality_truthfullness', count_if(len(bad) = 0)::BIGINT, count(*) from o_marks
union all select 'language', count_if(wanted in ('', 'both') or wanted = seen)::BIGINT, count(*) from o_lang""",
)
def audit_checks(spark, sf):
    """All checks of one kind in one pass over the drafts, counted."""
    source = ("tracability", "approved_source_content_for_genai", "factuality_truthfullness", "language")
    rows = K.audit(drafts(spark, sf), {k: K.AUDIT[k] for k in source})
    return rows.groupBy("kpi_id").agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("drafts")
    )


_AUDITED = {
    "factuality_truthfullness": "chk_citation_markers",
    "images_with_missing_alt_text": "chk_image_alt",
    "language": "chk_language",
    "tracability": "chk_trace",
    "approved_source_content_for_genai": "chk_approved_source",
    "sentence_number_of_words": "chk_sentence_length",
    "paragraph_bubble_number_of_words_sentences": "chk_paragraph_length",
    "writing_style_active": "chk_passive",
    "bullet_list_points": "chk_bullets",
    "h1_header_presence": "chk_h1_count",
    "h1_header_keywords": "chk_h1_keywords",
    "reading_level": "chk_reading_level",
    "text_number_of_sentences": "chk_sentence_count",
    "referrals": "chk_referrals",
    "h2_h6_headers_number": "chk_h2_h6_count",
    "text_number_of_words": "chk_word_count",
    "headers_and_titles": "chk_heading_length",
    "body_content_key_word_density": "chk_keyword_density",
    "body_content_key_words_in_first_words": "chk_keyword_opening",
}


def _source(name: str) -> str:
    """A check without the keywords or the language it needs is skipped: passed, but not measured."""
    return "'deterministic'" if name == "chk_reading_level" else "case when reason like '%skipped' or (value = 'unknown' and passed) then 'skipped' else 'deterministic' end"


@query(
    "audit_all",
    "\nunion all ".join(
        f"select run_id, '{kpi}' as kpi_id, value, passed, {_source(name)} as source from ({ORACLES[name]})" for kpi, name in _AUDITED.items()
    ),
)
def audit_all(spark, sf):
    """Every check on every draft, one pass."""
    return K.audit(drafts(spark, sf)).select("run_id", "kpi_id", "value", "passed", "source")
