"""Fixed values that results depend on: word lists, patterns, thresholds, wording.

Nothing here is logic. Changing any value changes results.
"""

# Characters that count as white space, and the same as a
# regular-expression class (Java's \s is ASCII only).
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"[A-Za-zÀ-ÿ0-9_]+"

# Stop words when corpora are built.
BUILD_STOPWORDS = (
    "the and for with this that from about what when where which your our are was were "
    "een het de en van voor met dat die dit deze naar zijn wordt door als ook aan op bij "
    "uit over"
).split()

# Stop words when requests are matched.
QUERY_STOPWORDS = (
    "the and for with this that from about what when where which your our are was were "
    "het een voor met van zijn dat deze naar"
).split()

# Headings that open the closing boilerplate of an article.
BOILERPLATE_HEADINGS = (
    "## Read more in",
    "## Achter de Cijfers podcast",
    "## In conversation",
    "## More information",
    "## Lees meer",
    "## Meer informatie",
)

# Page titles of the writing guide that win over other lines.
GUIDE_PAGE_TITLES = (
    "Even vooraf",
    "Inhoud",
    "Voorbereiden",
    "Structuur",
    "Formuleren",
    "Correctheid",
    "Inclusief schrijven",
    "Index",
)

# Sizes of summaries, chunks, term vectors and result lists.
SUMMARY_CHARS = 420
CHUNK_WORDS = 260
CHUNK_OVERLAP = 40
CHUNK_MIN_TAIL = 40
VECTOR_TERMS = 96
MAX_K = 20
MAX_CITATIONS = 5
MAX_QUESTIONS = 3

# Task codes and the substrings that select them, in order.
TASK_HINTS = (
    ("T1_TRANSLATE", ("translate", "vertaal", "translation", "naar het nederlands", "naar engels")),
    (
        "T2_COMPLIANCE",
        (
            "check", "review", "compliance", "kpi", "checklist", "hard rule", "quality",
            "controleer", "beoordeel", "kwaliteit", "naleving",
        ),
    ),
    (
        "T4_RENEWAL",
        ("old article", "older than", "renew", "refresh", "verouderd", "vernieuw", "actualiseer"),
    ),
    (
        "T1_SEARCH",
        (
            "search", "find", "related", "corpus", "exist", "already have", "zoek", "vind",
            "gerelateerd",
        ),
    ),
    ("T1_DRAFT", ("write", "draft", "article", "schrijf", "generate", "concept", "artikel")),
)
DEFAULT_TASK = "T1_DRAFT"
TASK_CODES = ("T1_DRAFT", "T1_TRANSLATE", "T1_SEARCH", "T2_COMPLIANCE", "T4_RENEWAL")

# The one sector and the substrings that select it.
SECTOR = "Technologie, Media & Telecom"
SECTOR_HINTS = (
    "tmt", "cyber", "agentic", "ai", "artificial intelligence", "kunstmatige intelligentie",
    "telecom", "media", "advertising", "advertentie", "buitenreclame", "retail media",
    "digital services act", "dsa", "cloud", "saas", "software", "datacenter", "chip",
    "it-leverancier", "it supplier",
)

# Role and confidences of the deterministic classifier.
ROLE = "Insights Editorial"
CONFIDENCE_CLEAR = 0.86
CONFIDENCE_PLAIN = 0.72

# Patterns for the language asked for.
LANGUAGE_NAMES = {
    "dutch": "nl", "nederlands": "nl", "nederlandstalig": "nl", "english": "en", "engels": "en",
}
BOTH_LANGUAGES = (
    r"\b(?:both\s+english\s+and\s+dutch|both\s+dutch\s+and\s+english|"
    r"english\s+and\s+dutch|dutch\s+and\s+english|"
    r"engels\s+en\s+nederlands|nederlands\s+en\s+engels|en\s*\+\s*nl)\b"
)
TARGET_LANGUAGE = (
    r"\b(?:final\s+)?(?:draft|output|answer|response|text|article|content)"
    r"\s+(?:must\s+be|should\s+be|needs\s+to\s+be|has\s+to\s+be|is|in)"
    r"\s+(?:written\s+)?(?:in\s+)?"
    r"(dutch|nederlands|nederlandstalig|english|engels)\b",
    r"\b(?:write|draft|generate|respond|answer|translate|vertaal|schrijf)"
    r"\b.{0,80}?\b(?:in|to|naar|naar\s+het|in\s+het)\s+"
    r"(dutch|nederlands|nederlandstalig|english|engels)\b",
)

# Substrings that hint at the language a prompt is written in.
PROMPT_SIGNALS = {
    "nl": (
        "vertaal", "schrijf", "artikel", "artikelen", "analyseartikel", "ouder dan",
        "controleer", "zoek", "vind", " het ", " de ", " een ", " hoe ", " wat ", " voor ",
        "tekort", "betekent", "nederlandse", "bedrijven", "leveranciers",
    ),
    "en": (
        "write", "translate", "related", "draft", " the ", " an ", " how ", " what ", " for ",
        "companies", "suppliers",
    ),
}

# Corpora by language, in search order.
ARTICLE_CORPORA = {
    "en": ("corpus_en",),
    "nl": ("corpus_nl",),
    "both": ("corpus_nl", "corpus_en"),
}
GUIDE_CORPORA = {
    "en": ("writing_guide", "insights_stijlgids_en"),
    "nl": ("schrijfwijzer", "insights_stijlgids_nl"),
    "both": (
        "schrijfwijzer", "insights_stijlgids_nl", "writing_guide", "insights_stijlgids_en",
    ),
}

# Weights of the keyword score.
TITLE_WEIGHT, TAG_WEIGHT, SUMMARY_WEIGHT = 4, 2, 1

# How a search was done, as its summary says it.
VECTOR_NOTE = "Sparse vector cosine over generated JSONL chunk assets."
FALLBACK_NOTE = "Vector assets returned no snippets; PageIndex keyword fallback used."
KEYWORD_NOTE = "Keyword and tag overlap over cached PageIndex assets."
ASK_NOTE = "Clarification questions generated before lock-in."
LOCK_NOTE = "Prompt locked after deterministic refinement."
MODEL_ASK_NOTE = "LLM generated refinement questions."
MODEL_LOCK_NOTE = "LLM locked refined prompt from clarifications."
ASK_FAILED_NOTE = "LLM refinement failed; deterministic fallback: "
LOCK_FAILED_NOTE = "LLM lock failed; deterministic refinement fallback: "
RANKER_NOTE = "Two-stage LLM ranker shortlisted articles and selected grounding sections."
RANKER_EMPTY_NOTE = "LLM ranker returned no usable snippets; deterministic fallback."
RANKER_FAILED_NOTE = "LLM ranker failed; deterministic fallback: "

# Keyword overlap below which a refined request counts as a new topic.
PIVOT_OVERLAP = 0.5

# Seed catalogue of profiles, in catalogue order.
PROFILES = (
    {"id": "curator", "name": "Curator", "category": "workflow",
     "codes": ("T1_SEARCH", "T4_RENEWAL"), "sector": None, "keywords": ()},
    {"id": "drafter", "name": "Drafter", "category": "workflow",
     "codes": ("T1_DRAFT", "T1_TRANSLATE"), "sector": None, "keywords": ()},
    {"id": "reviewer", "name": "Reviewer", "category": "workflow",
     "codes": ("T2_COMPLIANCE",), "sector": None, "keywords": ()},
    {"id": "expert_tmt_cybersecurity", "name": "TMT Cybersecurity Specialist",
     "category": "domain_expert", "codes": (), "sector": SECTOR,
     "keywords": ("cybersecurity in TMT", "agentic AI", "AI-driven cyber attacks",
                  "AI-driven cyber defence", "personeelstekort cybersecurity")},
    {"id": "expert_tmt_generalist", "name": "TMT Sector Generalist",
     "category": "domain_expert", "codes": (), "sector": SECTOR,
     "keywords": ("cybersecurity", "cyberveiligheid", "software", "SaaS", "AI",
                  "generatieve AI", "cloud", "datacenters", "EU regelgeving",
                  "digitale soevereiniteit", "chip-industrie", "duurzaamheid IT",
                  "groene IT")},
    {"id": "expert_tmt_media_advertising", "name": "TMT Media & Advertising Specialist",
     "category": "domain_expert", "codes": (), "sector": SECTOR,
     "keywords": ("advertising", "online advertising", "retail media", "billboards",
                  "buitenreclame", "digital media", "DSA", "Digital Services Act",
                  "privacy regulation in advertising", "media monetisation")},
)
PROFILE_ID = r"^[a-z][a-z0-9_]*$"
PROFILE_CATEGORIES = ("workflow", "domain_expert")

# Wording of the clarification questions.
QUESTION_WORDING = {
    "language": {
        "nl": ("Welke uitvoertaal moet {product} gebruiken?",
               ("Engels", "Nederlands", "Zowel Engels als Nederlands")),
        "en": ("Which output language should {product} use?",
               ("English", "Dutch", "Both English and Dutch")),
    },
    "audience": {
        "nl": ("Voor wie is de tekst bedoeld?",
               ("Zakelijke beslissers", "IT-directeuren", "Algemene klanten")),
        "en": ("Who is the target audience for the content?",
               ("Business decision-makers", "IT directors", "General clients")),
    },
    "sources": {
        "nl": ("Er zijn geen sterke bronfragmenten gevonden. Moet {product} toch doorgaan?",
               ("Doorgaan met de Schrijfwijzer", "Onderwerp versmallen", "Stoppen voor review")),
        "en": ("No strong source snippets were found. Should {product} proceed anyway?",
               ("Proceed with writing-guide context", "Narrow the topic", "Stop for review")),
    },
    "scope": {
        "nl": ("Moet {product} de huidige scope en bronnen aanhouden?",
               ("Huidige scope houden", "Invalshoek versmallen", "Invalshoek verbreden")),
        "en": ("Should {product} keep the current scope and retrieved sources?",
               ("Keep current scope", "Narrow the angle", "Broaden the angle")),
    },
}
ANSWER_LABEL = {"nl": "Verduidelijkingen:", "en": "Clarifications:"}

# Wording of the draft written when no model is configured.
DRAFT_WORDING = {
    "nl": {
        "title": "{product} onderbouwde concepttekst",
        "no_profile": "geen gekoppeld profiel",
        "no_source": "- Er zijn geen bronfragmenten opgehaald.",
        "intro": (
            "Deze deterministische concepttekst houdt de {product}-stroom intact "
            "wanneer er geen contentgeneratiemodel is geconfigureerd. In productie "
            "moet de LLM-generatie dit vervangen, maar de tekst bewaart wel de "
            "verfijnde instructie, actieve profielen en bronbasis voor auditbaarheid."
        ),
        "instruction": "**Verfijnde instructie**",
        "profiles": "**Actieve profielen**",
        "sources": "**Gebruikte broncontext**",
        "outro": (
            "Een definitieve redactionele tekst moet de opgehaalde bronnen gebruiken, "
            "de {guide} volgen, onbewezen claims vermijden en "
            "citaten gekoppeld houden aan brononderbouwde uitspraken."
        ),
    },
    "en": {
        "title": "{product} grounded draft",
        "no_profile": "no matched profile",
        "no_source": "- No source snippets were retrieved.",
        "intro": (
            "This phase-1 deterministic draft preserves the {product} flow when no "
            "content-generation model is configured. It should be replaced by the "
            "LLM generation path in production, but it still carries the refined "
            "instruction, active profiles, and source grounding for auditability."
        ),
        "instruction": "**Refined instruction**",
        "profiles": "**Active profiles**",
        "sources": "**Grounded context used**",
        "outro": (
            "A final editorial draft should use the retrieved evidence above, follow "
            "the {guide}, avoid unsupported claims, and keep citations "
            "attached to source-backed statements."
        ),
    },
}

# Names of the draft body in model replies, first match wins.
REPLY_BODY_KEYS = ("body", "body_markdown", "markdown", "content", "draft", "text")

# Phrases and line shapes of plain-text clarification forms.
FORM_PHRASES = (
    "clarification question", "clarification questions", "clarifying question",
    "clarifying questions", "before drafting", "before i draft", "before writing",
    "before i write", "preferred tone", "reply with your choices",
    "respond with your choices", "answer with your choices",
)
INSTRUCTION_STARTS = (
    "please ", "reply ", "respond ", "answer ", "send ", "e.g.", "for example", "(",
    "choose one", "choose your", "choose from", "select one", "select your", "select from",
)
HEADING_STARTS_BARRED = ("please ", "reply ", "i have ")
HEADING_STARTS = ("desired ", "what specific ", "which ")
HEADINGS = (
    "desired length", "tone", "target audience", "audience", "focus", "language", "format",
)
MULTIPLE_PHRASES = (
    "one or more", "select all", "choose all", "pick multiple", "multiple choices",
    "multiple options",
)

# Marker words and passive forms of the language checks.
MARKERS_NL = (
    "de", "het", "een", "van", "voor", "met", "niet", "wordt", "zijn", "bedrijven",
    "klanten", "u", "uw",
)
MARKERS_EN = (
    "the", "and", "for", "with", "not", "are", "companies", "customers", "you", "your",
)
PASSIVE_EN = r"\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b"
PASSIVE_NL = r"\b(?:worden|wordt|werd|werden|geworden)\b"

# Indicator scales and the values that pass.
SCALES = {
    "Maturity": ("low", "medium", "high"),
    "PresenceScale": ("present", "not_present", "unknown"),
    "YesNoScale": ("yes", "no", "unknown"),
    "DeviationYesNo": ("yes", "no", "unknown"),
    "DeviationScale": ("many", "few", "none", "unknown"),
    "AmbiguityScale": ("many", "few", "none", "unknown"),
    "RelevanceScale": ("off_topic", "somewhat", "reasonable", "highly", "unknown"),
    "GroundednessScale": ("none", "limited", "reasonable", "full", "unknown"),
    "ErrorScale": ("numerous", "several", "moderate", "few", "none", "unknown"),
    "CompletenessScale": ("very_incomplete", "incomplete", "fairly", "mostly", "full", "unknown"),
    "ClarityScale": ("unclear", "somewhat", "clear", "very_clear", "unknown"),
    "FitScale": ("none", "limited", "optimal", "unknown"),
    "OptionsScale": ("none", "limited", "many", "unknown"),
    "FivePointScale": ("very_low", "low", "medium", "high", "very_high", "unknown"),
    "LengthScale": ("right", "too_long", "unknown"),
    "LanguageLevelScale": ("A1", "A2", "B1", "B2", "C1", "C2", "unknown"),
    "UsedScale": ("used", "not_used", "unknown"),
    "ApplicableScale": ("applicable", "not_applicable", "unknown"),
    "ExclusionScale": ("exclusion", "no_exclusion", "unknown"),
    "CESScale": ("1_very_difficult", "2_difficult", "3_neutral", "4_easy", "5_very_easy", "unknown"),
    "CSATScale": ("1_very_dissatisfied", "2_dissatisfied", "3_neutral", "4_satisfied",
                  "5_very_satisfied", "unknown"),
    "NPSScale": ("detractor", "passive", "promoter", "unknown"),
    "PublishedScale": ("published", "not_published", "unknown"),
    "SentimentScale": ("neutral", "positive", "negative", "unknown"),
    "GenderScale": ("neutral", "male", "female", "unknown"),
}
PASSING = {
    "PresenceScale": ("present",),
    "YesNoScale": ("yes",),
    "DeviationYesNo": ("no",),
    "DeviationScale": ("few", "none"),
    "AmbiguityScale": ("few", "none"),
    "RelevanceScale": ("somewhat", "reasonable", "highly"),
    "GroundednessScale": ("reasonable", "full"),
    "ErrorScale": ("few", "none"),
    "CompletenessScale": ("fairly", "mostly", "full"),
    "ClarityScale": ("clear", "very_clear"),
    "FitScale": ("optimal",),
    "OptionsScale": ("limited", "many"),
    "FivePointScale": ("high", "very_high"),
    "LengthScale": ("right",),
    "UsedScale": ("used",),
    "ApplicableScale": ("applicable",),
    "ExclusionScale": ("no_exclusion",),
    "Maturity": ("medium", "high"),
    "PublishedScale": ("published",),
    "LanguageLevelScale": ("A1", "A2", "B1"),
}

# Judges in rubric order (rubric, KPI, scale).
JUDGES = (
    ("factuality", "factuality_truthfullness", "ErrorScale"),
    ("truthfullness", "truthfullness", "DeviationScale"),
    ("relevancy", "relevancy", "RelevanceScale"),
    ("privacy_security", "privacy_and_security", "DeviationScale"),
    ("groundedness", "groundedness_source", "GroundednessScale"),
    ("comprehensiveness", "comprehensiveness_answer", "CompletenessScale"),
)

# Values that stop a draft in default mode.
BLOCKING_VALUES = {
    "factuality_truthfullness": ("moderate", "several", "numerous"),
    "relevancy": ("off_topic",),
    "truthfullness": ("many",),
    "privacy_and_security": ("many",),
    "approved_source_content_for_genai": ("exclusion",),
}

# Human steps, in order.
HUMAN_STEPS = (
    "human_expert_check_substance",
    "human_expert_check_compliancy_legal",
    "human_expert_check_content",
    "status_of_evaluation",
)

ORIGINS = ("human", "genai_knowledge", "instant")
CHANNELS = ("web", "chat", "messages", "employee", "app_ib")

# Seed KPI catalogue (id, category, weight, monitoring, indicator,
# relevance for human / genai_knowledge / instant).
_YES, _NO, _IF = "Applicable", "Not applicable", "Only applicable for GenAI source"
KPIS = (
    ("factuality_truthfullness", "Substance", "Blocking", "Mandatory", "ErrorScale", _YES, _YES, _YES),
    ("truthfullness", "Substance", "Blocking", "Mandatory", "DeviationScale", _YES, _YES, _YES),
    ("relevancy", "Substance", "Blocking", "Mandatory", "RelevanceScale", _YES, _YES, _YES),
    ("privacy_and_security", "Compliance", "Blocking", "Mandatory", "DeviationScale", _YES, _YES, _YES),
    ("groundedness_source", "Source", "High", "Mandatory", "GroundednessScale", _NO, _YES, _YES),
    ("comprehensiveness_answer", "Substance", "High", "Mandatory", "CompletenessScale", _YES, _YES, _YES),
    ("tracability", "Source", "Blocking", "Mandatory", "UsedScale", _NO, _YES, _IF),
    ("approved_source_content_for_genai", "Source", "Blocking", "Mandatory", "ExclusionScale", _NO, _YES, _IF),
    ("human_expert_check_substance", "Process", "Blocking", "Mandatory", "YesNoScale", _YES, _YES, _NO),
    ("human_expert_check_compliancy_legal", "Process", "Blocking", "Mandatory", "YesNoScale", _YES, _YES, _NO),
    ("human_expert_check_content", "Process", "Blocking", "Mandatory", "YesNoScale", _YES, _YES, _NO),
    ("status_of_evaluation", "Process", "Blocking", "Mandatory", "YesNoScale", _YES, _YES, _NO),
    ("images_with_missing_alt_text", "Structure", None, None, "PresenceScale", _YES, _YES, _YES),
    ("language", "Style", None, None, "PresenceScale", _NO, _NO, _NO),
    ("writing_style_active", "Style", "High", "Mandatory", "PresenceScale", _YES, _YES, _YES),
    ("sentence_number_of_words", "Structure", None, None, "LengthScale", _YES, _YES, _YES),
    ("paragraph_bubble_number_of_words_sentences", "Structure", None, None, "LengthScale", _YES, _YES, _YES),
    ("bullet_list_points", "Structure", None, None, "PresenceScale", _YES, _YES, _YES),
    ("h1_header_presence", "Structure", None, None, "PresenceScale", _YES, _YES, _YES),
    ("h1_header_keywords", None, None, None, "DeviationYesNo", _YES, _YES, _YES),
    ("reading_level", "Style", None, None, "LanguageLevelScale", _YES, _YES, _YES),
)

# Fixed value: reason of a check that gave no result for a draft.
CHECK_ERROR = "check error: no result"
