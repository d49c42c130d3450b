"""Fixed values of the text, query and ranking rules.

Everything here must equal the behaviour that users rely on; nothing is derived.
Column builders and the SQL oracles are generated from these same tables.
"""

from __future__ import annotations

# --- analysis ----------------------------------------------------------------------

TOKEN = r"[a-z0-9]+(?:[.\-/%$][a-z0-9]+)*|\$[\d,.]+|\d+%"
COMPOUND = "[-/.]"
MIN_STEM = 3

#: Ordered (suffix, replacement); the first that fits is applied.
SUFFIXES = (
    ("ational", "ate"), ("ization", "ize"), ("isation", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("ations", "ate"), ("ation", "ate"), ("ements", ""), ("ement", ""), ("ments", ""), ("ment", ""), ("ingly", ""), ("edly", ""),
    ("ities", "ity"), ("ies", "y"), ("ing", ""), ("ers", ""), ("ors", ""), ("est", ""), ("ed", ""), ("er", ""), ("or", ""),
    ("es", ""), ("ly", ""), ("al", ""), ("s", ""),
)
#: After one of these a second suffix may go.
PLURALS = ("s", "es", "ies")

STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "what", "which", "who", "how", "do", "does", "did", "for", "of", "to", "in", "on",
    "at", "and", "or", "my", "i", "we", "our", "can", "if", "it", "be", "there", "any", "much", "many", "have", "has", "get", "am",
)
QUESTION_WORDS = (
    "what", "whats", "what's", "how", "much", "many", "is", "are", "the", "a", "an", "our", "my", "we", "i", "do", "does", "there",
    "for", "of", "can", "get", "to", "on", "in", "and", "it", "its", "that", "this",
)
GENERIC_HEADS = (
    "limit", "limits", "cap", "caps", "maximum", "max", "minimum", "min", "threshold", "thresholds", "allowance", "amount", "rate",
    "rates", "cost", "costs", "price", "pricing", "fee", "fees", "deadline", "requirement", "requirements", "policy", "rule", "rules",
    "approval", "discount", "notice", "period", "sla",
)

# --- structure -----------------------------------------------------------------------

BULLETS = ("•", "●", "▪", "◦", "-", "–", "*", "o")
HEADING = r"^(\d+(?:\.\d+)*)[.)]?\s+(\S.{0,90})$"
HEADER_HINT = r"(?i)(effective|plan year|last updated|template version|version)\s*[:\s]"
PAGE_LINE = r"(?i)^Page \d+( of \d+)?$"

TARGET_CHARS, MAX_CHARS, OVERLAP_CHARS, MAX_TABLE_CHARS, WINDOW_CHARS = 900, 1400, 150, 3000, 512
SENTENCE_END = r"(?<=[.!?;:])\s+"
ANSWER_SENTENCE_END = r"(?<=[.!?])\s+"

# --- metadata --------------------------------------------------------------------------

DEPARTMENTS = ("Finance", "HR", "IT", "Legal", "Sales")
DEPARTMENT_ALIASES = (
    ("finance department", "Finance"), ("human resources", "HR"), ("people operations", "HR"), ("information technology", "IT"),
    ("legal department", "Legal"), ("sales operations", "Sales"),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DOC_TYPES = (
    ("rate_card", ("rate card", "pricing")), ("schedule", ("schedule", "discount")), ("template", ("agreement", "template", "nda")),
    ("guide", ("guide",)), ("policy", ("policy",)),
)
FILE_NAME = r"([A-Za-z0-9_\-]+\.(?:pdf|docx|xlsx))"
SUPERSEDES_FORWARD = rf"(?i)(?:supersedes?|replaces?)\s+(?:the\s+)?{FILE_NAME}"
SUPERSEDES_BACKWARD = rf"(?i)see\s+{FILE_NAME}\s+for\s+(?:the\s+)?(?:current|latest|new)"
SUPERSEDES_TEXT = r"(?i)supersede[sd]?(?:\s+by)?\s*:\s*([^|\n]+)"
VERSION = r"(?i)(?:template\s+)?version\s*:?\s*v?(\d+(?:\.\d+)?)"
EFFECTIVE = r"(?i)(?:effective|plan year|last updated)\s*:?\s*([^|\n]+)"
RANGE_MARK = r"\s+[–—-]\s+|\s+to\s+"
YEAR = r"(?:19|20)\d{2}"

# --- questions ---------------------------------------------------------------------------

HISTORY_TURNS, MAX_SUBQUERIES = 6, 3
PRONOUN = r"(?i)\b(it|its|it's|that|this|those|these|they|them|their|there|one|ones|same|above|former|latter)\b"
ELLIPTIC_OPENER = r"(?i)^\s*(and|but|so|what about|how about|whatabout|ok(?:ay)? but|also|then|why|why not|is there|are there|any|what if|which one)\b"
WHAT_ABOUT = r"(?i)^\s*(?:and\s+)?(?:what|how)\s+about\s+(?:the\s+)?(.+?)\s*[?.!]*\s*$"
COMPARATIVE = r"(?i)\b(compare|comparison|versus|vs\.?|difference(?:s)? between|both|each of|as well as|relative to)\b"
COMPARE_ASPECT = r"(?i)compare (?:the )?(.+?) (?:for|of|between) (.+?) and (.+?)[?.]?$"
DIFFERENCE_BETWEEN = r"(?i)difference(?:s)? between (.+?) and (.+?)[?.]?$"
VERSUS = r"(?i)^(.*?)\b(?:vs\.?|versus)\b(.*)$"
AND_WORD = r"(?i)\band\b"
VERSUS_LEAD = r"(?i)^((?:what|which|how)\b.*?\b(?:is|are|for)\b)\s*"
AND_LEAD = r"(?i)^((?:what|which|how|when|who)\b[^,]{0,24}?\b(?:is|are|do|does)\b)"
YEAR_WORD = r"\b(?:19|20)\d{2}\b"
HISTORY_WORDS = r"(?i)\b(previous|prior|old|older|former|last year|used to|historical|before|superseded|legacy|back then|at the time)\b"
CHANGE_WORDS = r"(?i)\b(chang(?:e|ed|es|ing)|what'?s new|new for|increase[ds]?\s+(?:from|to)|used to be|no longer|previously)\b"

# --- scoring -------------------------------------------------------------------------------

BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
RETRIEVE_TOP_K, CONTEXT_TOP_K, BASELINE_TOP_K = 20, 5, 5
RERANK_WINDOW, SNIPPET_CHARS = 20, 700
MIN_RELEVANCE, MAX_CONTEXT_CHARS, MIN_CONFIDENCE = 4.0, 12_000, 0.35
WEAK, STRONG = 4.0, 9.0
BANDS = (("llm", 4.0, 9.0), ("lexical", 4.0, 8.5), ("lexical-after-degenerate-llm", 4.0, 8.5), ("remote-semantic", 4.0, 7.0))
SUPERSEDED_PENALTY, YEAR_BONUS, YEAR_PENALTY = 3.0, 3.0, 1.0

# --- answers ---------------------------------------------------------------------------------

NUMBER = r"\$\s?\d[\d,]*(?:\.\d+)?|\b\d+(?:\.\d+)?\s?%|\b\d[\d,]*(?:\.\d+)?\b"
MARKER = r"\[(\d+)\]"
REFUSAL = "INSUFFICIENT_EVIDENCE"
NON_ANSWERS = ("insufficient_evidence", "denied")
DECLINE = (
    r"(?im)(sources?|context|documents?|knowledge base|information)\s+(?:provided\s+)?(?:do|does|did)\s*n[o']t\s+(?:include|mention|contain|specify|provide|list|cover|address|state)"
    r"|(?:do|does|did)\s*n[o']t\s+(?:include|mention|contain|specify|provide|list)\s+(?:any\s+)?information"
    r"|not\s+(?:explicitly\s+)?(?:listed|mentioned|specified|included|covered|provided|available|defined|stated|detailed)\s+(?:in|within)\s+(?:the\s+)?(?:provided\s+)?(?:sources?|context|documents?)"
    r"|no\s+information\s+(?:is\s+)?(?:available|provided|found)"
    r"|(?:cannot|can\s*not|unable to)\s+(?:find|determine|answer|locate)"
    r"|do\s*n[o']t\s+have\s+enough|insufficient_evidence"
    r"|^\s*no,?\s+the\s+company\s+does\s+not\s+(?:offer|provide|have)"
)
PROMPT_PRICE, COMPLETION_PRICE = 0.0025, 0.01

# --- reports and remote calls ----------------------------------------------------------------

SECRET_NAME = r"(?i)KEY|SECRET|TOKEN|PASSWORD|CONNECTION_STRING|CREDENTIAL|SAS"
ACCESS_RULE_WORDS = ("access denied", "firewall", "virtual network", "not allowed to access", "public network access", "forbidden by")
RETRYABLE = (408, 429, 500, 502, 503, 504)
RETRY_ATTEMPTS, RETRY_CAP_SECONDS = 4, 8.0
LOWER_IS_BETTER = (
    "hallucination_rate", "latency_p50_ms", "latency_p95_ms", "mean_prompt_tokens", "mean_completion_tokens", "mean_llm_calls",
    "total_cost_usd", "cost_per_question_usd",
)

# --- local embedder ----------------------------------------------------------------------------

EMBED_WORD = r"[a-z0-9$%.]+"
EMBED_WIDTH = 768
WORD_WEIGHT, PAIR_WEIGHT, GRAM_WEIGHT = 1.0, 0.5, 0.3

# What a user is told, word for word.
WHICH_ONE = "That could refer to a few different things in our documents. Which did you mean?\n"
NEAREST = " The closest documents I found were: "
ABSTAIN = "I don't have enough in the knowledge base to answer that reliably, so I'd rather not guess."
NOT_FOR_YOU = ("I could not find anything on that in the documents available to you (", "). If this belongs to another department, ask its owner or request access.")
NOTHING = "I could not find anything about that in the knowledge base."
