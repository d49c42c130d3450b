"""Text rules as Column builders: tokens, stems, terms, structure, metadata, figures and facts.

Every function takes and returns Columns and stays inside the JVM. A regular
expression that may miss gives null, never the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R

#: A stem of the least length and an ending; a shorter stem, so a longer ending, is tried first. No plural after a double s.
SUFFIX_PATTERN = rf"^.{{{R.MIN_STEM},}}?({'|'.join('(?<!s)s' if s == 's' else s for s, _ in R.SUFFIXES)})$"
REPLACEMENTS = {new: [s for s, n in R.SUFFIXES if n == new] for _, new in R.SUFFIXES if new}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` only takes blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words_of(text: Column) -> Column:
    """Parts between white space, as an array without empty parts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


# --- analysis -------------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    """Surface tokens in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(R.TOKEN), F.lit(0)), F.array().cast("array<string>"))


def suffix_of(token: Column) -> Column:
    """The ending that a token loses, or the empty string: of the rules that fit, the first and longest.

    One regular expression keeps the generated code small enough to be compiled; a long
    chain of conditions would run interpreted.
    """
    return F.regexp_extract(token, SUFFIX_PATTERN, 1)


def without_suffix(token: Column, suffix: Column) -> Column:
    new = F.lit("")
    for ending, gone in REPLACEMENTS.items():
        new = F.when(suffix.isin(*gone), ending).otherwise(new)
    return F.concat(F.left(token, F.length(token) - F.length(suffix)), new)


def second_suffix(once: Column, first: Column) -> Column:
    """After a plural another ending may go."""
    return F.when(first.isin(*R.PLURALS), suffix_of(once)).otherwise("")


def finished_stem(token: Column, twice: Column) -> Column:
    bare = F.when((F.length(twice) > R.MIN_STEM) & twice.endswith("e"), F.left(twice, F.length(twice) - 1)).otherwise(twice)
    return F.when((F.length(token) > R.MIN_STEM) & ~token.rlike("[0-9]"), bare).otherwise(token)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def half_up(value: Column, places: int) -> Column:
    """Rounded with halves up, also where binary fractions fall a hair short of the half."""
    return F.round(value + 1e-9, places)


def stem(token: Column) -> Column:
    """Stem of one token; short tokens and tokens with a digit stay. For columns of tokens see ``stemmed``."""
    once = lambda s: F.struct(s.alias("s"), without_suffix(token, s).alias("o"))
    again = lambda x: F.struct(x["o"].alias("o"), second_suffix(x["o"], x["s"]).alias("s"))
    return let(let(let(let(suffix_of(token), once), again), lambda x: without_suffix(x["o"], x["s"])), lambda t: finished_stem(token, t))


def stemmed(rows: DataFrame, token: str, name: str) -> DataFrame:
    """``rows`` with the stem of column ``token`` as ``name``, in layers of small expressions.

    The stem is never null (a null token gives the empty stem), so that joins on it infer
    no null check; pushed below the layers such a check would unfold all of them.
    """
    one = rows.withColumn("__s", suffix_of(F.col(token)))
    two = one.withColumn("__o", without_suffix(F.col(token), F.col("__s")))
    three = two.withColumn("__s", second_suffix(F.col("__o"), F.col("__s")))
    four = three.withColumn("__o", without_suffix(F.col("__o"), F.col("__s")))
    return four.withColumn(name, F.coalesce(finished_stem(F.col(token), F.col("__o")), F.lit(""))).drop("__s", "__o")


def surface_terms(tokens: Column) -> Column:
    """Tokens, each followed by the parts (longer than one character) of a compound; not stemmed yet."""

    def parts(token: Column) -> Column:
        split = F.filter(F.split(token, R.COMPOUND), lambda p: F.length(p) > 1)
        return F.when(token.rlike(R.COMPOUND), F.concat(F.array(token), split)).otherwise(F.array(token))

    return F.flatten(F.transform(tokens, parts))


def analyze(text: Column) -> Column:
    """Index terms of a short text. For corpora, stem the distinct vocabulary instead (``operators.index``)."""
    return F.transform(surface_terms(tokenize(text)), stem)


def is_content_term(term: Column, stopwords: list[str]) -> Column:
    return ~term.isin(stopwords) & (F.length(term) > 1)


def question_terms(question: Column) -> Column:
    """Unstemmed tokens without question words, repeats kept."""
    return F.filter(tokenize(question), lambda t: ~t.isin(*R.QUESTION_WORDS))


def word_stem(word: str) -> str:
    """``stem`` of a driver-side word (for stopword lists), by the same pattern and replacements."""
    if len(word) <= R.MIN_STEM or re.search("[0-9]", word):
        return word
    new = {gone: ending for ending, lost in REPLACEMENTS.items() for gone in lost}
    ending_of = lambda w: (re.search(SUFFIX_PATTERN, w) or ["", ""])[1]
    without = lambda w, ending: w.removesuffix(ending) + new.get(ending, "")
    first = ending_of(word)
    once = without(word, first)
    twice = without(once, ending_of(once)) if first in R.PLURALS else once
    return re.sub(f"(?<=.{{{R.MIN_STEM}}})e$", "", twice)


STOP_STEMS = sorted({word_stem(w) for w in R.STOPWORDS})

# --- structure ----------------------------------------------------------------------------


def clean_cell(value: Column) -> Column:
    """A table cell on one line, bars escaped; null is empty."""
    flat = stripped(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def rows_to_markdown(rows: Column) -> Column:
    """A Markdown table from ARRAY<ARRAY<STRING>>: empty rows and columns go, one row is joined text."""
    cells = F.transform(rows, lambda r: F.transform(r, clean_cell))
    grid = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    keep = F.filter(columns, lambda i: F.exists(grid, lambda r: cell(r, i) != ""))
    full = F.transform(grid, lambda r: F.transform(keep, lambda i: cell(r, i)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    header = F.transform(F.get(full, 0), lambda c, i: F.when(c == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(c))
    rule = line(F.transform(header, lambda _: F.lit("---")))
    table = F.array_join(F.concat(F.array(line(header), rule), F.transform(F.slice(full, 2, F.size(full)), line)), "\n")
    return F.when(F.size(full) == 0, "").when(F.size(full) == 1, F.array_join(F.get(full, 0), " | ")).otherwise(table)


def rows_to_key_values(rows: Column) -> Column:
    """A bullet list from ARRAY<ARRAY<STRING>>; the first cell that isn't empty is the key."""
    cells = F.filter(F.transform(rows, lambda r: F.filter(F.transform(r, clean_cell), lambda c: c != "")), lambda r: F.size(r) > 0)

    def line(r: Column) -> Column:
        key = stripped(F.regexp_replace(F.get(r, 0), ":+$", ""))
        rest = F.array_join(F.slice(r, 2, F.size(r)), " | ")
        return F.when(F.size(r) == 1, F.concat(F.lit("- "), F.get(r, 0))).otherwise(F.concat(F.lit("- "), key, F.lit(": "), rest))

    return F.array_join(F.transform(cells, line), "\n")


def is_bullet(line: Column) -> Column:
    bare = stripped(line)
    return (bare != "") & (bare.isin(*R.BULLETS) | ((F.length(bare) <= 2) & ~bare.rlike(r"[\p{L}\p{N}]")))


def heading(line: Column) -> Column:
    """STRUCT<level, text> of a numbered heading, or null."""
    bare = stripped(line)
    number, rest = F.regexp_extract(bare, R.HEADING, 1), F.regexp_extract(bare, R.HEADING, 2)
    ok = bare.rlike(R.HEADING) & ~rest.rlike("[,;]$") & (F.size(words_of(rest)) <= 12)
    level = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    return F.when(ok, F.struct(level.cast("int").alias("level"), stripped(F.concat(number, F.lit(". "), rest)).alias("text")))


def header_line(lines: Column) -> Column:
    """The metadata line among the first eight: with a bar or a gap if there is one, else any hint, else empty."""
    first = F.filter(F.slice(lines, 1, 8), lambda x: x.rlike(R.HEADER_HINT))
    laid_out = F.filter(first, lambda x: x.contains("|") | x.contains("  "))
    return stripped(F.coalesce(F.get(laid_out, 0), F.get(first, 0), F.lit("")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def citation_label(section: Column) -> Column:
    return stripped(F.element_at(F.split(section, ">"), -1))


def clip(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis if more went."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > limit, F.concat(F.left(whole, F.lit(limit)), F.lit("…"))).otherwise(whole)


def snippet(text: Column, limit: int) -> Column:
    """White space squeezed, then clipped."""
    return clip(stripped(F.regexp_replace(text, r"\s+", " ")), limit)


def embed_text(title: Column, section: Column, department: Column, doc_type: Column, effective: Column, version: Column, body: Column, content_type: Column) -> Column:
    """Text to index: breadcrumb, descriptor and body. Currency is left out, as it changes without the text."""
    named = F.coalesce(section, F.lit("")) != ""
    crumb = F.when(named, F.concat(title, F.lit(" > "), section)).otherwise(title)
    dated = F.when(F.coalesce(effective, F.lit("")) != "", F.concat(F.lit(", effective "), effective)).otherwise("")
    numbered = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit(", version "), version)).otherwise("")
    descriptor = F.concat(department, F.lit(" "), F.replace(doc_type, F.lit("_"), F.lit(" ")), dated, numbered)
    lead = F.when(content_type == "table", F.concat(F.lit("\nTable from section '"), F.when(named, section).otherwise(title), F.lit("':"))).otherwise("")
    return F.concat(crumb, F.lit("\n["), descriptor, F.lit("]"), lead, F.lit("\n\n"), body)


# --- metadata ------------------------------------------------------------------------------


def _iso_date(part: Column) -> Column:
    full, month = rf"(?i)([A-Za-z]+)\s+(\d{{1,2}}),?\s+({R.YEAR})", rf"(?i)([A-Za-z]+)\s+({R.YEAR})"
    table = F.create_map(*[x for i, m in enumerate(R.MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])
    number = lambda pattern: F.try_element_at(table, F.lower(F.regexp_extract(part, pattern, 1)))
    day = F.concat_ws("-", found(part, full, 3), number(full), F.lpad(F.regexp_extract(part, full, 2), 2, "0"))
    first = F.concat_ws("-", found(part, month, 2), number(month), F.lit("01"))
    year = found(part, R.YEAR_WORD, 0)
    return F.when(number(full).isNotNull(), day).when(number(month).isNotNull(), first).when(year.isNotNull(), F.concat(year, F.lit("-01-01")))


def effective_dates(text: Column) -> Column:
    """STRUCT<start, until> of ISO dates in a date expression; either may be null."""
    parts = F.split(stripped(text), R.RANGE_MARK, 2)
    tidy = lambda i: F.regexp_replace(stripped(F.get(parts, i)), "[.,;]+$", "")
    return F.struct(_iso_date(tidy(0)).alias("start"), _iso_date(tidy(1)).alias("until"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def department(path: Column, header: Column) -> Column:
    """Top folder if it is a known one, else an alias in the header, else the folder, else General."""
    top = F.when(F.size(F.split(path, "/")) > 1, F.get(F.split(path, "/"), 0)).otherwise("")
    out = F.when(F.lower(top) == R.DEPARTMENTS[0].lower(), R.DEPARTMENTS[0])
    for name in R.DEPARTMENTS[1:]:
        out = out.when(F.lower(top) == name.lower(), name)
    for alias, name in R.DEPARTMENT_ALIASES:
        out = out.when(F.lower(F.coalesce(header, F.lit(""))).contains(alias), name)
    return out.when(top != "", top).otherwise("General")


def doc_type(title: Column, path: Column) -> Column:
    text = F.lower(F.concat(title, F.lit(" "), file_stem(path)))
    out = None
    for name, needles in R.DOC_TYPES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("document")


def series(path: Column, department_: Column, doc_type_: Column) -> Column:
    """STRUCT<key, year> of a file with a year in its name, else null."""
    name = file_stem(path)
    year = found(name, R.YEAR, 0)
    base = F.lower(F.regexp_replace(F.regexp_replace(name, R.YEAR, ""), "^[ _-]+|[ _-]+$", ""))
    key = F.concat_ws("|", F.lower(department_), doc_type_, base)
    return F.when(year.isNotNull() & (base != ""), F.struct(key.alias("key"), year.cast("int").alias("year")))


def metadata(path: Column, title: Column, header: Column, full_text: Column) -> Column:
    """STRUCT of version, dates and supersession hints of a document."""
    start = F.left(full_text, F.lit(1500))
    either = lambda pattern: F.coalesce(found(header, pattern), found(start, pattern))
    dates = effective_dates(either(R.EFFECTIVE))
    section = department(path, header)
    kind = doc_type(title, path)
    return F.struct(
        section.alias("department"),
        kind.alias("doc_type"),
        either(R.VERSION).alias("version"),
        dates["start"].alias("effective_date"),
        dates["until"].alias("effective_until"),
        found(full_text, R.SUPERSEDES_FORWARD).alias("supersedes_file"),
        found(full_text, R.SUPERSEDES_BACKWARD).alias("superseded_by_file"),
        stripped(found(header, R.SUPERSEDES_TEXT)).alias("supersedes_text"),
        series(path, section, kind).alias("series"),
    )


# --- figures and facts -----------------------------------------------------------------------


def normalise_number(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, "$, ", ""), r"\.+$", ""))


def figures(text: Column) -> Column:
    """Numbers, amounts and percentages as they are written."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(R.NUMBER), F.lit(0)), F.array().cast("array<string>"))


def unsupported_figures(answer: Column, sources: Column) -> Column:
    """Figures of ``answer`` that no source has; citation markers and small whole numbers are passed over.

    A number right after an opening bracket is masked before extraction, which
    equals looking at the character before each match.
    """
    masked = F.regexp_replace(answer, rf"\[(?:{R.NUMBER})", "[ ")

    def bare(raw: Column, known: Column) -> Column:
        value = normalise_number(raw)
        small = value.rlike(r"^\d+$") & (F.coalesce(value.try_cast("double"), F.lit(99.0)) <= 12)
        return ~F.array_contains(known, value) & ~(small & ~raw.contains("%") & ~raw.contains("$"))

    return let(F.transform(figures(sources), normalise_number), lambda known: F.filter(figures(masked), lambda raw: bare(raw, known)))


def normalise_fact(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), ",$", ""), r"\s+", " ")


def states_fact(answer: Column, fact: Column) -> Column:
    """Whether the answer has one of the fact's alternatives; pure figures only at digit boundaries."""

    def matches(alternative: Column, hay: Column) -> Column:
        needle = stripped(normalise_fact(alternative))
        quoted = F.regexp_replace(needle, r"\.", r"\\\\.")
        bounded = F.concat(F.lit(r"(?<!\d)(?<!\d\.)"), quoted, F.lit(r"(?!\d)(?!\.\d)"))
        return (needle != "") & F.when(needle.rlike(r"^[\d.]+%?$"), F.regexp(hay, bounded)).otherwise(F.contains(hay, needle))

    return let(normalise_fact(answer), lambda hay: F.exists(F.split(fact, r"\|"), lambda a: matches(a, hay)))


def declines(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(R.DECLINE)


def section_matches(expected: Column, sections: Column) -> Column:
    """Substring either way, or the same leading number."""
    want, number = normalise_fact(expected), found(expected, r"^\s*([\d.]+)")
    return F.exists(sections, lambda s: F.contains(normalise_fact(s), want) | F.contains(want, normalise_fact(s)) | F.coalesce(found(s, r"^\s*([\d.]+)") == number, F.lit(False)))


def parse_json_reply(text: Column) -> Column:
    """VARIANT of a model's reply: whole, without a code fence, or the outermost braces or brackets; null if none parses."""
    fenced = stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.coalesce(F.try_parse_json(fenced), F.try_parse_json(found(fenced, r"(?s)(\{.*\})")), F.try_parse_json(found(fenced, r"(?s)(\[.*\])")))


def redact(name: Column, value: Column) -> Column:
    """A setting's value for reports: secrets (by name) show their length and, from 16 characters, eight digits of their hash."""
    bare = stripped(F.coalesce(value, F.lit("")))
    mark = F.when(F.length(bare) >= 16, F.concat(F.lit(" sha256:"), F.left(F.sha2(bare, 256), F.lit(8)))).otherwise("")
    shown = F.concat(F.lit("<set len="), F.length(bare).cast("string"), mark, F.lit(">"))
    return F.when(value.isNull(), "<UNSET>").when(bare == "", "<EMPTY>").when(name.rlike(R.SECRET_NAME), shown).otherwise(bare)


def http_failure(status: Column, body: Column) -> Column:
    """Category of a failed call. Both kinds of 403 are not accessible; ``blocked`` tells the network kind."""
    return F.when(status.isin(401, 403), "not_accessible").when(status == 404, "not_found").otherwise("unavailable")


def blocked_by_network(status: Column, body: Column) -> Column:
    marker = F.lit(False)
    for words in R.ACCESS_RULE_WORDS:
        marker = marker | F.lower(F.coalesce(body, F.lit(""))).contains(words)
    return (status == 403) & marker


def http_headline(service: Column, category: Column, status: Column, attempts: Column) -> Column:
    code = F.concat(F.lit(" (HTTP "), F.coalesce(status.cast("string"), F.lit("None")), F.lit(")"))
    tries = F.when(attempts > 0, F.concat(F.lit(" after "), attempts.cast("string"), F.lit(" attempts"))).otherwise("")
    out = F.when(category == "unreachable", " endpoint unreachable").when(category == "unavailable", F.concat(F.lit(" endpoint unavailable"), tries, code))
    return F.concat(service, out.when(category == "not_found", F.concat(F.lit(" endpoint or deployment not found"), code)).otherwise(F.concat(F.lit(" endpoint not accessible"), code)))


def is_retryable(status: Column) -> Column:
    return status.isin(*R.RETRYABLE)


def format_number(raw: Column, code: Column) -> Column:
    """A spreadsheet number by its format code: percentages, amounts, whole numbers bare."""
    value = raw.try_cast("double")
    places = F.coalesce(F.length(F.regexp_extract(code, r"\.([^%]*)%", 1)), F.lit(0))
    shown = F.when(places == 0, F.format_string("%.0f", value * 100)).when(places == 1, F.format_string("%.1f", value * 100)).when(places == 2, F.format_string("%.2f", value * 100)).otherwise(F.format_string("%.3f", value * 100))
    amount = F.when(code.contains(".00"), F.format_string("$%,.2f", value)).otherwise(F.format_string("$%,.0f", value))
    whole = F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))
    return F.when(value.isNull(), raw).when(code.contains("%"), F.concat(shown, F.lit("%"))).when(code.contains("$"), amount).otherwise(whole)
