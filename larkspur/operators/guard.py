"""Guardrails: sufficiency, ambiguity, grounding, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def sufficiency(hits: DataFrame, floor: float = R.MIN_RELEVANCE) -> DataFrame:
    """(query_id, top_score, margin, sufficient) from hits in order (``place``, ``relevance``)."""
    first = F.max(F.when(F.col("place") == 1, F.col("relevance")))
    second = F.max(F.when(F.col("place") == 2, F.col("relevance")))
    out = hits.groupBy("query_id").agg(first.alias("top_score"), second.alias("second"))
    margin = F.col("top_score") - F.coalesce("second", F.lit(0.0))
    return out.select("query_id", "top_score", margin.alias("margin"), (F.col("top_score") >= floor).alias("sufficient"))


def vagueness(question: Column) -> Column:
    """STRUCT<generic, qualifiers>: whether a short question names only a category of value, and its other terms."""
    terms = T.question_terms(question)
    heads = F.filter(terms, lambda t: t.isin(*R.GENERIC_HEADS))
    qualifiers = F.size(terms) - F.size(heads)
    return F.struct(((F.size(terms) <= 4) & (F.size(heads) > 0) & (qualifiers < 2)).alias("generic"), qualifiers.alias("qualifiers"))


def ambiguity(hits: DataFrame) -> DataFrame:
    """(query_id, ambiguous, departments, documents, spread, options) from hits in order.

    Needs question, place, relevance, doc_id, department, title, section_path. The five
    first hits count; a question with one qualifier is only ambiguous if scores are close.
    """
    top = hits.filter("place <= 5")
    label = F.concat(F.col("section_path"), F.lit(" — "), F.col("title"), F.lit(" ("), F.col("department"), F.lit(")"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "section_path")
    entry = F.struct("place", label.alias("label"), key.alias("key"))
    per = top.groupBy("query_id").agg(
        F.first("question").alias("question"),
        F.countDistinct("department").alias("departments"),
        F.countDistinct("doc_id").alias("documents"),
        F.max(F.when(F.col("place") == 1, F.col("relevance"))).alias("top"),
        F.max(F.struct(F.when(F.col("place") <= 3, F.col("place")).alias("p"), F.col("relevance").alias("r")))["r"].alias("third"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    spread = F.col("top") - F.col("third")
    scattered = (F.col("departments") >= 2) | (F.col("documents") >= 3)
    vague = vagueness(F.col("question"))
    ambiguous = vague["generic"] & scattered & ((vague["qualifiers"] == 0) | (spread < 1.5))
    first = F.filter("entries", lambda e: ~F.exists("entries", lambda d: (d["key"] == e["key"]) & (d["place"] < e["place"])))
    options = F.slice(F.transform(first, lambda e: e["label"]), 1, 5)
    nothing = F.array().cast("array<string>")
    return per.select("query_id", ambiguous.alias("ambiguous"), "departments", "documents", spread.alias("spread"), F.when(ambiguous, options).otherwise(nothing).alias("options"))


def markers(answer: Column) -> Column:
    """Citation numbers of an answer in order of writing."""
    return F.transform(F.coalesce(F.regexp_extract_all(answer, F.lit(R.MARKER), F.lit(1)), F.array().cast("array<string>")), lambda m: F.coalesce(m.try_cast("int"), F.lit(2147483647)))


def invalid_markers(answer: Column, sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(markers(answer), lambda m: (m < 1) | (m > sources))))


def citations_valid(answer: Column, sources: Column) -> Column:
    return (F.size(markers(answer)) > 0) & (F.size(invalid_markers(answer, sources)) == 0)


def groundedness(unsupported: Column, valid: Column, model_share: Column | None = None) -> Column:
    """0 to 1 from the number of unsupported figures and valid citations; a model's supported share caps it."""
    score = 1.0 - F.least(F.lit(0.6), 0.3 * unsupported) - F.when(valid, 0.0).otherwise(0.2)
    if model_share is not None:
        score = F.least(score, F.coalesce(model_share, F.lit(1.0)))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def confidence(top_score: Column, margin: Column, grounded: Column, valid: Column) -> Column:
    retrieval = F.least(F.lit(1.0), top_score / 10.0)
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / 4.0))
    return T.half_up(0.45 * retrieval + 0.15 * lead + 0.30 * grounded + 0.10 * F.when(valid, 1.0).otherwise(0.0), 3)
