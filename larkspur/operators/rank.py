"""Ranking after search: merging, currency, interleaving, reranking, calibration.

All functions work on hits of many questions at once: a row per question, sub-question
and chunk. Windows are per question over at most a few dozen hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .understand import explicit_year, wants_history


def merge_subqueries(hits: DataFrame) -> DataFrame:
    """One row per question and chunk: the best score, of equal ones the first sub-question's (column ``sub``)."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc(F.round("score", 12)), "sub")
    return hits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def drop_superseded(hits: DataFrame) -> DataFrame:
    """Without hits that are not current where a current hit has the same department and type.

    Questions that name a year or ask about the past keep all. Columns: query_id,
    question, department, doc_type, is_current.
    """
    peers = Window.partitionBy("query_id", "department", "doc_type")
    historical = explicit_year(F.col("question")).isNotNull() | wants_history(F.col("question"))
    covered = F.max(F.col("is_current").cast("int")).over(peers) == 1
    return hits.withColumn("__gone", ~historical & ~F.col("is_current") & covered).filter("not __gone").drop("__gone")


def interleave(hits: DataFrame, k: int | None, order_by: list[Column]) -> DataFrame:
    """Round-robin over sub-questions (``sub``), in ``order_by`` within each; the first ``k``, as ``place`` from 1."""
    depth = F.row_number().over(Window.partitionBy("query_id", "sub").orderBy(*order_by))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("__depth", "sub"))
    out = hits.withColumn("__depth", depth).withColumn("place", place).drop("__depth")
    return out if k is None else out.filter(F.col("place") <= k)


def content_terms(question: Column) -> Column:
    """Stemmed terms of a question without stopwords, repeats kept."""
    return F.filter(T.analyze(question), lambda t: T.is_content_term(t, T.STOP_STEMS))


def lexical_score(terms: Column, body: Column, heading: Column) -> Column:
    """0 to 10: coverage of the question's terms by body and heading terms, and one more for a matching figure."""

    def score(s: Column) -> Column:
        asked = s["terms"]
        share = lambda where: F.size(F.filter(asked, lambda t: F.array_contains(s[where], t))) / F.size(asked)
        figure = F.exists(asked, lambda t: t.rlike("[0-9]") & F.array_contains(s["body"], t)).cast("double")
        value = 10.0 * (0.7 * share("body") + 0.3 * share("heading")) + figure
        return F.when(F.size(asked) == 0, F.lit(5.0)).otherwise(T.half_up(F.least(value, F.lit(10.0)), 2))

    return T.let(F.struct(terms.alias("terms"), F.array_distinct(body).alias("body"), heading.alias("heading")), score)


def lexical_rerank(hits: DataFrame, window: int = R.RERANK_WINDOW, postings: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """``hits`` (query_id, question, title, section_path, text, place) with rerank_score; beyond the window it is 0.

    With the index's ``postings`` (key, term) no text is analysed: of each hit's body only
    the question's terms are looked up, in one join for all questions. Questions are the
    same for all hits of a query_id.
    """
    heading = F.concat_ws(" ", "title", "section_path")
    if postings is not None:
        asked = hits.groupBy("query_id").agg(F.first("question").alias("question")).select("query_id", F.explode(content_terms(F.col("question"))).alias("term")).distinct()
        inside = hits.filter(F.col("place") <= window).select("query_id", key).distinct()
        held = postings.select(key, "term").join(asked, "term").join(inside, ["query_id", key], "left_semi")
        bodies = held.groupBy("query_id", key).agg(F.collect_set("term").alias("__body"))  # at most a question's terms
        met = hits.join(bodies, ["query_id", key], "left").withColumn("__body", F.coalesce("__body", F.array().cast("array<string>")))
        score = lexical_score(content_terms(F.col("question")), F.col("__body"), T.analyze(heading))
        return met.withColumn("rerank_score", F.when(F.col("place") <= window, score).otherwise(F.lit(0.0))).drop("__body")
    score = lexical_score(content_terms(F.col("question")), T.analyze(F.col("text")), T.analyze(heading))
    return hits.withColumn("rerank_score", F.when(F.col("place") <= window, score).otherwise(F.lit(0.0)))


def fall_back_when_degenerate(hits: DataFrame) -> DataFrame:
    """Model scores (model_score, may be null) unless a question's are all 0 or missing: then the lexical ones.

    Adds rerank_score and rerank_method. Expects lexical_score.
    """
    per = Window.partitionBy("query_id")
    asked = F.max(F.col("model_score").isNotNull().cast("int")).over(per) == 1
    dead = F.max(F.coalesce("model_score", F.lit(0.0))).over(per) <= 0
    method = F.when(~asked, "lexical").when(dead, "lexical-after-degenerate-llm").otherwise("llm")
    clamped = F.least(F.greatest(F.coalesce("model_score", F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
    return hits.withColumn("rerank_method", method).withColumn("rerank_score", F.when(F.col("rerank_method") == "llm", clamped).otherwise(F.col("lexical_score")))


def calibrate(method: Column, score: Column) -> Column:
    """Score on the shared axis, by the method's band; an unknown method's score stays."""
    out = None
    for name, weak, strong in R.BANDS:
        scaled = R.WEAK + (score - weak) / (strong - weak) * (R.STRONG - R.WEAK)
        value = T.half_up(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(10.0)), 3)
        out = F.when(method == name, value) if out is None else out.when(method == name, value)
    return out.otherwise(score)


def version_boost(question: Column, effective_date: Column, is_current: Column) -> Column:
    year = F.left(effective_date, F.lit(4)).try_cast("int")
    asked = explicit_year(question)
    named = F.when(year == asked, R.YEAR_BONUS).otherwise(-R.YEAR_PENALTY)
    stale = F.when(~is_current & ~wants_history(question), -R.SUPERSEDED_PENALTY).otherwise(0.0)
    return F.when(asked.isNotNull() & year.isNotNull(), named).otherwise(stale)


def version_rank(hits: DataFrame) -> DataFrame:
    """``hits`` with recency_boost and the final ``score``: rerank score (or search score) plus boost."""
    boost = version_boost(F.col("question"), F.col("effective_date"), F.col("is_current"))
    return hits.withColumn("recency_boost", boost).withColumn("score", F.coalesce("rerank_score", "score") + F.col("recency_boost"))
