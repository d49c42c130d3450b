"""Query understanding as Column rules: condensation, decomposition, temporal intent.

A chat model may replace the rules through ``operators.hooks``; these are what runs
without one, and what a failed call falls back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def needs_condensation(question: Column, has_history: Column) -> Column:
    bare = T.stripped(question)
    return has_history & (bare.rlike(R.ELLIPTIC_OPENER) | bare.rlike(R.PRONOUN) | (F.size(T.words_of(bare)) <= 5))


def last_user_turn(turns: DataFrame, window: int = R.HISTORY_TURNS) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``previous``: the latest user text in the ``window`` turns before."""
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-window, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(frame))


def last_user_text(history: Column, window: int = R.HISTORY_TURNS) -> Column:
    """The same for a history ARRAY<STRUCT<role, content>>."""
    recent = F.slice(history, F.greatest(F.size(history) - window + 1, F.lit(1)), window)
    said = F.filter(recent, lambda t: t["role"] == "user")
    return F.get(F.transform(said, lambda t: t["content"]), F.size(said) - 1)


def condense(question: Column, previous: Column) -> Column:
    """A follow-up as a question of its own, from the previous user question (null or empty: as it is)."""
    topic = F.regexp_replace(T.stripped(T.found(question, R.WHAT_ABOUT)), "[?.!]+$", "")
    tokens = T.words_of(previous)
    bare = lambda t: F.regexp_replace(t, "^[.,?!'\"]+|[.,?!'\"]+$", "")
    proper = lambda t: bare(t).rlike(r"^\p{Lu}") & (F.lower(bare(t)) != "i")
    at = F.array_position(F.transform(tokens, lambda t, i: (i > 0) & proper(t)), True)
    swapped = F.array_join(F.transform(tokens, lambda t, i: F.when(i == at - 1, F.replace(t, bare(t), topic)).otherwise(t)), " ")
    trimmed = lambda c: F.regexp_replace(T.stripped(c), r"\?+$", "")
    scoped = F.concat(trimmed(question), F.lit(" (regarding: "), trimmed(previous), F.lit(")?"))
    about = F.when(at > 0, swapped).otherwise(F.concat(topic, F.lit(": "), previous))
    return F.when(F.coalesce(previous, F.lit("")) == "", question).when(topic.isNotNull(), about).otherwise(scoped)


def _two_sides(parts: Column) -> Column:
    return (F.size(parts) == 2) & F.forall(parts, lambda p: F.size(T.words_of(p)) >= 3)


def is_multi_hop(question: Column) -> Column:
    parts = F.split(question, R.AND_WORD)
    return question.rlike(R.COMPARATIVE) | (_two_sides(parts) & (F.size(T.words_of(question)) >= 9))


def decompose(question: Column) -> Column:
    """One to three search questions, as ARRAY<STRING>."""
    whole = F.regexp_replace(T.stripped(question), r"\?+$", "")
    part = lambda pattern, i: T.stripped(F.regexp_extract(whole, pattern, i))
    aspect = F.array(F.concat(part(R.COMPARE_ASPECT, 1), F.lit(" for "), part(R.COMPARE_ASPECT, 2)), F.concat(part(R.COMPARE_ASPECT, 1), F.lit(" for "), part(R.COMPARE_ASPECT, 3)))
    sides = F.array(part(R.DIFFERENCE_BETWEEN, 1), part(R.DIFFERENCE_BETWEEN, 2))
    left, right = part(R.VERSUS, 1), part(R.VERSUS, 2)
    lead = lambda text, pattern: F.coalesce(F.concat(T.found(text, pattern), F.lit(" ")), F.lit(""))
    versus = F.array(left, T.stripped(F.concat(lead(left, R.VERSUS_LEAD), right)))
    halves = F.filter(F.transform(F.split(whole, R.AND_WORD), T.stripped), lambda p: p != "")
    joined = F.array(F.get(halves, 0), T.stripped(F.concat(lead(F.get(halves, 0), R.AND_LEAD), F.get(halves, 1))))
    return (
        F.when(whole.rlike(R.COMPARE_ASPECT), aspect)
        .when(whole.rlike(R.DIFFERENCE_BETWEEN), sides)
        .when(whole.rlike(R.VERSUS) & (left != "") & (right != ""), versus)
        .when(_two_sides(halves), joined)
        .otherwise(F.array(whole))
    )


def subquestions(question: Column) -> Column:
    """Decomposition of questions that look multi-hop, at most the limit; others stay whole."""
    return F.when(is_multi_hop(question), F.slice(decompose(question), 1, R.MAX_SUBQUERIES)).otherwise(F.array(question))


def explicit_year(question: Column) -> Column:
    return T.found(question, R.YEAR_WORD, 0).cast("int")


def wants_history(question: Column) -> Column:
    return question.rlike(R.HISTORY_WORDS) | question.rlike(R.CHANGE_WORDS)
