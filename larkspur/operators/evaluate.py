"""Evaluation: scoring cases, aggregate report, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def document_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): documents in the order in which a hit first names them (``place``)."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id")).alias("rank"))


def retrieval_metrics(ranks: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit_at_1, hit_at_k, doc_recall, mrr) of questions with expected documents (query_id, doc_id)."""
    wanted = expected.select("query_id", "doc_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    good = ranks.join(wanted, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"), F.count_if(F.col("rank") <= k).alias("inside"))
    out = total.join(good, "query_id", "left")
    near = lambda n: F.coalesce(F.col("best") <= n, F.lit(False))
    return out.select("query_id", near(1).alias("hit_at_1"), near(k).alias("hit_at_k"), (F.coalesce("inside", F.lit(0)) / F.col("expected")).alias("doc_recall"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"))


def section_hit(expected: Column, retrieved: Column) -> Column:
    """Whether every expected section is among the retrieved ones; null without expectations."""
    return F.when(F.size(expected) > 0, F.forall(expected, lambda e: T.section_matches(e, retrieved)))


def missing_facts(answer: Column, facts: Column) -> Column:
    return F.filter(facts, lambda f: ~T.states_fact(answer, f))


def present_facts(answer: Column, facts: Column) -> Column:
    return F.filter(facts, lambda f: T.states_fact(answer, f))


def status_verdicts(results: DataFrame) -> DataFrame:
    """``results`` with declined, status_correct, correct, hallucinated, citation_precision and citation_correct.

    Needs status, expected_status, answer, missing, forbidden, cited_docs,
    forbidden_docs_cited (arrays) and expected_docs. Also rescoring: facts are taken as stored.
    """
    prose = T.declines(F.col("answer"))
    declined = F.col("status").isin(*R.NON_ANSWERS) | prose
    refusal = F.col("expected_status").isin(*R.NON_ANSWERS)
    same = F.col("status") == F.col("expected_status")
    verdict = F.when(refusal, declined).when(F.col("expected_status") == "needs_clarification", same).otherwise(same & ~declined)
    clean = F.size("forbidden") == 0
    answered = (F.col("status") == "answered") & ~prose & (F.size("missing") == 0) & clean & (F.size("forbidden_docs_cited") == 0)
    overlap = F.size(F.array_intersect("cited_docs", "expected_docs"))
    counts = (F.col("expected_status") == "answered") & (F.size("expected_docs") > 0)
    cites = F.size("cited_docs") > 0
    return (
        results.withColumn("declined", declined)
        .withColumn("status_correct", verdict)
        .withColumn("correct", F.when(F.col("expected_status") == "answered", answered).otherwise(verdict & clean))
        .withColumn("hallucinated", (refusal & ~declined) | ~clean)
        .withColumn("citation_precision", F.when(counts, F.when(cites, overlap / F.size(F.array_distinct("cited_docs"))).otherwise(0.0)))
        .withColumn("citation_correct", F.when(counts, cites & (overlap > 0)))
    )


def cost(prompt: Column, completion: Column) -> Column:
    return F.round(prompt / 1000 * R.PROMPT_PRICE + completion / 1000 * R.COMPLETION_PRICE, 6)


def rate(value: Column, where: Column | None = None) -> Column:
    """Mean of what isn't null (booleans as 0 and 1), to four places; null without any."""
    number = value.cast("double")
    return F.round(F.avg(number if where is None else F.when(where, number)), 4)


def percentile_95(value: Column) -> Column:
    """The element at 95 % of the sorted values, without interpolation (halves round to even)."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.bround(0.95 * (F.size(ordered) - 1)).cast("int"))


def exact_p95(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, p95) for groups of any size: by counting, without gathering a group's values.

    Values are counted first, so equal ones are one row; a running count over distinct
    values finds the element.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(value))
    placed = counts.withColumn("upto", upto).join(total, group) if group else counts.withColumn("upto", upto).crossJoin(total)
    return placed.filter(F.col("upto") > F.bround(0.95 * (F.col("total") - 1))).groupBy(*group).agg(F.min(value).alias("p95"))


def report(results: DataFrame, by: list[str]) -> DataFrame:
    """Rates of answered, refused and retrieval cases in one pass; ``by`` through rollup, so the overall row comes along."""
    answerable = F.col("expected_status") == "answered"
    return results.rollup(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        rate(F.col("correct")).alias("answer_correctness"),
        rate(F.col("correct"), answerable).alias("answer_correctness_answerable"),
        rate(F.col("status_correct")).alias("status_accuracy"),
        rate(F.col("status_correct"), ~answerable).alias("abstention_accuracy"),
        rate(F.col("hallucinated")).alias("hallucination_rate"),
        rate(F.col("hit_at_1")).alias("hit_at_1"),
        rate(F.col("hit_at_k")).alias("hit_at_5"),
        rate(F.col("doc_recall")).alias("doc_recall"),
        rate(F.col("mrr")).alias("mrr"),
    )


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """(id, outcome) of cases in both runs (id, correct): fixed, regressed or same."""
    joined = base.select("id", F.col("correct").alias("before")).join(other.select("id", F.col("correct").alias("after")), "id")
    return joined.select("id", F.when(~F.col("before") & F.col("after"), "fixed").when(F.col("before") & ~F.col("after"), "regressed").otherwise("same").alias("outcome"))


def metric_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """(metric, base, other, diff, better) from two (metric, value) tables; null values give a null verdict."""
    joined = base.select("metric", F.col("value").alias("base")).join(other.select("metric", F.col("value").alias("other")), "metric")
    diff = F.col("other") - F.col("base")
    lower = F.col("metric").isin(*R.LOWER_IS_BETTER)
    better = F.when(diff.isNull(), None).when(F.abs(diff) < 1e-9, "equal").when(F.when(lower, diff < 0).otherwise(diff > 0), "better").otherwise("worse")
    return joined.select("metric", "base", "other", diff.alias("diff"), better.alias("better"))


def latency_repeats(runs: DataFrame) -> DataFrame:
    """(id, latency_ms): mean over repeats, halves away from zero.

    Summed as decimals of 12 places, so that a mean on a half does not depend on the order of
    rows; groups with values that such decimals do not hold (1e14 or more, NaN) are summed as doubles.
    """
    value = F.col("latency_ms").cast("double")
    fixed = value.try_cast("decimal(26,12)")
    sums = runs.groupBy("id").agg(F.sum(fixed).alias("total"), F.avg(value).alias("plain"), F.count(fixed).alias("held"), F.count(value).alias("n"))
    exact = F.round(F.col("total") / F.nullif("n", F.lit(0)), 1).cast("double")
    return sums.select("id", F.when(F.col("held") == F.col("n"), exact).otherwise(F.round("plain", 1)).alias("latency_ms"))


def latency_repeats_in_order(runs: DataFrame) -> DataFrame:
    """(id, latency_ms): the same mean in double arithmetic, as a SQL engine forms it: a mean on a half may fall to either side.

    ``runs``: (id, latency_ms, file, block). The rows of a block are added in turn, then the
    blocks' sums in the order of files and blocks, so reruns agree; the mean is scaled,
    rounded (halves away from zero) and scaled back.
    """
    value = F.col("latency_ms").cast("double")
    parts = runs.groupBy("id", "file", "block").agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "block", "sum"))).alias("parts"), F.sum("n").alias("n"))
    total = F.aggregate(F.filter("parts", lambda p: p["sum"].isNotNull()), F.lit(0.0), lambda s, p: s + p["sum"])
    scaled = whole.select("id", (total / F.nullif("n", F.lit(0))).alias("mean")).withColumn("tenths", F.round(F.col("mean") * 10.0))
    return scaled.select("id", F.when(F.abs("tenths") == float("inf"), F.col("mean")).otherwise(F.col("tenths") / 10.0).alias("latency_ms"))


def principal_scope(department: Column) -> Column:
    """Departments of an evaluation case: ``all`` or nothing is unrestricted."""
    free = F.coalesce(F.lower(department), F.lit("")).isin("", "all")
    return F.when(free, F.array(F.lit("*"))).otherwise(F.array(department))
