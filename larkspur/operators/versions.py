"""Version reconciliation: which document replaces which, over the whole corpus.

Explicit hints in either direction come first, then the order of years in a series of
file names. Where hints compete for one older document, a forward hint ("this replaces
X") wins over a backward one, then the smallest newer id; the newer document keeps the
greatest older id. Each edge is one hop. Two documents that claim to replace each other
both lose currency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _file_name(doc_id: Column) -> Column:
    return F.lower(F.element_at(F.split(doc_id, "/"), -1))


def _resolve(hints: DataFrame, column: str, docs: DataFrame) -> DataFrame:
    """(doc_id, target): documents that a file name means, the same department first, then the smallest id."""
    wanted = hints.filter(F.col(column).isNotNull()).select("doc_id", "department", F.lower(column).alias("file"))
    names = docs.select(F.col("doc_id").alias("target"), F.col("department").alias("target_department"), _file_name(F.col("doc_id")).alias("file"))
    best = F.min(F.struct((F.col("department") != F.col("target_department")).alias("other"), F.col("target")))
    return wanted.join(names, "file").groupBy("doc_id").agg(best["target"].alias("target")).filter("target <> doc_id")


def supersession_edges(docs: DataFrame) -> DataFrame:
    """(older, newer) from (doc_id, department, supersedes_file, superseded_by_file, series, year)."""
    forward = _resolve(docs, "supersedes_file", docs).select(F.col("target").alias("older"), F.col("doc_id").alias("newer"), F.lit(0).alias("kind"))
    backward = _resolve(docs, "superseded_by_file", docs).select(F.col("doc_id").alias("older"), F.col("target").alias("newer"), F.lit(1).alias("kind"))
    line = Window.partitionBy("series").orderBy("year", "doc_id")
    dated = docs.filter("series is not null and year is not null and year <> 0")
    by_year = dated.select(F.col("doc_id").alias("older"), F.lead("doc_id").over(line).alias("newer"), F.lit(2).alias("kind")).filter("newer is not null")
    every = forward.unionByName(backward).unionByName(by_year)
    return every.groupBy("older").agg(F.min(F.struct("kind", "newer"))["newer"].alias("newer"))


def reconcile(docs: DataFrame) -> DataFrame:
    """(doc_id, is_current, superseded_by, supersedes_doc_id) of every document."""
    edges = supersession_edges(docs)
    back = edges.groupBy("newer").agg(F.max("older").alias("supersedes_doc_id"))
    old = edges.select(F.col("older").alias("doc_id"), F.col("newer").alias("superseded_by"))
    joined = docs.select("doc_id").join(old, "doc_id", "left").join(back.withColumnRenamed("newer", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", F.col("superseded_by").isNull().alias("is_current"), "superseded_by", "supersedes_doc_id")


def currency_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, is_current, superseded_by, change) of documents whose currency changed: reinstated, superseded or redirected."""
    old = before.select("doc_id", F.col("is_current").alias("was_current"), F.col("superseded_by").alias("was_by"), F.lit(True).alias("known"))
    joined = after.select("doc_id", "is_current", "superseded_by").join(old, "doc_id", "left")
    moved = joined.filter(F.col("known").isNull() | ~(F.col("is_current").eqNullSafe(F.col("was_current")) & F.col("superseded_by").eqNullSafe(F.col("was_by"))))
    was = F.coalesce("was_current", F.lit(True))
    change = F.when(F.col("is_current") & ~was, "reinstated").when(~F.col("is_current") & was, "superseded").otherwise("redirected")
    return moved.filter(F.col("known").isNotNull() | ~F.col("is_current")).select("doc_id", "is_current", "superseded_by", change.alias("change"))
