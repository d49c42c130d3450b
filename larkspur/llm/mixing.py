"""Mixing sources to target weights with hash-threshold histograms.

Each document has a hash. A source takes the documents below a hash threshold, so
choices are nested, repeatable and need no sort: word counts are summed by source
and hash bucket (4096 rows a source, combined map-side), the bucket in which the
running sum passes the budget is found, and only that bucket is split further by
the next 12 bits, to 48 bits. A last filter compares hashes with thresholds.

A target between one and two times its source's size takes every document once and
a threshold's worth of them twice. The driver gets one row per source and level:
the number of sources is taken to be small (names of collections, not of documents).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut

LEVEL_BITS, LEVELS = 12, 4
KEY_BITS = LEVEL_BITS * LEVELS
#: Tables with a row per source are broadcast up to this many rows (under 1 MB).
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class MixPlan:
    """How to take from one source: everything ``whole`` times, hashes below ``threshold`` once more."""

    source: str | None
    source_size: int
    target: float
    whole: int
    threshold: int


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(docs: DataFrame) -> Column:
    """48 hash bits of a document; repeated rows share them."""
    return F.shiftrightunsigned(F.xxhash64(docs["doc_id"], docs["text"]), 64 - KEY_BITS)


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """A target per source (in order): ``share`` of all sizes by repeating weight, none above ``cap`` sizes."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, budget, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = budget / sum(weight[i] for i in free)
        full = {i for i in free if weight[i] * unit > cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = weight[i] * unit
            break
        for i in full:
            out[i] = cap * sizes[i]
            budget -= out[i]
        free -= full
    return out


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if it has few rows; beyond that Spark joins it as it sees fit."""
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def _thresholds(spark: SparkSession, keyed: DataFrame, budgets: dict[int, float]) -> dict[int, int]:
    """Per source number the 48-bit threshold below which words sum to about its budget."""
    prefix, left, found = dict.fromkeys(budgets, 0), dict(budgets), {}
    for level in range(LEVELS):
        if not left:
            break
        shift = KEY_BITS - LEVEL_BITS * (level + 1)
        edge = spark.createDataFrame([(k, prefix[k], float(left[k])) for k in left], "number int, prefix long, budget double")
        bucket = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
        inside = keyed.join(_small(edge, len(left)), "number").filter(F.shiftrightunsigned("key", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("number", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("number").orderBy("bucket")))
        cross = running.filter("upto > budget").groupBy("number").agg(F.min(F.struct("bucket", "upto", "words")).alias("at"))
        rows = {r.number: r["at"] for r in cross.collect()}
        for k in list(left):
            if k not in rows:  # the budget covers all that is here
                found[k] = (prefix[k] + 1) << (shift + LEVEL_BITS)
                del left[k]
                continue
            at = rows[k]
            left[k] -= at["upto"] - at["words"]
            prefix[k] = (prefix[k] << LEVEL_BITS) | at["bucket"]
            if level == LEVELS - 1:  # the boundary bucket goes to the nearer side
                found[k] = prefix[k] + (2 * left[k] >= at["words"])
    return found


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[list[MixPlan], DataFrame]:
    """A plan per source, and (doc_id, source, key, size) of every row, cut from its lineage."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), hash_key(docs).alias("key"), words(docs["text"]).alias("size")))
    totals = {r.source: r.total for r in sized.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    aims = targets([totals[s] for s in names], weights, share, cap)
    whole = [min(int(cap), int(t // totals[s])) if totals[s] else 0 for s, t in zip(names, aims, strict=True)]
    budgets = {k: aims[k] - whole[k] * totals[s] for k, s in enumerate(names) if whole[k] < cap and totals[s]}
    if names:
        numbers = spark.createDataFrame(list(enumerate(names)), "number int, name string")
        keyed = sized.join(_small(numbers, len(names)), F.col("source").eqNullSafe(F.col("name"))).select("number", "key", "size").filter("size > 0")
        edges = _thresholds(spark, keyed, {k: b for k, b in budgets.items() if b > 0})
    else:
        edges = {}
    return [MixPlan(s, totals[s], aims[k], whole[k], edges.get(k, 0)) for k, s in enumerate(names)], sized


def _with_plan(rows: DataFrame, plans: list[MixPlan], key: Column) -> tuple[DataFrame, Column, Column, Column]:
    """``rows`` with their source's plan; its size and target, and the copies that it takes of a row."""
    schema = "mix_source string, source_size long, target double, whole int, threshold long"
    table = rows.sparkSession.createDataFrame([(p.source, p.source_size, p.target, p.whole, p.threshold) for p in plans], schema)
    joined = rows.join(_small(table, len(plans)), rows["source"].cast("string").eqNullSafe(table["mix_source"]))
    return joined, table["source_size"], table["target"], table["whole"] + (key < table["threshold"]).cast("int")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs`` (doc_id, text, source, ...).

    Null and empty texts have size 0 and take 0 words. Null sources form one source,
    last in order. Repeated rows share a hash and are taken or left together. An empty
    table gives an empty result; further columns are ignored.
    """
    plans, sized = plan_mix(docs.select("doc_id", "text", "source"), **options)
    joined, source_size, target, copies = _with_plan(sized, plans, sized["key"])
    return joined.select("doc_id", "size", source_size, target, (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of ``docs`` as many times as its source's plan takes it."""
    plans, _ = plan_mix(docs.select("doc_id", "text", "source"), **options)
    joined, _, _, copies = _with_plan(docs, plans, hash_key(docs))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).drop("__copy")
