"""Vector and hybrid search over tables.

Scope predicates are Columns on the chunk table and apply before scoring. Dense scores
come from block products: vectors are gathered into blocks of rows, question blocks meet
them, and each pair of blocks is one matrix product whose output is already cut to what
the caller can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from . import lineage

BLOCK_ROWS = 2048
#: Slices of 256 questions whose best scores a task remembers from block to block (k numbers a question); others are cut block by block.
REMEMBERED = 64
#: Length of the heads of two fused lists, in multiples of the shortest that holds the result; longer ones leave fewer ranks to count.
HEADS = 10
#: Up to this length Spark cuts a head before it shuffles (spark.sql.optimizer.windowGroupLimitThreshold); longer heads only where k needs them.
CUT_EARLY = 1000


def scope(departments: list[str] | None = None, doc_ids: list | None = None, exclude_doc_ids: list | None = None, current_only: bool = False, content_types: list[str] | None = None) -> Column:
    """Predicate of a search filter. No department allows nothing, ``None`` any; excluding nothing excludes nothing."""
    out = F.lit(True)
    if departments is not None:
        out = out & (F.col("department").isin(departments) if departments else F.lit(False))
    if doc_ids is not None:
        out = out & (F.col("doc_id").isin(doc_ids) if doc_ids else F.lit(False))
    if exclude_doc_ids:
        out = out & ~F.col("doc_id").isin(exclude_doc_ids)
    if current_only:
        out = out & F.col("is_current")
    if content_types:
        out = out & F.col("content_type").isin(content_types)
    return out


def in_scope(departments: Column, department: Column) -> Column:
    """Whether a principal's departments cover one; ``*`` covers all."""
    return F.array_contains(departments, "*") | F.array_contains(departments, department)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, for single pairs; null if widths differ."""
    product = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def _blocks(vectors: DataFrame, key: str, rows: int) -> DataFrame:
    """(ids, matrix, ..): up to ``rows`` unit vectors a row, per task, and the other columns as lists; null and empty vectors are left out."""
    others = [f for f in vectors.schema.fields if f.name not in (key, "vector")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, values = part.column(0).to_pylist(), part.column(1).flatten().to_numpy(zero_copy_only=False)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for width in np.unique(sizes).tolist():
                    chosen = np.nonzero(sizes == width)[0].tolist()
                    x = (values if len(chosen) == len(ids) else values[starts[chosen][:, None] + np.arange(width)]).reshape(-1, width)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = x / np.where(norm > 0, norm, 1.0)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), c.take(pa.array(chosen))) for c in part.columns[2:]]
                    yield pa.record_batch([pa.array([[ids[i] for i in chosen]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), *lists], names=["ids", "matrix", *part.schema.names[2:]])

    clean = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col(key).cast("long"), F.col("vector").cast("array<double>"), *[f.name for f in others])
    return clean.mapInArrow(pack, ", ".join(["ids array<bigint>", "matrix binary", *[f"{f.name} array<{f.dataType.simpleString()}>" for f in others]]))


def _products(questions: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Each block of questions beside each block of vectors: a stated question set against all rows."""
    asked = _blocks(questions, "query_id", BLOCK_ROWS).withColumnsRenamed({"ids": "q_ids", "matrix": "q"})
    return asked.crossJoin(_blocks(vectors, key, BLOCK_ROWS))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int, np.ndarray, np.ndarray]]:
    """(row of blocks, first question, scores, whether in scope) for up to 256 questions at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right = np.frombuffer(row["q"]).reshape(len(row["q_ids"]), -1), np.frombuffer(row["matrix"]).reshape(len(row["ids"]), -1)
            if left.shape[1] != right.shape[1]:
                continue
            scoped = "departments" in row and "department" in row
            names, tag = np.unique([d or "" for d in row["department"]], return_inverse=True) if scoped else (None, None)
            for at in range(0, len(left), 256):
                found = left[at : at + 256] @ right.T
                seen = np.ones(found.shape, bool)
                if scoped:
                    seen = np.array([[own is None or "*" in own or name in own for name in names] for own in row["departments"][at : at + 256]])[:, tag]
                yield row, at, found, seen


def cosine(questions: DataFrame, vectors: DataFrame, k: int | None = None, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): the ``k`` nearest vectors of each question and ties, or all of them (a report on small tables).

    ``questions``: (query_id, vector), ``vectors``: (key, vector), ids whole numbers.
    Both sides are normalised; a zero vector scores 0; other widths don't match. Where
    questions have ``departments`` (null or ``*``: any) and vectors a ``department``, only
    vectors in scope are looked at.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}  # the k best scores so far of some questions: what is below them is not among the k nearest
        for row, at, found, seen in _scored(batches):
            found = np.where(seen, found, -np.inf)
            # ties must not depend on the block: equal scores beyond the k-th stay in
            least, asked = np.full(len(found), -np.inf), (row["q_ids"][0], at)
            if k is not None:
                known = np.concatenate([best[asked], found], axis=1) if asked in best else found
                if k < known.shape[1]:
                    known = np.partition(known, -k, axis=1)[:, -k:]
                    least = known[:, 0]
                if asked in best or len(best) < REMEMBERED:
                    best[asked] = known
            i, j = np.nonzero(seen & (found >= least[:, None] - 1e-9))
            yield pa.record_batch([pa.array(np.array(row["q_ids"][at : at + 256])[i], pa.int64()), pa.array(np.array(row["ids"])[j], pa.int64()), pa.array(found[i, j], pa.float64())], names=["query_id", key, "score"])

    return _products(questions, vectors, key).mapInArrow(score, f"query_id long, {key} long, score double")


def ranked(scores: DataFrame, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """Scores with their rank per question; ties (to ``digits`` places) go to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), key)
    return scores.withColumn("rank", F.row_number().over(order))


def fuse(*lists: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rrf): reciprocal ranks (query_id, key, rank) summed over the lists."""
    every = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", key, "rank"))
    return every.groupBy("query_id", key).agg(F.sum(1.0 / (R.RRF_K + F.col("rank"))).alias("rrf"))


def _in_order(scores: DataFrame, key: str) -> DataFrame:
    """(query_id, less, keys): each question's few rows in the order of ranks, as two arrays; ``less`` is the negated score."""
    rows = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("less"), F.col(key).alias("k"))))
    return scores.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.col("rows.less").alias("less"), F.col("rows.k").alias("keys"))


def _ranks(order: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(query_id, key, rank) of the rows in ``order``; ``counts`` (query_id, place, n): rows of the whole list that have ``place`` of them before."""
    placed = order.select("query_id", F.posexplode("keys").alias("place", key)).join(counts.groupBy("query_id", "place").agg(F.sum("n").alias("n")), ["query_id", "place"], "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("query_id").orderBy("place"))
    return placed.select("query_id", key, upto.alias("rank"))


def _ranks_in_table(far: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(query_id, key, rank) of a few rows of a table of scores, by counting those not behind them; only counts are shuffled."""
    rounded = lambda name: (-F.round("score", 9)).alias(name)
    own = far.select(F.col("query_id").alias("__q"), F.col(key).alias("__key"), rounded("__own"))
    upto = (F.col("query_id") == F.col("__q")) & ((F.col("__less") < F.col("__own")) | ((F.col("__less") == F.col("__own")) & (F.col(key) <= F.col("__key"))))
    counted = scores.select("query_id", key, rounded("__less")).join(own, upto).groupBy("query_id", "__key").agg(F.count(F.lit(1)).alias("rank"))
    return counted.withColumnRenamed("__key", key)


def _ranks_among_vectors(order: DataFrame, questions: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Ranks by counting the better vectors inside the products; counts leave them, not scores."""

    def flushed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = [(q, place, int(n)) for q, counts in sums.items() for place, n in enumerate(counts) if n]
        return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["query_id", "place", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row, at, found, seen in _scored(batches):
            ids, less = np.array(row["ids"]), -(np.floor(np.abs(found) * 1e9 + 0.5) / 1e9 * np.sign(found))
            for i, q in enumerate(row["q_ids"][at : at + 256]):
                own, names, mine = np.array(row["less"][at + i]), np.array(row["keys"][at + i]), seen[i]
                values, them = less[i][mine], ids[mine]
                place, end = np.searchsorted(own, values, "left"), np.searchsorted(own, values, "right")
                for t in np.nonzero(end > place)[0]:  # equal scores: by key
                    place[t] += np.searchsorted(names[place[t] : end[t]], them[t], "left")
                counted = np.bincount(place, minlength=len(own) + 1)[: len(own)]
                sums[q] = sums[q] + counted if q in sums else counted
            if len(sums) > 2 * BLOCK_ROWS:
                yield flushed(sums)
                sums = {}
        if sums:
            yield flushed(sums)

    asked = questions.join(order, "query_id")
    return _ranks(order, _products(asked, vectors, key).mapInArrow(count, "query_id long, place int, n long"), key)


def _cosine_of(pairs: DataFrame, questions: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of stated pairs inside their question's scope."""
    asked = pairs.join(questions.withColumnRenamed("vector", "asked"), "query_id").join(vectors, key)
    if {"departments", "department"} <= set(asked.columns):
        asked = asked.filter(F.col("departments").isNull() | in_scope(F.col("departments"), F.coalesce("department", F.lit(""))))
    size = F.sqrt(dot(F.col("asked"), F.col("asked")) * dot(F.col("vector"), F.col("vector")))
    found = F.when(size > 0, dot(F.col("asked"), F.col("vector")) / size).when(F.size("asked") == F.size("vector"), F.lit(0.0))
    return asked.filter((F.size("asked") > 0) & (F.size("vector") > 0)).select("query_id", key, found.alias("score")).filter("score is not null")


def hybrid(lexical: DataFrame, questions: DataFrame, vectors: DataFrame, k: int = R.RETRIEVE_TOP_K, key: str = "chunk_id", keep: lineage.Keep = lambda df: df) -> DataFrame:
    """(query_id, key, rrf, keyword_score, vector_score, rank): the ``k`` best of the lexical and the cosine list, fused by reciprocal ranks.

    Scores of a list that lacks the key are null. Neither list is sorted whole. The k-th of
    either list has 1 / (RRF_K + k) alone. What is beyond both heads cannot reach that; nor
    can what has a place beyond ``least`` in one list and is beyond the other's head. For
    the few places up to ``least``, the rank in the other list is counted. A list shorter
    than its head is all there. ``keep`` (see ``lineage``) computes heads and counted ranks once.
    """
    shortest = R.RRF_K + 2 * k
    n = max(shortest, min(HEADS * shortest, CUT_EARLY))
    least = int(1 / (1 / (R.RRF_K + k) - 1 / (R.RRF_K + n + 1) - 1e-9)) - R.RRF_K + 1
    word, near = [keep(ranked(scores, key).filter(F.col("rank") <= n)) for scores in (lexical, cosine(questions, vectors, n, key))]
    pair = ["query_id", key]
    far_word = keep(lexical.join(near.filter(F.col("rank") <= least).join(word, pair, "left_anti").select(pair), pair, "left_semi"))
    far_near = keep(_cosine_of(word.filter(F.col("rank") <= least).join(near, pair, "left_anti").select(pair), questions, vectors, key))
    word_ranks, near_ranks = _ranks_in_table(far_word, lexical, key), _ranks_among_vectors(_in_order(far_near, key), questions, vectors, key)
    left = word.select(*pair, "score", "rank").unionByName(far_word.select(*pair, "score").join(word_ranks, pair))
    right = near.select(*pair, "score", "rank").unionByName(far_near.join(near_ranks, pair))
    left, right = [side.select(*pair, F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank")) for name, side in (("keyword", left), ("vector", right))]
    share = lambda c: F.coalesce(1.0 / (R.RRF_K + F.col(c)), F.lit(0.0))
    both = left.join(right, pair, "full").withColumn("rrf", share("keyword_rank") + share("vector_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), key)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", key, "rrf", "keyword_score", "vector_score", "rank")
