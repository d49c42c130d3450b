"""Inverted index and BM25 as tables.

The index is three tables: postings (chunk_id, term, tf, length), document frequencies
(term, df) and one row of corpus statistics. It is built once - one explode, one
shuffle: texts are dealt out by chunk, and all that follows per chunk stays in the same
task - and kept; questions only read it. Statistics are corpus-wide; filters only touch
the postings that are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def exploded_terms(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term), a row for each term of each text, stemmed."""
    tokens = rows.select(key, F.explode(T.surface_terms(T.tokenize(F.col(text)))).alias("token"))
    return T.stemmed(tokens, "token", "term").select(key, "term")


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf).

    Texts are dealt out by key once; counting tokens, stemming the different ones of a
    chunk and counting terms then need no further shuffle.
    """
    tokens = chunks.select(key, F.col(text).alias("__text")).repartition(key).select(key, F.explode(T.surface_terms(T.tokenize(F.col("__text")))).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return T.stemmed(counted, "token", "term").groupBy(key, "term").agg(F.sum("n").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` (key, term, tf, length), ``frequencies`` (term, df) and ``stats``, one row of n and avg_length.

    Ordinary tables: ``build`` makes them from texts, ``write`` keeps them, ``read`` opens
    what was kept. Statistics are those of the whole corpus.
    """

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> LexicalIndex:
    """The index of ``chunks``, not computed yet; write it, or each use will compute it."""
    return indexed(chunks.select(key), postings(chunks, key, text), key)


def indexed(keys: DataFrame, posted: DataFrame, key: str = "chunk_id") -> LexicalIndex:
    """The index of the chunks in ``keys`` from their postings (key, term, tf)."""
    wide = posted.select(key, "term", "tf").withColumn("length", F.sum("tf").over(Window.partitionBy(key)))
    found = posted.groupBy(key).agg(F.sum("tf").alias("length"))
    sized = keys.agg(F.count(F.lit(1)).alias("n")).crossJoin(found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")))  # one row each
    return LexicalIndex(wide, document_frequency(posted), sized.select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("avg_length")))


def write(lexicon: LexicalIndex, path: str, key: str = "chunk_id") -> LexicalIndex:
    """Writes the index under ``path`` and opens it. Postings lie sorted by term and key, so a very common term is spread over files."""
    n = int(lexicon.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lexicon.postings.repartitionByRange(n, "term", key).sortWithinPartitions("term", key).write.parquet(f"{path}/postings")
    kept = lexicon.postings.sparkSession.read.parquet(f"{path}/postings")
    # what follows is made from the kept postings, so texts are read once
    frequencies = document_frequency(kept)
    frequencies.write.parquet(f"{path}/frequencies")
    total = kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    counted = lexicon.stats.select("n").crossJoin(total)  # one row each
    counted.select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("avg_length")).coalesce(1).write.parquet(f"{path}/stats")
    return read(lexicon.postings.sparkSession, path)


def read(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{path}/{table}") for table in ("postings", "frequencies", "stats")])


def bm25(questions: DataFrame, lexicon: LexicalIndex, allowed: DataFrame | None = None, key: str = "chunk_id", scope: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, key, score) for all questions (query_id, text) at once; only scores above 0.

    A term that a question repeats counts again. ``allowed`` (key) limits what is scored,
    not the statistics; so does ``scope``, which is given the matches (query_id, key, ..)
    and returns those inside each question's scope. The few question terms, with their
    weights, meet the postings in an equi-join on the term; partial sums are combined
    before they are shuffled by question and chunk.
    """
    asked = exploded_terms(questions, "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = F.broadcast(lexicon.stats)  # one row
    weights = asked.join(lexicon.frequencies, "term").crossJoin(stats).select("query_id", "term", "avg_length", (F.col("times") * idf).alias("weight"))
    norm = F.col("tf") + R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("length") / F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(1.0))
    found = lexicon.postings.join(weights, "term")
    if allowed is not None:
        found = found.join(allowed.select(key), key, "left_semi")
    if scope is not None:
        found = scope(found)
    total = found.groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("tf") * (R.BM25_K1 + 1) / norm).alias("score"))
    return total.filter("score > 0")


def top_k(scores: DataFrame, k: int, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """The ``k`` best per query with ``rank`` from 1; ties go to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
