"""Incremental ingest on tables: change detection, purge, upsert, patch, caches, statistics.

All functions are DataFrame to DataFrame. Nothing is overwritten in place; ``plans.sync``
writes each new state to a fresh version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def classify(manifest: DataFrame, scan: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, content_hash, old_hash, change) from two (doc_id, content_hash) tables.

    ``change`` is new, modified, unchanged or deleted; with ``force`` what is unchanged
    counts as modified. Hashes compare null-safe.
    """
    old, new = manifest.select("doc_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was")), scan.select("doc_id", "content_hash", F.lit(True).alias("now"))
    same = F.lit(not force) & F.col("old_hash").eqNullSafe(F.col("content_hash"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return old.join(new, "doc_id", "full").select("doc_id", "content_hash", "old_hash", change.alias("change"))


def deleted(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    return manifest.select("doc_id").join(scan.select("doc_id"), "doc_id", "left_anti")


def purge(table: DataFrame, victims: DataFrame, key: str = "doc_id") -> DataFrame:
    """``table`` without the rows whose key is in ``victims``."""
    return table.join(victims.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``fresh`` over ``table``; the last row of ``fresh`` per key (by ``version`` if there is one) wins."""
    if "version_seq" in fresh.columns:
        order = Window.partitionBy(key).orderBy(F.desc("version_seq"))
        fresh = fresh.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "version_seq")
    return purge(table, fresh, key).unionByName(fresh)


def patch(table: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """``table`` with the columns of ``fields`` replaced for the keys that it has; vectors live elsewhere and stay."""
    names = [c for c in fields.columns if c != key]
    marked = fields.select(key, F.struct(*names).alias("__patch"))
    joined = table.join(marked, key, "left")
    changed = {c: F.when(F.col("__patch").isNotNull(), F.col("__patch")[c]).otherwise(F.col(c)) for c in names}
    return joined.withColumns(changed).select(table.columns)


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and (doc_id, error) of those that didn't (errors cut to 200 characters)."""
    good = parsed.filter("error is null").drop("error")
    return good, parsed.filter("error is not null").select("doc_id", F.left("error", F.lit(200)).alias("error"))


def embedding_key(provider: str, width: int, text: Column) -> Column:
    return F.concat_ws("|", F.lit(provider), F.lit(str(width)), F.sha2(text, 256))


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, text) that the cache doesn't hold."""
    return texts.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def cache_usage(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(texts, distinct_texts, hits, misses) of a lookup."""
    marked = texts.select("key").join(cache.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    return marked.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("key").alias("distinct_texts"), F.count("hit").alias("hits"), F.countDistinct(F.when(F.col("hit").isNull(), F.col("key"))).alias("misses"))


def record_manifest(manifest: DataFrame, entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The manifest after recording ``entries`` and forgetting ``gone``."""
    return purge(upsert(manifest, entries, "doc_id"), gone)


def sync_report(changes: DataFrame) -> DataFrame:
    """(change, documents, first_id, last_id) per kind of change; the ids themselves stay rows of ``changes``."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents (exact) and table chunks."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("doc_id").alias("documents"),
        F.lit(True).alias("documents_exact"),
        F.count_if(F.col("content_type") == "table").alias("table_chunks"),
    )


def facets(table: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, exact) for several columns in one pass; counts are exact and uncapped."""
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return table.select(pairs).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("exact"))


def doc_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id").distinct().orderBy("doc_id")


def chunks_of(chunks: DataFrame, doc_id: object) -> DataFrame:
    return chunks.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("ordinal")


def point_lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def list_documents(manifest: DataFrame, chunks: DataFrame, allowed: Column) -> DataFrame:
    """Manifest rows inside the access scope, with their number of chunks (0 if there is none)."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return manifest.filter(allowed).join(counted, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).orderBy("doc_id")


def check_width(vectors: DataFrame, width: int, column: str = "vector") -> None:
    """Refuses vectors of another width than the embedder's."""
    other = vectors.filter(F.col(column).isNotNull() & (F.size(column) != width)).select(F.size(column).alias("n")).distinct().limit(5).collect()
    if other:
        raise ValueError(f"vectors of width {sorted(r.n for r in other)}, the embedder makes {width}")
