"""Folder to index, incrementally.

State is a set of Parquet tables under ``store``/v<n>; a run reads version n, writes
version n+1 whole, and then names it in the ``current`` table, so readers never see a half
state and a failed run leaves the old one. Only changed documents are parsed, embedded and
tokenised; currency is patched, vectors and postings of the others are copied as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chunking, embed, index, ingest, versions
from ..sources import files
from .settings import Settings

MANIFEST = "doc_id string, content_hash string, size long, title string, department string, doc_type string, version string, effective_date string, effective_until string, supersedes_file string, superseded_by_file string, supersedes_text string, series string, year int, is_current boolean, superseded_by string, supersedes_doc_id string"
CHUNKS = "doc_id string, ordinal int, chunk_id string, cid long, section_path string, content_type string, page int, text string, embed_text string, token_estimate int, title string, department string, doc_type string, version string, effective_date string, is_current boolean"
POSTINGS = "cid long, doc_id string, term string, tf long"
VECTORS = "cid long, doc_id string, vector array<double>"
META = ["title", "department", "doc_type", "version", "effective_date", "effective_until", "supersedes_file", "superseded_by_file", "supersedes_text", "series", "year"]


class Store:
    """Versions of the index tables under a path, per profile."""

    def __init__(self, spark: SparkSession, path: str, profile: str = "improved"):
        self.spark, self.path = spark, f"{path}/{profile}"

    def _pointer(self) -> DataFrame:
        return files.read_table(self.spark, f"{self.path}/current", "seq long, name string")

    def current(self) -> tuple[int, str | None]:
        row = self._pointer().agg(F.max(F.struct("seq", "name")).alias("m")).first()
        return (row.m.seq, row.m.name) if row and row.m else (0, None)

    def read(self, table: str, schema: str) -> DataFrame:
        _, name = self.current()
        return files.read_table(self.spark, f"{self.path}/{name}/{table}", schema) if name else self.spark.createDataFrame([], schema)

    def lexicon(self) -> index.LexicalIndex:
        """The kept lexical index of the current version (key cid)."""
        return index.read(self.spark, f"{self.path}/{self.current()[1]}/lexicon")

    def publish(self, seq: int, name: str) -> None:
        self.spark.createDataFrame([(seq, name)], "seq long, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/current")


def document_chunks(parsed: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of parsed documents with their metadata, as the profile has it."""
    meta = parsed.select("doc_id", *[c for c in META if c in ("title", "department", "doc_type", "version", "effective_date")])
    if settings.baseline:
        plain = chunking.fixed_windows(parsed.select("doc_id", F.col("naive_text").alias("text")), settings.window_chars)
        wide = plain.join(meta, "doc_id").withColumn("content_type", F.lit("text")).withColumn("page", F.lit(None).cast("int")).withColumn("embed_text", F.col("text"))
        return wide.withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")))
    rows = parsed.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.text", "b.page")
    return chunking.enrich(chunking.section_chunks(rows), meta)


def sync(spark: SparkSession, source: str, store: Store, settings: Settings | None = None, force: bool = False) -> DataFrame:
    """Brings the store in step with the folder; returns the report, a row (change, doc_id) for each document.

    The words of changed documents are counted once and kept with those of the others.

    A changed document that doesn't parse keeps its old chunks, manifest row and part in
    version reconciliation, and is reported as failed.
    """
    s = settings or Settings()
    seq, _ = store.current()
    name = f"v{seq + 1}-{uuid.uuid4().hex[:8]}"
    out = lambda table: f"{store.path}/{name}/{table}"
    manifest, chunks, vectors = store.read("manifest", MANIFEST), store.read("chunks", CHUNKS), store.read("vectors", VECTORS)
    scanned = files.scan(spark, source)
    files.write_table(ingest.classify(manifest, scanned, force).join(scanned.select("doc_id", "size"), "doc_id", "left"), out("changes"))
    changes = spark.read.parquet(out("changes"))
    touched = changes.filter(F.col("change").isin("new", "modified"))
    parsed = files.parse(files.raw_files(spark, source).join(touched.select("doc_id"), "doc_id", "left_semi"))
    good, _ = ingest.split_failures(parsed)
    files.write_table(files.with_metadata(good).withColumn("error", F.lit(None).cast("string")).unionByName(parsed.filter("error is not null"), allowMissingColumns=True), out("parsed"))
    stored = spark.read.parquet(out("parsed"))
    fresh, failed = ingest.split_failures(stored)

    gone = changes.filter("change = 'deleted'").select("doc_id")
    known = changes.select("doc_id", "content_hash", "size")
    entries = fresh.select("doc_id", *META).join(known, "doc_id").withColumns({"is_current": F.lit(True), "superseded_by": F.lit(None).cast("string"), "supersedes_doc_id": F.lit(None).cast("string")})
    recorded = ingest.record_manifest(manifest, entries.select(manifest.columns), gone)
    verdicts = versions.reconcile(recorded)
    files.write_table(ingest.patch(recorded, verdicts), out("manifest"))
    final = spark.read.schema(MANIFEST).parquet(out("manifest"))

    victims = gone.unionByName(fresh.select("doc_id"))
    made = document_chunks(fresh, s).withColumn("cid", F.xxhash64("chunk_id")).withColumn("is_current", F.lit(True))
    kept = ingest.purge(chunks, victims)
    files.write_table(ingest.patch(kept.unionByName(made.select(chunks.columns)), final.select("doc_id", "is_current")), out("chunks"))
    written = spark.read.schema(CHUNKS).parquet(out("chunks"))
    texts = written.join(fresh.select("doc_id"), "doc_id", "left_semi").select("cid", "doc_id", "embed_text")
    embedded = embed.embed_texts(texts.withColumnRenamed("embed_text", "text"), "cid", width=s.embed_width).join(texts.select("cid", "doc_id"), "cid")
    if not written.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two chunks have the same 64-bit id")
    counted = index.postings(texts, "cid", "embed_text").join(texts.select("cid", "doc_id"), "cid")
    files.write_table(ingest.purge(store.read("postings", POSTINGS), victims).unionByName(counted.select("cid", "doc_id", "term", F.col("tf").cast("long").alias("tf"))), out("postings"))
    index.write(index.indexed(written.select("cid"), spark.read.schema(POSTINGS).parquet(out("postings")), "cid"), f"{store.path}/{name}/lexicon", "cid")
    old = ingest.purge(vectors, victims)
    ingest.check_width(old, s.embed_width)
    files.write_table(old.unionByName(embedded.select(vectors.columns)), out("vectors"))
    delta = versions.currency_delta(manifest.select("doc_id", "is_current", "superseded_by"), final).select("doc_id", "change")
    shown = changes.join(failed.select("doc_id"), "doc_id", "left_anti").select("doc_id", "change").unionByName(failed.select("doc_id", F.lit("failed").alias("change"))).unionByName(delta)
    files.write_table(shown, out("report"))
    store.publish(seq + 1, name)
    return spark.read.parquet(out("report"))


def plain_text_documents(docs: DataFrame) -> DataFrame:
    """Blocks of a table of plain texts (doc_id, text), for corpora that are tables already."""
    return B.text_blocks(docs)
