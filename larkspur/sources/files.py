"""Folders of documents as tables: scan, parse, and read or write index tables.

The scan hashes content in the JVM and carries no bytes further; parsing reads the bytes
of the documents that changed, in Arrow batches, and a file that fails is a row with an
error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ooxml import Parsed, parse_docx, parse_xlsx
from .pdf import parse_pdf

PARSERS: dict[str, Callable[[bytes, str], Parsed]] = {"pdf": parse_pdf, "docx": parse_docx, "xlsx": parse_xlsx}
BLOCKS = "array<struct<kind:string,text:string,level:int,page:int>>"
PARSED = f"doc_id string, title string, header_line string, blocks {BLOCKS}, naive_text string, page_count int, error string"


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, with forward slashes; the scheme may be spelled in any way."""
    tail = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root.replace("\\", "/")).rstrip("/")).replace("/", "/+")
    return F.regexp_replace(path, rf"^.*?{tail}/+", "")


def raw_files(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """Bytes of the documents below ``root``; editors' lock files are left out."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx,xlsx,PDF,DOCX,XLSX}").load(root)
    return files.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).withColumn("doc_id", relative_path(F.col("path"), root))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, content_hash, size)."""
    return raw_files(spark, root).select("doc_id", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


def parse(files: DataFrame) -> DataFrame:
    """Parsed documents from (doc_id, content); ``error`` says why one failed, cut to 200 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("page", pa.int32())])), pa.string(), pa.int32(), pa.string()]
        names = ["doc_id", "title", "header_line", "blocks", "naive_text", "page_count", "error"]
        for batch in batches:
            rows = []
            for doc_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = doc_id.rpartition("/")[2]
                stem, _, extension = name.rpartition(".")
                try:
                    if extension.lower() not in PARSERS:
                        raise ValueError(f"unsupported file type: {extension or name}")
                    p = PARSERS[extension.lower()](content, stem)
                    blocks = [dict(zip(("kind", "text", "level", "page"), b, strict=True)) for b in p.blocks]
                    rows.append((doc_id, p.title, p.header, blocks, p.plain, p.pages, None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((doc_id, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    return files.select("doc_id", "content").mapInArrow(run, PARSED)


def full_text(parsed: DataFrame) -> Column:
    """Block texts by line, or the plain text if there are no blocks."""
    return F.coalesce(F.nullif(F.array_join(F.transform(parsed["blocks"], lambda b: b["text"]), "\n"), F.lit("")), parsed["naive_text"])


def with_metadata(parsed: DataFrame) -> DataFrame:
    """Parsed documents with department, type, version, dates and hints as columns."""
    meta = T.metadata(F.col("doc_id"), F.col("title"), F.col("header_line"), F.col("full_text"))
    wide = parsed.withColumn("full_text", full_text(parsed)).withColumn("m", meta)
    fields = ["department", "doc_type", "version", "effective_date", "effective_until", "supersedes_file", "superseded_by_file", "supersedes_text"]
    return wide.select(*parsed.columns, *[F.col(f"m.{f}").alias(f) for f in fields], F.col("m.series.key").alias("series"), F.col("m.series.year").alias("year"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def write_table(table: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; a path that isn't there is an empty one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
