"""Token counts of documents in flat token files, by separator scan.

A token file is a bare stream of little-endian 16-bit ids; an end-of-document id
closes each document, and there is no index. Files are read in blocks; inside a block
all separators are found at once by an array comparison. Blocks are then stitched: a
prefix scan over a file's blocks gives each block the number of documents closed
before it and the place of the last separator, so a document that crosses any number
of blocks is counted once and whole.

Files are written and read through Spark's own sources, so any file system that Spark
knows will do. The binary source hands a file over whole, so a task begins a new volume
after ``VOLUME`` bytes: a file holds that much and at most one document more, however
much its task writes. Foreign files must stay below 2 GB each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import read_tokenizer, tokenizer
from .common import shared_dir

#: Tokens in a block: 128 KB.
BLOCK = 1 << 16
#: Bytes of tokens after which a task begins a new file.
VOLUME = 1 << 26
ID_BYTES = 9
#: Documents that are encoded together.
SLICE = 512


def _mark(eod: int) -> str:
    """The separator's two bytes, as the line end of Spark's text sink in Latin-1."""
    return eod.to_bytes(2, "little").decode("latin-1")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, eod: int, volume: int = VOLUME) -> None:
    """Token files under ``path``/kind=tokens, and the documents' ids in the same order under kind=ids.

    Each task writes a file of either kind per volume, both in order of doc_id, without a
    shuffle. Strings of special tokens count as ordinary text, so ``eod`` only ends
    documents. Ids are 16-bit; a larger vocabulary is refused.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, written = tokenizer(file.value, specials=False), 0
        if max(own.names) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        for batch in batches:
            tokens = [np.frombuffer(ids, "<u4").astype("<u2").tobytes() for ids in own.encode_texts(batch.column(1).to_pylist())]
            names = [bytes(ID_BYTES) if i is None else b"\x01" + i.to_bytes(8, "big", signed=True) for i in batch.column(0).to_pylist()]
            ends = written + np.cumsum([len(t) for t in tokens], dtype=np.int64)
            volumes = pa.array(np.concatenate(([written], ends[:-1])) // volume, pa.int32())
            written = int(ends[-1])
            for kind, values in (("ids", names), ("tokens", tokens)):
                yield pa.record_batch([batch.column(0), pa.array([kind] * len(values), pa.string()), volumes, pa.array(values, pa.binary())], names=["doc_id", "kind", "volume", "value"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by few at a time, which bounds what a task holds."""
        return run(batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(small, "doc_id long, kind string, volume int, value binary")
    lines = coded.sortWithinPartitions("kind", "volume", "doc_id", F.length("value"), "value").select("kind", "volume", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("kind", "volume").option("encoding", "ISO-8859-1").option("lineSep", _mark(eod)).text(path)


def _file() -> Column:
    """A file's name with its volume: the same for a task's tokens and ids."""
    return F.regexp_extract(F.col("path"), "([^/]+/[^/]+)$", 1)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, content) of the files under ``path``, ``block`` tokens each."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    size = 2 * block
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block")
    numbered = files.select(_file().alias("file"), "content", at)
    return numbered.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("content"))


def document_counts(blocks: DataFrame, eod: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, closed): the documents of flat files, by order in their file.

    ``closed`` is false for tokens after a file's last separator. A file without any
    token has no document; two separators in a row enclose an empty one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, last, inner, n = [], [], [], [], []
            for content in batch.column(2):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                at = np.flatnonzero(ids == eod)
                size.append(len(ids))
                n.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append((np.diff(at) - 1).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "size", "n", "first", "last", "inner"])

    found = blocks.select("file", "block", "content").mapInArrow(scan, "file string, block long, size long, n long, first long, last long, inner array<long>")
    placed = found.withColumn("start", F.col("block") * block)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block")
    stitched = placed.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("closed_before"),
        F.coalesce(F.last(F.col("start") + F.col("last"), ignorenulls=True).over(before), F.lit(-1)).alias("mark"),
        F.lead("block").over(whole).isNull().alias("final"),
    )
    crossing = F.when(F.col("n") > 0, F.array(F.col("start") + F.col("first") - F.col("mark") - 1)).otherwise(F.expr("array()").cast("array<bigint>"))
    open_end = F.col("start") + F.col("size") - F.coalesce(F.col("start") + F.col("last"), F.col("mark")) - 1
    tail = F.when(F.col("final") & (open_end > 0), F.array(open_end)).otherwise(F.expr("array()").cast("array<bigint>"))
    counts = stitched.select("file", "closed_before", "n", F.posexplode(F.concat(crossing, F.coalesce("inner", F.expr("array()").cast("array<bigint>")), tail)).alias("k", "n_tokens"))
    return counts.select("file", (F.col("closed_before") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("n")).alias("closed"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, doc_id) from id files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, ID_BYTES + 2)
                ids = np.ascontiguousarray(raw[:, 1:9]).view(">i8").ravel().astype(np.int64)
                yield pa.record_batch([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids))), pa.array(ids, mask=raw[:, 0] == 0)], names=["file", "ordinal", "doc_id"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select(_file().alias("file"), "content").mapInArrow(run, "file string, ordinal long, doc_id long")


def count_documents(docs: DataFrame, tokenizer_path: str, eod: int, path: str | None = None, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal): documents written as flat token files, and counted from those.

    Null and empty texts have 0 tokens. Repeated rows are documents of their own; of
    rows with one doc_id the shorter comes first. Null doc_ids stay null. An empty table
    gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    where = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, where, tokenizer_path, eod, volume)
    if not _has_files(spark, where):
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, ordinal long")
    counts = document_counts(read_blocks(spark, f"{where}/kind=tokens", block), eod, block)
    return counts.join(read_ids(spark, f"{where}/kind=ids"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` has a folder of token files (an empty table writes none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=tokens")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
