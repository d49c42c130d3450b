"""Exact duplicates through a log-structured merge index. DataFrame functions only.

* memtable: each task digests its slice of the documents and flushes it in files of at
  most ``memtable`` entries, sorted by digest: the runs of level 0. A flush has a
  filter: a bitmap over the hashes of its digests, of bounded size, which rows of
  further batches are probed with; the groups found have one too;
* compaction: ``fan`` flushes of one level become one of the next, with one entry per
  digest that keeps the best identifier (longest original text, then smallest doc_id)
  and the number of rows. Minima and sums combine map-side, so a group with a third of
  all rows is a few rows per task by the time it is shuffled;
* lookup: rows whose digest the filters rule out take no part in any join. The others
  meet the merged entries by digest; groups with more than a thousandth of the rows
  (fewer than a thousand of them) are broadcast, so no task gets a hot one;
* verification: hits - rows whose digest may be in a group - are read again, and the
  normalised bytes of a digest must all be equal: a minimum and a maximum per digest,
  combined map-side. Texts that no filter lets through are not shuffled. Texts that
  share a digest but not their bytes fall back to grouping by the bytes themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, squeezed

ENTRY = "digest binary, doc_id long, chars long, size long"
#: Bits of a filter per digest, and at most (32 MB: what is broadcast).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: A group is hot with more than this share of all rows, and at least so many.
HOT_SHARE, HOT_LEAST = 0.001, 64


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


# --- filters ------------------------------------------------------------------------------


@dataclass(frozen=True)
class DigestFilter:
    """Bitmaps over hashes of digests: (bucket, bitmap) rows of 4 KB, ``bits`` in all."""

    bitmaps: DataFrame
    bits: int

    @staticmethod
    def of(digests: DataFrame, count: int) -> DigestFilter:
        bits = min(MOST_BITS, 1 << max(15, (BITS_EACH * count).bit_length()))
        slot = DigestFilter._slot(F.col("digest"), bits)
        placed = digests.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("place"))
        return DigestFilter(cut(placed.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))), bits)

    @staticmethod
    def _slot(digest: Column, bits: int) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(bits)) + 1

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with their column ``digest`` tested: ``name`` is false if it is not in the filter for certain."""
        slot = self._slot(F.col("digest"), self.bits)
        maps = F.broadcast(self.bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))  # at most MOST_BITS
        met = rows.join(maps, F.bitmap_bucket_number(slot) == F.col("__bucket"), "left")
        place = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, (place % 8).cast("int"))
        return met.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__bucket", "__bitmap")


# --- index --------------------------------------------------------------------------------


@dataclass
class Flush:
    """The sorted runs of one flush or compaction."""

    spark: SparkSession
    where: str

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.where)

    @cached_property
    def filter(self) -> DigestFilter:
        """Filter of all its digests, made when it is first probed."""
        return DigestFilter.of(self.entries(), self.entries().count())


@dataclass
class DigestIndex:
    """A log-structured merge index of document digests under ``path``.

    Runs are immutable files; a lost task rewrites its run whole. An index belongs to
    the driver that made it.
    """

    spark: SparkSession
    path: str = ""
    digest: Callable[[Column], Column] = sha256
    memtable: int = 1 << 20
    fan: int = 4
    levels: list[list[Flush]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        self.path = self.path or f"{shared_dir(self.spark)}/digest-index-{uuid.uuid4().hex}"

    def _write(self, entries: DataFrame, level: int) -> None:
        """Entries as sorted runs of a level."""
        where = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        entries.sortWithinPartitions("digest").write.option("maxRecordsPerFile", self.memtable).parquet(where)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Flush(self.spark, where))

    def flush(self, docs: DataFrame) -> None:
        """Adds a batch (doc_id, text, ...) at level 0, and compacts levels that are full."""
        entries = docs.select(
            self.digest(squeezed(F.col("text"))).alias("digest"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
            F.lit(1).cast("long").alias("size"),
        )
        self._write(entries, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(_merged(self._read(full), ["digest"]), level + 1)
            level += 1

    @staticmethod
    def _read(flushes: list[Flush]) -> DataFrame:
        return reduce(DataFrame.unionByName, [f.entries() for f in flushes])

    def entries(self) -> DataFrame:
        """All entries of all levels: (digest, doc_id, chars, size)."""
        return self._read([f for level in self.levels for f in level])

    def merged(self) -> DataFrame:
        """(digest, doc_id, chars, size): one entry per digest, with its best row and the number of rows."""
        return _merged(self.entries(), ["digest"])

    def known(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id) of the rows of a further batch whose digest is in the index; only rows that some filter lets through are joined."""
        probes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(squeezed(F.col("text"))).alias("digest"))
        flushes = [f for level in self.levels for f in level]
        for k, flush in enumerate(flushes):
            probes = flush.filter.marked(probes, f"in{k}")
        likely = probes.filter(reduce(lambda a, b: a | b, [F.col(f"in{k}") for k in range(len(flushes))])).select("doc_id", "digest")
        return likely.join(self.merged().select("digest", F.col("doc_id").alias("keep_id")), "digest").select("doc_id", "digest", "keep_id")


def _merged(entries: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("chars")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id")))
    grouped = entries.groupBy(*keys).agg(best.alias("best"), F.sum("size").alias("size"))
    return grouped.select(*keys, F.col("best.doc_id").alias("doc_id"), (-F.col("best.short")).alias("chars"), "size")


# --- groups -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Groups:
    """Merged groups of more than one row (digest, keep_id, group_size), their filter, and those with unequal bytes."""

    of_digest: DataFrame
    hits: DigestFilter
    hot: DataFrame
    clash: DataFrame


def _bodies(docs: DataFrame, digest: Callable[[Column], Column], hits: DigestFilter) -> DataFrame:
    """(doc_id, digest, chars, body) of the rows that may be in a group."""
    body = squeezed(F.col("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), digest(body).alias("digest"), body.alias("body"))
    return hits.marked(plain, "__hit").filter("__hit").drop("__hit")


def _met(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Inner join on digest; hot groups by broadcast."""
    hot = F.broadcast(hot)  # fewer than 1 / HOT_SHARE rows
    large = rows.join(hot, "digest", "left_semi").join(F.broadcast(groups.join(hot, "digest", "left_semi")), "digest")
    return rows.join(hot, "digest", "left_anti").join(groups, "digest").unionByName(large)


def find_groups(docs: DataFrame, index: DigestIndex) -> Groups:
    """Groups of equal texts of ``docs``, which are flushed to ``index``."""
    index.flush(docs)
    multi = cut(index.merged().filter("size > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size")))
    count, rows = multi.agg(F.count(F.lit(1)), F.sum("group_size")).first()
    hits = DigestFilter.of(multi, count)
    hot = cut(multi.filter(F.col("group_size") > max(HOT_LEAST, HOT_SHARE * (rows or 0))).select("digest"))
    bytes_of = _bodies(docs, index.digest, hits).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clash = cut(bytes_of.filter("low <> high").select("digest"))
    return Groups(multi, hits, hot, clash)


def _settled(docs: DataFrame, found: Groups, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, digest, body, keep_id, group_size) of rows whose digest stands for unequal bytes, grouped by those."""
    bodies = _bodies(docs, digest, found.hits).join(found.clash, "digest", "left_semi").withColumn("size", F.lit(1).cast("long"))
    by_bytes = _merged(bodies, ["digest", "body"]).select("digest", "body", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"))
    return bodies.join(by_bytes, ["digest", "body"]).select("doc_id", "digest", "body", "keep_id", "group_size")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size), a row for each row of ``docs`` (doc_id, text, ...).

    Texts are equal when they are after deleting white space; null counts as empty.
    Empty texts form one group. Repeated rows count one by one in group_size. A null
    doc_id stays only if its group has no other id at the same length. An empty table
    gives an empty result; columns besides doc_id and text are ignored.
    """
    index = DigestIndex(docs.sparkSession, digest=digest)
    found = find_groups(docs, index)
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    entries = found.hits.marked(index.entries().select("doc_id", "digest"), "hit")
    alone = entries.filter("not hit").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    likely = entries.filter("hit").select("doc_id", "digest")
    grouped = _met(likely, found.of_digest, found.hot).select(columns)
    astray = likely.join(found.of_digest.select("digest"), "digest", "left_anti").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = alone.unionByName(astray)
    if found.clash.isEmpty():
        return out.unionByName(grouped)
    return out.unionByName(grouped.join(found.clash, "digest", "left_anti")).unionByName(_settled(docs, found, digest).select(columns))


def drop_exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the longest original, then the smallest doc_id.

    Null and empty texts are one group; repeated rows with one doc_id leave one of them;
    a null doc_id stays only if its group has no other at the same length. An empty
    table stays empty; all columns of any name are kept. Rows whose digest no filter
    lets through are kept as they are, without a shuffle.
    """
    names = docs.columns
    found = find_groups(docs, DigestIndex(docs.sparkSession, digest=digest))
    tagged = found.hits.marked(docs.select("*", digest(squeezed(F.col("text"))).alias("digest")) if "digest" not in names else _clear(docs, digest), "__hit")
    alone = tagged.filter("not __hit").select(_back(names))
    likely = tagged.filter("__hit").drop("__hit")
    astray = likely.join(found.of_digest.select("digest"), "digest", "left_anti").select(_back(names))
    keep = found.of_digest.join(found.clash, "digest", "left_anti").select("digest", "keep_id")
    own = F.col("doc_id").cast("long")
    kept = likely.join(keep.withColumnRenamed("keep_id", "__keep"), "digest").filter(own.eqNullSafe(F.col("__keep"))).dropDuplicates(["digest"])
    out = alone.unionByName(astray).unionByName(kept.select(_back(names)))
    if found.clash.isEmpty():
        return out
    best = _settled(docs, found, digest).select("digest", F.col("body").alias("__body"), F.col("keep_id").alias("__keep")).distinct()
    settled = likely.withColumn("__body", squeezed(F.col("text"))).join(best, ["digest", "__body"]).filter(own.eqNullSafe(F.col("__keep"))).dropDuplicates(["digest", "__body"])
    return out.unionByName(settled.select(_back(names)))


def _clear(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with the digest, a column of that name set aside."""
    return docs.withColumnRenamed("digest", "__digest").withColumn("digest", digest(squeezed(F.col("text"))))


def _back(names: list[str]) -> list[Column]:
    return [F.col("__digest").alias("digest") if n == "digest" else F.col(f"`{n}`") for n in names]
