"""How the test tables stand in for the engine's own, stated once for queries and oracles.

Documents are chunks of themselves: language is the department, source the type, the
quality label tells currency (no label: current), and a year is made from the id.
Benchmark items are the questions. Vectors belong to documents of the same number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed, index
from .sync import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _can_write(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there or can be made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    except Py4JJavaError:
        return False


def _kept(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], object]) -> str | None:
    """Folder of what was kept of the corpus for these very files, else made by ``make`` in a new one; None where nothing can be written.

    It lies in the warehouse folder, which a cluster's machines share, under a digest of the
    files' names, sizes and times; other files make another one.
    """
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select(F.concat_ws("|", "path", "length", "modificationTime").alias("f"))
    state = files.agg(F.sum(F.xxhash64("f").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    store = Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/larkspur-{kind}", f"{state.n}-{state.s}")
    _, name = store.current()
    if name is None:
        if not _can_write(spark, store.path):
            return None
        name = f"v{uuid.uuid4().hex}"
        make(f"{store.path}/{name}")
        store.publish(1, name)
    return f"{store.path}/{name}"


def kept_index(spark: SparkSession, sf_dir: str) -> index.LexicalIndex:
    """The corpus' lexical index: opened if it was kept for these very files, else built and kept.

    Where nothing can be written, the index is built for this use only.
    """
    path = _kept(spark, sf_dir, "lexical", lambda path: index.write(index.build(corpus(spark, sf_dir)), path))
    return index.build(corpus(spark, sf_dir)) if path is None else index.read(spark, path)


def kept_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, vector) of the whole corpus by the local embedder, kept like the index: texts are embedded once, not at each use in a plan."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file of one row group would be embedded by one task
    made = embed.embed_texts(corpus(spark, sf_dir).repartition(n, "chunk_id"), "chunk_id")
    path = _kept(spark, sf_dir, "vectors", lambda path: made.write.parquet(path))
    return made if path is None else spark.read.parquet(path)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the fields of chunks."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    year = (F.lit(2015) + F.col("doc_id") % 12).cast("string")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("lang").alias("department"), F.col("source").alias("doc_type"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("section_path"),
        F.concat(year, F.lit("-01-01")).alias("effective_date"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_current"),
    )


DESCRIBED = """described as (
  select d.doc_id as chunk_id, d.doc_id, d.text, lang as department, source as doc_type, 'doc ' || d.doc_id as title, source as section_path,
    (2015 + d.doc_id % 12) || '-01-01' as effective_date, coalesce(quality, 1) = 1 as is_current
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)
)"""


def dated_question(question: F.Column, number: F.Column) -> F.Column:
    """A question that in turn names a year, asks about the past, or neither."""
    return F.when(number % 3 == 0, F.concat(question, F.lit(" in 2019"))).when(number % 3 == 1, F.concat(F.lit("what was the previous "), question)).otherwise(question)


DATED = "case query_id % 3 when 0 then text || ' in 2019' when 1 then 'what was the previous ' || text else text end"


def hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The best documents of each question by BM25, with the fields of chunks, ``score`` (6 places), ``rank`` and ``sub`` (two sub-questions)."""
    asked = questions(spark, sf_dir)
    best = index.top_k(index.bm25(asked, kept_index(spark, sf_dir)).withColumn("score", F.round("score", 6)), k)
    named = best.join(described(spark, sf_dir), "chunk_id").join(asked.select("query_id", dated_question(F.col("text"), F.col("query_id")).alias("question")), "query_id")
    return named.withColumn("sub", (F.col("chunk_id") % 2).cast("int"))


def hits_ctes(k: int = 20) -> str:
    from .oracle import bm25_ctes

    return f"""{bm25_ctes()}, {DESCRIBED},
best as (select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank from bm25 qualify rank <= {k}),
hits as (select b.*, d.* exclude (chunk_id), {DATED} as question, (chunk_id % 2)::int as sub from best b join described d using (chunk_id) join (select item_id as query_id, text as qtext from benchmark) q using (query_id))""".replace(
        f"{DATED} as question", f"{DATED.replace('text', 'qtext')} as question"
    )
