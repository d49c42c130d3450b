"""Structure from lines and sheet rows: boilerplate, row groups, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def edge_lines(pages: DataFrame, edge: int = 3) -> DataFrame:
    """(doc, page, line): distinct first and last lines per page, fit to be a running header or footer.

    ``pages``: (doc, page, lines array).
    """
    near = F.array_distinct(F.concat(F.slice("lines", 1, edge), F.slice(F.reverse("lines"), 1, edge)))
    lines = pages.select("doc", "page", F.explode(near).alias("raw"))
    line = T.stripped(F.col("raw"))
    return lines.select("doc", "page", line.alias("line")).filter((F.length("line") >= 4) & (F.length("line") <= 90) & F.col("line").rlike(r"[\p{L}\p{N}]"))


def boilerplate(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc, line, n): lines on at least ``share`` of a document's pages (two or more), and page numbers."""
    total = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"))
    counts = edge_lines(pages).groupBy("doc", "line").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * share))
    return counts.join(total, "doc").filter((F.col("pages") >= 2) & ((F.col("n") >= least) | F.col("line").rlike(R.PAGE_LINE))).select("doc", "line", "n")


def without_boilerplate(lines: DataFrame, running: DataFrame) -> DataFrame:
    """``lines`` (doc, line, ...) that aren't running headers or footers."""
    return lines.join(running.select("doc", "line"), ["doc", "line"], "left_anti")


def row_groups(rows: DataFrame) -> DataFrame:
    """(sheet, grp, width, rows): runs of sheet rows with one number of filled cells; an empty row ends a run.

    ``rows``: (sheet, pos, cells array). Gaps and islands by a lag and a running sum.
    """
    order = Window.partitionBy("sheet").orderBy("pos")
    filled = rows.withColumn("width", F.size(F.filter("cells", lambda c: T.stripped(F.coalesce(c, F.lit(""))) != "")))
    fresh = F.when(F.lag("width").over(order).eqNullSafe(F.col("width")), 0).otherwise(1)
    numbered = filled.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(order)).filter("width > 0")
    gathered = numbered.groupBy("sheet", "grp", "width").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("entries"))
    return gathered.select("sheet", "grp", "width", F.transform("entries", lambda e: e["cells"]).alias("rows"))


def sheet_blocks(rows: DataFrame) -> DataFrame:
    """(sheet, grp, pos, kind, text): one column is text, two are keys and values, more a table."""
    groups = row_groups(rows)
    kind = F.when(F.col("width") <= 1, "text").otherwise("table")
    single = F.transform("rows", lambda r: F.get(F.filter(r, lambda c: T.stripped(F.coalesce(c, F.lit(""))) != ""), 0))
    parts = F.when(F.col("width") <= 1, single).when(F.col("width") == 2, F.array(T.rows_to_key_values(F.col("rows")))).otherwise(F.array(T.rows_to_markdown(F.col("rows"))))
    return groups.select("sheet", "grp", kind.alias("kind"), F.posexplode(parts).alias("pos", "text")).filter("text <> ''")


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text, level, page) from plain text, a block per line: headings, Markdown tables, text.

    Consecutive table lines form one block; a bullet line joins what follows.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", T.stripped(F.col("line"))).filter("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("pos")
    head = T.heading(F.col("line"))
    kind = F.when(head.isNotNull(), "heading").when(F.col("line").startswith("|"), "table").otherwise("text")
    typed = lines.withColumn("kind", kind).withColumn("head", head)
    fresh = F.when((F.col("kind") == "table") & F.lag("kind").over(order).eqNullSafe(F.lit("table")), 0).otherwise(1)
    grouped = typed.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(order)).groupBy("doc_id", "grp", "kind")
    entry = F.struct("pos", F.coalesce(F.col("head")["text"], F.col("line")).alias("line"))
    out = grouped.agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(entry)).alias("entries"), F.max(F.coalesce(F.col("head")["level"], F.lit(0))).alias("level"))
    return out.select("doc_id", "pos", "kind", F.array_join(F.transform("entries", lambda e: e["line"]), "\n").alias("text"), "level", F.lit(None).cast("int").alias("page"))
