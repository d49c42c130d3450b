"""Chunk generators: fixed windows, sentence packing, table splitting, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

STRINGS = "array<string>"


def chunk_id(doc_id: Column, section: Column, ordinal: Column) -> Column:
    """24 hexadecimal digits of SHA-1 over document, section and ordinal."""
    return F.left(F.sha1(F.concat_ws("|", doc_id.cast("string"), section, ordinal.cast("string")).cast("binary")), F.lit(24))


def fixed_windows(docs: DataFrame, width: int = R.WINDOW_CHARS) -> DataFrame:
    """(doc_id, ordinal, chunk_id, section_path, text) in windows of ``width`` characters.

    Runs of three or more line ends count as two. A blank window is left out and keeps its number.
    """
    body = F.coalesce(T.stripped(F.regexp_replace("text", r"\n{3,}", "\n\n")), F.lit(""))
    starts = F.when(F.length("body") > 0, F.sequence(F.lit(0), F.length("body") - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    cut = docs.select("doc_id", body.alias("body")).select("doc_id", F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("body", s + 1, F.lit(width)).alias("part")))).alias("ordinal", "w"))
    bare = cut.select("doc_id", "ordinal", F.col("w.start").alias("start"), T.stripped(F.col("w.part")).alias("text")).filter("text <> ''")
    label = F.format_string("chars %d-%d", F.col("start"), F.col("start") + F.length("text"))
    return bare.select("doc_id", "ordinal", chunk_id(F.col("doc_id"), F.lit("baseline"), F.col("ordinal")).alias("chunk_id"), label.alias("section_path"), "text")


def sentences(text: Column) -> Column:
    return F.split(text, R.SENTENCE_END)


def pack_sentences(text: Column) -> Column:
    """Overlapping windows of whole sentences, for texts beyond the limit; a long sentence stays whole.

    The fold keeps finished parts and an open buffer; a buffer that would pass the
    target closes, and its last characters from a word's start open the next.
    """
    start = F.struct(F.array().cast(STRINGS).alias("parts"), F.lit("").alias("open"))

    def step(state: Column, sentence: Column) -> Column:
        held = state["open"]
        joined = F.when(held != "", T.stripped(F.concat(held, F.lit(" "), sentence))).otherwise(sentence)
        closes = (F.length(joined) > R.TARGET_CHARS) & (held != "")
        tail = F.right(held, F.lit(R.OVERLAP_CHARS))
        whole = F.when(F.instr(tail, " ") > 0, F.substring(tail, F.instr(tail, " ") + 1, F.lit(R.OVERLAP_CHARS))).otherwise(tail)
        opened = F.when(closes, T.stripped(F.concat(whole, F.lit(" "), sentence))).otherwise(joined)
        parts = F.when(closes, F.array_append(state["parts"], T.stripped(held))).otherwise(state["parts"])
        return F.struct(parts.alias("parts"), opened.alias("open"))

    def finish(state: Column) -> Column:
        last = T.stripped(state["open"])
        return F.when(last != "", F.array_append(state["parts"], last)).otherwise(state["parts"])

    packed = F.aggregate(sentences(text), start, step, finish)
    return F.when(F.length(text) <= R.MAX_CHARS, F.array(text)).when(F.size(packed) > 0, packed).otherwise(F.array(text))


def split_table(markdown: Column) -> Column:
    """A long Markdown table in parts that repeat its header; line ends don't count against the budget."""
    lines = F.split(markdown, "\n")
    header, rule = F.get(lines, 0), F.get(lines, 1)
    budget = F.lit(R.MAX_TABLE_CHARS) - F.length(header) - F.length(rule)
    start = F.struct(F.array().cast("array<array<string>>").alias("parts"), F.array().cast(STRINGS).alias("open"), F.lit(0).alias("chars"))

    def step(state: Column, row: Column) -> Column:
        closes = (F.size(state["open"]) > 0) & (state["chars"] + F.length(row) > budget)
        return F.struct(
            F.when(closes, F.array_append(state["parts"], state["open"])).otherwise(state["parts"]).alias("parts"),
            F.when(closes, F.array(row)).otherwise(F.array_append(state["open"], row)).alias("open"),
            F.when(closes, F.length(row)).otherwise(state["chars"] + F.length(row)).alias("chars"),
        )

    def finish(state: Column) -> Column:
        every = F.when(F.size(state["open"]) > 0, F.array_append(state["parts"], state["open"])).otherwise(state["parts"])
        return F.transform(every, lambda rows: F.array_join(F.concat(F.array(header, rule), rows), "\n"))

    splittable = (F.length(markdown) > R.MAX_TABLE_CHARS) & (F.size(lines) >= 3) & T.stripped(rule).startswith("|")
    return F.when(splittable, F.aggregate(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), start, step, finish)).otherwise(F.array(markdown))


def _text_runs(texts: Column) -> Column:
    """Groups of consecutive text blocks: a group closes once its blocks reach the limit."""
    start = F.struct(F.array().cast("array<array<struct<text:string,page:int>>>").alias("done"), F.array().cast("array<struct<text:string,page:int>>").alias("open"), F.lit(0).alias("chars"))

    def step(state: Column, block: Column) -> Column:
        grown = F.array_append(state["open"], block)
        full = state["chars"] + F.length(block["text"]) >= R.MAX_CHARS
        return F.struct(
            F.when(full, F.array_append(state["done"], grown)).otherwise(state["done"]).alias("done"),
            F.when(full, F.array().cast("array<struct<text:string,page:int>>")).otherwise(grown).alias("open"),
            F.when(full, F.lit(0)).otherwise(state["chars"] + F.length(block["text"])).alias("chars"),
        )

    return F.aggregate(texts, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def section_chunks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, chunk_id, section_path, content_type, page, text) from blocks (doc_id, pos, kind, text, page).

    Headings open sections and, like titles and tables, end a run of text. A table is
    a chunk of its own (split if long); text is gathered up to the limit and packed.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    breaks = F.when(F.col("kind") != "text", 1).otherwise(0)
    marked = blocks.select(
        "doc_id", "pos", "kind", "text", "page",
        F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(order).alias("section"),
        F.last(F.when(F.col("kind") == "heading", F.struct(F.col("page"))), ignorenulls=True).over(order)["page"].alias("section_page"),
        F.sum(breaks).over(order).alias("island"),
    )
    placed = marked.withColumn("at", F.coalesce("page", "section_page"))
    tables = placed.filter("kind = 'table'").select("doc_id", "section", "pos", F.lit("table").alias("content_type"), F.col("at").alias("page"), F.posexplode(split_table(F.col("text"))).alias("part", "text"))
    entry = F.struct("pos", F.struct(F.col("text"), F.col("at").cast("int").alias("page")).alias("block"))
    runs = placed.filter("kind = 'text'").groupBy("doc_id", "island", "section").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(entry)).alias("entries"))
    groups = runs.select("doc_id", "section", "pos", F.posexplode(_text_runs(F.transform("entries", lambda e: e["block"]))).alias("run", "blocks"))
    joined = T.stripped(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))
    # a run's page is that of its first block with one
    page = F.get(F.filter(F.transform("blocks", lambda b: b["page"]), lambda p: p.isNotNull()), 0)
    texts = groups.select("doc_id", "section", "pos", F.lit("text").alias("content_type"), page.alias("page"), "run", F.posexplode(pack_sentences(joined)).alias("part", "text"))
    both = tables.withColumn("run", F.lit(0)).unionByName(texts).withColumn("text", T.stripped(F.col("text"))).filter("text <> ''")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "run", "part")) - 1
    named = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("front-matter"))
    shown = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("Front matter"))
    return both.withColumn("ordinal", ordinal).select("doc_id", "ordinal", chunk_id(F.col("doc_id"), named, F.col("ordinal")).alias("chunk_id"), shown.alias("section_path"), "content_type", "page", "text")


def enrich(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks with their document's fields, text to index and token estimate."""
    wide = chunks.join(meta, "doc_id")
    bare_section = F.when(F.col("section_path") == "Front matter", "").otherwise(F.col("section_path"))
    body = T.embed_text(F.col("title"), bare_section, F.col("department"), F.col("doc_type"), F.col("effective_date"), F.col("version"), F.col("text"), F.col("content_type"))
    return wide.withColumn("embed_text", body).withColumn("token_estimate", T.token_estimate(body))
