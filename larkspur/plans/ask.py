"""Questions to answers, as one plan for any number of questions.

Tables in: questions (query_id long, question, history ARRAY<STRUCT<role, content>>,
departments ARRAY<STRING> or null), chunks (chunk_id long or string key mapped to long
``cid``, doc_id, text, embed_text, title, section_path, department, doc_type,
effective_date, version, is_current), vectors (cid, vector). Tables out: hits and
answers. Scope applies before BM25 scores are summed and inside the vector products, which
leave out vectors that no question may see; BM25 statistics stay corpus-wide. Tables that
several later steps read are computed once, so a call runs queries of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import embed, guard, hooks, index, lineage, rank, search, understand
from ..functions import text as T
from .settings import Settings

CHUNK_FIELDS = ("doc_id", "text", "title", "section_path", "department", "doc_type", "effective_date", "version", "is_current")


@dataclass(frozen=True)
class Retrieval:
    """Sub-questions asked, every ranked candidate, and the hits that make the context."""

    subquestions: DataFrame
    candidates: DataFrame
    hits: DataFrame


def understood(questions: DataFrame, model: hooks.Model | None = None) -> DataFrame:
    """``questions`` with ``standalone`` and ``condensed``."""
    history = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
    needed = understand.needs_condensation(F.col("question"), F.size(history) > 0)
    rewrite = understand.condense(F.col("question"), understand.last_user_text(history))
    out = questions.withColumn("condensed", needed)
    if model is not None:
        out = hooks.complete(out, F.when(F.col("condensed"), hooks.condense_prompt(F.col("question"), history)), model)
        rewrite = hooks.condensed(F.col("reply"), rewrite)
    return out.withColumn("standalone", F.when(F.col("condensed"), rewrite).otherwise(F.col("question"))).drop("reply")


def _scoped(scores: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (query_id = sub-question key, cid, ..) of chunks inside the principal's scope."""
    scope = asked.select(F.col("sid").alias("query_id"), "departments")
    named = scores.join(chunks.select("cid", "department"), "cid").join(scope, "query_id")
    return named.filter(F.col("departments").isNull() | search.in_scope(F.col("departments"), F.col("department"))).drop("department", "departments")


def _seen_by_any(vectors: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of chunks that some question may see; the others are never scored."""
    named = asked.select(F.explode(F.coalesce("departments", F.array(F.lit("*")))).alias("d")).distinct()
    every = named.agg(F.coalesce(F.bool_or(F.col("d") == "*"), F.lit(False)).alias("all"))  # one row
    seen = chunks.select("cid", "department").crossJoin(F.broadcast(every)).join(named, F.col("department") == F.col("d"), "left")
    return vectors.join(seen.filter(F.col("all") | F.col("d").isNotNull()).select("cid"), "cid", "left_semi")


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings | None = None, model: hooks.Model | None = None, lexicon: index.LexicalIndex | None = None, keep: lineage.Keep = lambda df: df) -> Retrieval:
    """The improved profile: condense, decompose, hybrid search, currency filter, rerank, version rank, interleave.

    ``lexicon`` is the kept index of ``chunks`` (key cid, text embed_text); without it the
    index is built for this call. ``vectors`` are those of ``chunks``. If no question is
    restricted, no scope is looked up. The hits of the context stay cached, the scores of the
    lexical list only until those are there.
    """
    s = settings or Settings()
    asked = understood(questions, model).select("*", F.posexplode(understand.subquestions(F.col("standalone"))).alias("sub", "subquestion"))
    asked = keep(asked.withColumn("sid", F.col("query_id") * 4 + F.col("sub")))  # at most three sub-questions
    restricted = not asked.filter(F.col("departments").isNotNull() & ~F.array_contains("departments", "*")).isEmpty()
    texts = asked.select(F.col("sid").alias("query_id"), F.col("subquestion").alias("text"))
    words = lexicon or index.build(chunks, "cid", "embed_text")
    lexical = index.bm25(texts, words, key="cid", scope=(lambda found: _scoped(found, asked, chunks)) if restricted else None).persist(StorageLevel.DISK_ONLY)
    probes, seen = embed.embed_texts(texts, "query_id", width=s.embed_width), vectors.select("cid", "vector")
    if restricted:
        probes = probes.join(asked.select(F.col("sid").alias("query_id"), "departments"), "query_id")
        seen = _seen_by_any(seen, asked, chunks).join(chunks.select("cid", "department"), "cid")
    found = search.hybrid(lexical, keep(probes), seen, s.retrieve_top_k, key="cid", keep=keep)
    named = found.select(F.col("query_id").alias("sid"), "cid", F.col("rrf").alias("score"), "keyword_score", "vector_score").join(asked.select("sid", "query_id", "sub", "question", "standalone", "subquestion"), "sid")
    hits = rank.merge_subqueries(named.withColumn("chunk_id", F.col("cid"))).join(chunks.select("cid", *CHUNK_FIELDS), "cid")
    standalone = hits.withColumnRenamed("question", "asked").withColumn("question", F.col("standalone"))
    current = rank.drop_superseded(standalone)
    window = rank.interleave(current, None, [F.desc(F.round("score", 12)), F.col("cid")])
    scored = rank.lexical_rerank(window)
    method = F.lit("lexical")
    if model is not None:
        passage = F.concat(F.lit("["), (F.col("place") - 1).cast("string"), F.lit("] "), F.col("title"), F.lit(" > "), F.col("section_path"), F.lit("\n"), F.left("text", F.lit(700)))
        inside = scored.filter(F.col("place") <= 20).groupBy("query_id").agg(F.first("standalone").alias("q"), F.array_sort(F.collect_list(F.struct("place", passage.alias("p")))).alias("ps"))
        replies = hooks.complete(inside.select("query_id", hooks.rerank_prompt(F.col("q"), F.transform("ps", lambda p: p["p"])).alias("prompt")), F.col("prompt"), model)
        scores = replies.select("query_id", hooks.rerank_scores(F.col("reply")).alias("scores"))
        joined = scored.withColumnRenamed("rerank_score", "lexical_score").join(scores, "query_id", "left")
        own = F.when(F.col("scores").isNotNull(), F.coalesce(F.try_element_at("scores", F.col("place") - 1), F.lit(0.0)))
        scored = rank.fall_back_when_degenerate(joined.withColumn("model_score", own)).drop("scores")
        method = F.col("rerank_method")
    calibrated = scored.withColumn("rerank_raw", F.col("rerank_score")).withColumn("rerank_score", rank.calibrate(method, F.col("rerank_score")))
    order = calibrated.withColumn("window_place", F.col("place"))
    ranked = rank.version_rank(order)
    chosen = rank.interleave(ranked, s.context_top_k, [F.desc(F.round("score", 9)), F.col("window_place")])
    hits = chosen.withColumn("relevance", F.coalesce("rerank_score", "score")).persist(StorageLevel.MEMORY_AND_DISK)
    hits.count()
    lexical.unpersist()
    return Retrieval(asked, ranked, hits)


def retrieve_baseline(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings | None = None) -> Retrieval:
    """The baseline profile: the nearest chunks by vector, without scope."""
    s = settings or Settings(profile="baseline")
    asked = questions.select("*", F.lit(0).alias("sub"), F.col("question").alias("subquestion"), F.col("question").alias("standalone"))
    near = search.cosine(embed.embed_texts(asked.select("query_id", F.col("question").alias("text")), "query_id", width=s.embed_width), vectors, s.baseline_top_k, key="cid")
    top = index.top_k(near, s.baseline_top_k, key="cid").withColumnRenamed("rank", "place")
    hits = top.join(chunks.select("cid", *CHUNK_FIELDS), "cid").join(asked.select("query_id", "question", "standalone", "sub"), "query_id")
    hits = hits.withColumn("chunk_id", F.col("cid")).withColumn("relevance", F.col("score"))
    return Retrieval(asked, hits, hits)


def answers(questions: DataFrame, found: Retrieval, settings: Settings | None = None, model: hooks.Model | None = None) -> DataFrame:
    """(query_id, status, answer, confidence, options, sources, unsupported) for every question."""
    s = settings or Settings()
    block = A.format_source(F.col("place"), *[F.col(c) for c in ("title", "section_path", "department", "effective_date", "version", "is_current", "text")])
    used = A.within_budget(found.hits.withColumn("block", block), s.max_context_chars)
    context = A.context(used)
    enough = guard.sufficiency(found.hits, s.min_relevance)
    vague = guard.ambiguity(found.hits).select("query_id", "ambiguous", "options")
    titles = found.hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda t: t["title"]).alias("titles"))
    rows = questions.join(titles, "query_id", "left").join(context, "query_id", "left").join(enough, "query_id", "left").join(vague, "query_id", "left")
    drafted = A.extractive(F.col("question"), F.col("context"))
    if model is not None:
        history = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
        rows = hooks.complete(rows, F.when(F.col("n") > 0, hooks.answer_prompt(F.col("question"), F.col("context"), history)), model)
        drafted = F.coalesce(F.nullif(T.stripped(F.col("reply")), F.lit("")), drafted)
    rows = rows.withColumn("draft", drafted)
    rows = rows.withColumn("unsupported", T.unsupported_figures(F.col("draft"), F.col("source_text"))).withColumn("valid", guard.citations_valid(F.col("draft"), F.col("sources")))
    grounded = guard.groundedness(F.size("unsupported"), F.col("valid"))
    rows = rows.withColumn("confidence", guard.confidence(F.col("top_score"), F.col("margin"), grounded, F.col("valid")))
    restricted = F.col("departments").isNotNull() & ~F.array_contains("departments", "*")
    status = A.status(F.coalesce("n", F.lit(0)), F.coalesce(restricted, F.lit(False)), F.col("ambiguous"), F.col("sufficient"), A.refuses(F.col("draft")), F.col("confidence"), s.baseline)
    rows = rows.withColumn("status", status)
    text = (
        F.when(F.col("status") == "answered", F.col("draft"))
        .when(F.col("n").isNull(), A.nothing_found(F.col("departments"), F.coalesce(restricted, F.lit(False))))
        .when(F.col("status") == "needs_clarification", A.clarification(F.col("options")))
        .otherwise(A.abstention(F.col("titles")))
    )
    shown = F.when(F.col("status") == "answered", F.col("confidence")).otherwise(F.lit(0.0))
    options = F.when(F.col("status") == "needs_clarification", F.col("options")).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", "status", text.alias("answer"), shown.alias("confidence"), options.alias("options"), F.coalesce("sources", F.lit(0)).alias("sources"), "unsupported")


def ask(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings | None = None, model: hooks.Model | None = None, lexicon: index.LexicalIndex | None = None) -> DataFrame:
    """Answers in the settings' profile. Questions that share a cache key are answered once."""
    s, keep = settings or Settings(), lineage.keeper(questions.sparkSession)
    keyed = questions.withColumn("__key", A.cache_key(s.profile, F.col("departments"), F.col("question")))
    single = F.size(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))) == 0
    keyed = keyed.withColumn("__key", F.when(single, F.col("__key")).otherwise(F.concat(F.lit("turn|"), F.col("query_id").cast("string"))))
    first = keyed.groupBy("__key").agg(F.min("query_id").alias("query_id"))
    unique = keep(keyed.join(first, ["__key", "query_id"], "left_semi"))
    found = retrieve_baseline(unique, chunks, vectors, s) if s.baseline else retrieve(unique, chunks, vectors, s, model, lexicon, keep)
    done = answers(unique.drop("__key"), found, s, model).withColumnRenamed("query_id", "__first")
    back = keyed.select("query_id", "__key").join(first.withColumnRenamed("query_id", "__first"), "__key")
    return back.join(done, "__first").drop("__first", "__key")


def cites_superseded(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id): answers that cite a document of which a hit isn't current."""
    stale = hits.filter(~F.col("is_current")).select("query_id", "doc_id")
    return citations.join(stale, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
