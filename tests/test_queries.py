"""Each registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from larkspur.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(SQL[name]).df())
    assert got == want and got[1]


def test_sections_equal_a_plain_loop(spark, sf_dir):
    from larkspur.operators import blocks, chunking
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, "1. Purpose\nfirst\nsecond\n2. Rates\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter\n" + "long line here. " * 200)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    made = blocks.text_blocks(both)
    per = {}
    for b in sorted(made.collect(), key=lambda b: (b.doc_id, b.pos)):
        per.setdefault(b.doc_id, []).append(b)
    texts = {r.t: list(r.p) for r in spark.createDataFrame([(t,) for t in {x for bs in per.values() for x in _runs(bs)}], "t string").select("t", chunking.pack_sentences(F.col("t")).alias("p")).collect()}
    want = []
    for doc, bs in per.items():
        section, run, size, n = None, [], 0, 0

        def close(doc=doc):
            nonlocal run, size, n
            if run:
                for part in texts["\n".join(run).strip()]:
                    want.append((doc, n, section or "Front matter", part.strip()))
                    n += 1
            run, size = [], 0

        for b in bs:
            if b.kind == "heading":
                close()
                section = b.text
            elif b.kind == "table":
                close()
                want.append((doc, n, section or "Front matter", b.text))
                n += 1
            else:
                run.append(b.text)
                size += len(b.text)
                if size >= 1400:
                    close()
        close()
    got = [(r.doc_id, r.ordinal, r.section_path, r.text) for r in chunking.section_chunks(made).collect() if r.content_type == "text" or len(r.text) <= 3000]
    assert sorted(x for x in got) == sorted(want)


def _runs(bs):
    """Joined text runs of one document's blocks."""
    run, size = [], 0
    for b in bs:
        if b.kind != "text":
            if run:
                yield "\n".join(run).strip()
            run, size = [], 0
            continue
        run.append(b.text)
        size += len(b.text)
        if size >= 1400:
            yield "\n".join(run).strip()
            run, size = [], 0
    if run:
        yield "\n".join(run).strip()


def test_local_embedder(spark):
    import math

    from larkspur.operators import embed

    text = "net 30% of net 30%"
    weights = {}
    words = ["net", "30%", "of", "net", "30%"]
    for w in words:
        weights[f"w:{w}"] = weights.get(f"w:{w}", 0) + 1.0
    for a, b in zip(words, words[1:], strict=False):
        weights[f"b:{a}_{b}"] = weights.get(f"b:{a}_{b}", 0) + 0.5
    line = " ".join(words)
    for i in range(len(line) - 3):
        weights[f"c:{line[i : i + 4]}"] = weights.get(f"c:{line[i : i + 4]}", 0) + 0.3
    got = embed.features(text)
    assert got.keys() == weights.keys() and all(math.isclose(got[k], weights[k]) for k in got)
    rows = embed.embed_texts(spark.createDataFrame([(1, text), (2, None)], "k long, text string"), "k").collect()
    norms = {r.k: math.sqrt(sum(x * x for x in r.vector)) for r in rows}
    assert math.isclose(norms[1], 1.0) and norms[2] == 0.0


def test_ask_end_to_end(spark):
    from larkspur.operators import embed
    from larkspur.plans.ask import ask
    from larkspur.plans.settings import Settings

    chunk = "cid long, doc_id string, text string, embed_text string, title string, section_path string, department string, doc_type string, effective_date string, version string, is_current boolean"
    made = [
        (1, "a.pdf", "The hotel limit in London is $250 per night. Book early.", "Travel", "2. Hotels", "Finance", "policy", "2026-01-01", "2", True),
        (2, "b.pdf", "Annual leave is 25 days for all staff.", "Leave", "1. Leave", "HR", "policy", "2026-01-01", None, True),
        (3, "c.pdf", "The hotel limit in London is $200 per night.", "Travel 2025", "2. Hotels", "Finance", "policy", "2025-01-01", "1", False),
    ]
    chunks = spark.createDataFrame([(c, d, t, t, *rest) for c, d, t, *rest in made], chunk)
    vectors = embed.embed_texts(chunks.select("cid", "text"), "cid")
    asked = spark.createDataFrame(
        [(1, "What is the hotel limit in London?", None, None), (2, "what is the hotel limit in london", None, None), (3, "hotel limit in London?", None, ["HR"]), (4, "hotel limit in London?", None, ["Sales"]), (5, "How does photosynthesis work in plants?", None, ["*"]), (6, "What was the hotel limit in London in 2025?", None, None)],
        "query_id long, question string, history array<struct<role:string,content:string>>, departments array<string>",
    )
    got = {r.query_id: r for r in ask(asked, chunks, vectors).collect()}
    assert got[1].status == "answered" and "$250" in got[1].answer and got[1].answer.endswith("[1]")
    assert got[2].answer == got[1].answer
    assert got[3].status == "insufficient_evidence" and "250" not in got[3].answer
    assert got[4].status == "denied"
    assert got[5].status == "insufficient_evidence"
    assert "$200" in got[6].answer
    base = {r.query_id: r for r in ask(asked, chunks, vectors, Settings(profile="baseline")).collect()}
    assert base[1].status == "answered"


def test_model_hooks_fall_back(spark):
    from larkspur.operators import hooks
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, p string")
    got = {r.id: r.reply for r in hooks.complete(rows, F.col("p"), lambda prompts: [None if p == "c" else p.upper() for p in prompts]).collect()}
    assert got == {1: "A", 2: None, 3: None}
    replies = spark.createDataFrame([(1, '```json\n{"scores": [{"id": 0, "score": 7}]}\n```'), (2, 'Sure: {"scores": [{"id": 1, "score": 3.5}]} ok'), (3, "no")], "id long, r string")
    parsed = {r.id: r.s for r in replies.select("id", hooks.rerank_scores(F.col("r")).alias("s")).collect()}
    assert parsed == {1: {0: 7.0}, 2: {1: 3.5}, 3: None}


@pytest.mark.parametrize("heads", [1, 10])
def test_hybrid_equals_whole_lists_ranked_and_fused(spark, monkeypatch, heads):
    """Heads and counted ranks against sorting both lists whole: ties, zero and null vectors, scopes, a question without words."""
    from larkspur.operators import search
    from pyspark.sql import functions as F

    monkeypatch.setattr(search, "HEADS", heads)
    rng = np.random.default_rng(5)
    made = rng.integers(-2, 3, (400, 4)).astype(float)  # few values, so many ties and zero vectors
    made[7] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in v], "abc"[i % 3]) for i, v in enumerate(made)] + [(900, None, "a"), (901, [], "b"), (902, [1.0], None)], "chunk_id long, vector array<double>, department string")
    scopes = [None, ["*"], ["a"], ["b", "c"], []]
    asked = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=4)], scopes[q]) for q in range(5)], "query_id long, vector array<double>, departments array<string>")
    allowed = lambda q, i: scopes[q] is None or "*" in scopes[q] or "abc"[i % 3] in scopes[q]
    words = [(q, int(i), float(rng.integers(1, 40)) / 8) for q in range(1, 5) for i in rng.permutation(400)[:300] if allowed(q, i)]
    lexical = spark.createDataFrame(words, "query_id long, chunk_id long, score double")
    dense = search.cosine(asked.drop("departments"), vectors.drop("department")).join(asked.select("query_id", "departments"), "query_id").join(vectors.select("chunk_id", "department"), "chunk_id")
    dense = dense.filter(F.col("departments").isNull() | search.in_scope(F.col("departments"), F.col("department"))).select("query_id", "chunk_id", "score")
    for k in (1, 20):
        got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.rrf, 12), r.keyword_score, None if r.vector_score is None else round(r.vector_score, 9)) for r in search.hybrid(lexical, asked, vectors, k).collect()}
        scores = [{(r.query_id, r.chunk_id): r.score for r in side.collect()} for side in (lexical, dense)]
        places = [{(r.query_id, r.chunk_id): r["rank"] for r in search.ranked(side).collect()} for side in (lexical, dense)]
        want = {}
        for q in range(5):
            keys = {key for side in scores for key in side if key[0] == q}
            rrf = {key: sum(1 / (60 + side[key]) for side in places if key in side) for key in keys}
            for rank, key in enumerate(sorted(keys, key=lambda key: (-round(rrf[key], 12), key[1]))[:k], 1):
                near = scores[1].get(key)
                want[q, rank] = (key[1], round(rrf[key], 12), scores[0].get(key), None if near is None else round(near, 9))
        assert got == want and len(got) == 4 * k


def test_mean_latency_on_a_half_does_not_depend_on_row_order(spark):
    from larkspur.operators import evaluate

    # the mean is 1.35 exactly; doubles summed in turn give 1.3499999999999999 or less
    values = [0.1] * 5 + [7.6]
    tied = {f"{k}{s}": [s * v for v in (values if k == "up" else values[::-1])] for k in ("up", "down") for s in (1, -1)}
    rows = [(k, v) for k, vs in tied.items() for v in vs] + [("null", None), ("large", 1e300), ("large", 1e300), ("nan", float("nan")), ("some", None), ("some", 2.25)]
    found = {r.id: r.latency_ms for r in evaluate.latency_repeats(spark.createDataFrame(rows, "id string, latency_ms double").coalesce(1)).collect()}
    assert [found[k] for k in ("up1", "down1", "up-1", "down-1")] == [1.4, 1.4, -1.4, -1.4]
    assert found["null"] is None and found["large"] == 1e300 and found["nan"] != found["nan"] and found["some"] == 2.3


def test_ask_benchmark_reads_the_kept_index_and_vectors(spark, sf_dir):
    from larkspur.operators import embed
    from larkspur.plans.ask import ask
    from larkspur.plans.fixtures import described, table
    from pyspark.sql import functions as F

    found = QUERIES["ask_benchmark"](spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert "larkspur-lexical" in plan and "larkspur-vectors" in plan
    d = described(spark, sf_dir).withColumn("cid", F.col("doc_id")).withColumn("version", F.lit(None).cast("string")).withColumn("embed_text", F.col("text")).drop("chunk_id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("history"), F.lit(None).cast("array<string>").alias("departments"))
    plain = ask(asked, d, embed.embed_texts(d.select("cid", "text"), "cid")).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_latency_repeats_equals_its_sql_on_halves(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # the exact mean is 1.35; which side the sum of doubles falls to depends on the order of rows
    values = [0.1] * 5 + [7.6]
    groups = {1: values, 2: values[::-1], 3: [-v for v in values], 4: [-v for v in values[::-1]], 5: [54.35 - 7e-15], 6: [None], 7: [1e300, 1e300, None], 8: [float("nan")], 9: [5e307], 10: [2.25, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    pq.write_table(pa.table({"user_id": pa.array([k for k, _ in rows], pa.int64()), "value": pa.array([v for _, v in rows], pa.float64())}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = dict(con.sql(SQL["latency_repeats"]).fetchall())
    assert want[1] == 1.3  # not the half's own rounding
    found = {r.id: r.latency_ms for r in QUERIES["latency_repeats"](spark, str(tmp_path)).collect()}
    assert {k: str(v) for k, v in found.items()} == {k: str(v) for k, v in want.items()}


def test_latency_in_order_adds_blocks_in_their_order(spark):
    from larkspur.operators import evaluate

    rows = [("a", 1e16, "f", 0), ("a", 1.0, "f", 8), ("a", -1e16, "g", 0), ("b", 1e16, "f", 0), ("b", -1e16, "f", 8), ("b", 1.0, "g", 0), ("c", None, "f", 0), ("c", 3.0, "g", 0)]
    for some in (rows, rows[::-1]):
        runs = spark.createDataFrame(some, "id string, latency_ms double, file string, block long")
        assert {r.id: r.latency_ms for r in evaluate.latency_repeats_in_order(runs).collect()} == {"a": 0.0, "b": 0.3, "c": 3.0}


def test_embedding_is_the_sum_over_its_features():
    import hashlib
    import math

    from larkspur.operators import embed

    # 4-grams are counted and hashed as numbers; the vector is that of the features, to the last bit
    for text in (None, "", "ab", "abc", "abcd", "\u212a \u00e9 $5.00, 10% of A_b", "it is " * 9000 + "so. " * 3):
        for width in (16, 768):
            want = np.zeros(width)
            for name, weight in embed.features(text or "").items():
                value = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
                want[(value >> 1) % width] += (1.0 if value & 1 else -1.0) * (1.0 + math.log(weight + 1.0))
            norm = math.sqrt(float(want @ want))
            assert np.array_equal(embed.embed(text, width), want / norm if norm else want)


def test_ask_is_planned_in_small_parts(spark):
    from larkspur.plans.ask import ask

    fields = "cid long, doc_id string, text string, embed_text string, title string, section_path string, department string, doc_type string, effective_date string, version string, is_current boolean"
    chunks = spark.createDataFrame([(1, "a.pdf", "The limit is $250.", "The limit is $250.", "Travel", "2. Hotels", "Finance", "policy", "2026-01-01", "2", True)], fields)
    asked = spark.createDataFrame([(1, "What is the limit?", None, None)], "query_id long, question string, history array<struct<role:string,content:string>>, departments array<string>")
    found = ask(asked, chunks, spark.createDataFrame([(1, [1.0] * 768)], "cid long, vector array<double>"))
    # uncut, every step repeats all those before it: 9874 lines
    lines = len(found._jdf.queryExecution().analyzed().toString().splitlines())
    assert lines < 3000
    assert [r.query_id for r in found.collect()] == [1]
