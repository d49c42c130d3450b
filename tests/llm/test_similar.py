import random
from fractions import Fraction

import pyarrow as pa
from larkspur.llm import simhash, similar
from larkspur.llm.queries import tokenizer_path
from pyspark.sql import functions as F


def jaccard(a, b, size=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    x, y = grams(a), grams(b)
    return Fraction(len(x & y), len(x | y)) if x | y else Fraction(0)


def brute(rows, least=Fraction(4, 5)):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= least:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows)) if root(i) == i)


def corpus():
    """Near copies around the threshold, a crowd of copies of one text, a passage that many share."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    passage = r.choices(words, k=40)
    out = ["one", "ONE", "two words", ""]
    for _ in range(25):
        base = r.choices(words, k=r.randint(20, 200))
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 30))):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy + r.choices(words, k=r.randint(0, 8))))
        out.append(" ".join(r.choices(words, k=60) + passage))
    crowd = r.choices(words, k=80)
    for _ in range(40):
        copy = list(crowd)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(80)] = r.choice(words)
        out.append(" ".join(copy))
    return list(enumerate(out))


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for limit, tile in ((128, 1024), (6, 16)):
        assert sorted(r.doc_id for r in similar.drop_near_copies(docs, bucket_limit=limit, tile=tile).collect()) == want


def test_the_stage_drops_near_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == brute(rows)


def test_repeated_and_missing_ids(spark):
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(900)}" for _ in range(100))
    near, other = f"{text} tail", " ".join(f"v{k}" for k in range(60))
    rows = [(1, text), (5, near), (5, other), (1, f"{text} end"), (None, text), (None, near), (7, "")]
    found = similar.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in found), key=str) == [1, 5, 7, None, None]
    assert (5, other) in [tuple(r) for r in found]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    found = similar.drop_near_copies(docs)
    assert found.columns == docs.columns and found.count() == 0


def test_simhash_finds_pairs_which_are_verified(spark):
    """Texts in pairs: a few words changed in 200, which SimHash alone finds, and unrelated ones, which it leaves."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, near = [], 0
    for k in range(60):
        base = r.choices(words, k=200)
        copy = list(base)
        copy[r.randrange(200)] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        near += (simhash.fingerprint(rows[-1][1].encode(), 5) ^ simhash.fingerprint(rows[-2][1].encode(), 5)).bit_count() <= similar.RADIUS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(p.a, p.b) for p in similar.fingerprint_pairs(docs, 5, similar.RADIUS).collect()}
    names = [similar._signed([similar.name(t.encode())])[0] for _, t in rows]
    pairs = {tuple(sorted(map(int, names[2 * k : 2 * k + 2]))) for k in range(60)}
    assert near > 40 and len(found & pairs) == near and len(found - pairs) <= 2


def test_wide_links_match_brute_force(spark):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = r.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))) for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for radius in (2, 7):
        edges = simhash.wide_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
        assert all(((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= radius for e in edges)
        parent = {f: f for f in signed}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            parent[root(e.a)] = root(e.b)
        assert all(root(a) == root(b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius)
        assert simhash.wide_links(spark.createDataFrame([], "fp long"), radius).count() == 0


def test_the_stage_links_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(simhash, "wide_links", lambda fps, radius, plain=simhash.wide_links: asked.append(radius) or plain(fps, radius))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert corpus_pipeline.distinct(spark, docs, "").count() == len(brute(corpus())) and asked == [similar.RADIUS]


def test_tasks_return_what_they_freed():
    from larkspur.llm import bpe
    from larkspur.llm.common import returned

    batch = pa.record_batch([pa.array(range(2500))], names=["k"])
    assert [b.num_rows for b in returned(lambda batches: batches)(iter([batch, batch.slice(0, 0)]))] == [1024, 1024, 452]
    own = bpe.tokenizer(bpe.read_tokenizer(tokenizer_path()))
    ids = own.encode("some words here")
    assert own.young
    own.forget()
    assert not own.young and not own.old and own.encode("some words here") == ids
