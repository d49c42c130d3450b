import hashlib
import re

from larkspur.llm import exact
from larkspur.llm.common import table
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, digest string, keep_id int"
ROWS = [(1, "a b", "x", 1), (2, "ab ", "x", 1), (3, "a\t\nb  ", "x", 1), (4, None, "x", 1), (5, "", None, 1), (6, " \x0b\x0c\r", "x", 1), (7, "a\u00a0b", "x", 1), (8, "z" * 200_000, "x", 1), (9, "z " * 200_000, "x", 1), (None, "ab", "x", 1), (2, "ab ", "x", 1)]


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for body, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert result(exact.exact_groups(docs)) == brute(ROWS)


def test_bytes_decide_when_digests_collide(spark):
    weak = lambda body: F.unhex(F.left(F.sha2(body, 256), F.lit(1)).cast("string"))  # noqa: E731  sixteen digests
    rows = [(i, f"text {i % 37}", "x", 1) for i in range(200)]
    found = exact.exact_groups(spark.createDataFrame(rows, SCHEMA), weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == sorted((d, k, n) for d, k, n, _ in brute(rows))


def test_levels_and_filters_of_several_batches(spark):
    rows = [(i, f"text {i % 40}", "x", 1) for i in range(120)] + [(500, None, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = exact.DigestIndex(spark, memtable=7, fan=2)
    for k in range(5):
        index.flush(docs.filter(F.col("doc_id") % 5 == k))
    assert [len(level) for level in index.levels] == [1, 0, 1]  # two flushes of a level make one of the next
    merged = {bytes(r.digest): (r.doc_id, r["size"]) for r in index.merged().collect()}
    want = {d: (k, n) for _, k, n, d in brute(rows)}
    assert {d.hex(): v for d, v in merged.items()} == want
    batch = spark.createDataFrame([(900, "text 3", "x", 1), (901, "te xt 3", "x", 1), (902, "new", "x", 1), (903, "", "x", 1)], SCHEMA)
    assert sorted((r.doc_id, r.keep_id) for r in index.known(batch).collect()) == [(900, 3), (901, 3), (903, 500)]


def test_filter_has_no_false_negative(spark):
    digests = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    own = exact.DigestFilter.of(digests.filter("id < 3000"), 3000)
    found = own.marked(digests, "in").groupBy((F.col("id") < 3000).alias("there"), "in").count().collect()
    counts = {(r.there, r["in"]): r["count"] for r in found}
    assert counts[True, True] == 3000 and (True, False) not in counts and counts[False, True] < 0.15 * 2000
    none = exact.DigestFilter.of(digests.limit(0), 0)
    assert none.marked(digests, "in").filter("in").count() == 0


def test_hot_group(spark):
    rows = [(i, "the same" if i < 600 else f"own {i // 2}", "x", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(exact.exact_groups(docs)) == brute(rows)
    assert sorted(r.doc_id for r in exact.drop_exact_duplicates(docs).collect()) == sorted({k for _, k, _, _ in brute(rows)})


def test_drop_when_digests_collide(spark):
    weak = lambda body: F.unhex(F.left(F.sha2(body, 256), F.lit(1)).cast("string"))
    rows = [(i, f"text {i % 37}", "x", 1) for i in range(200)] + [(5, "text 5", "x", 1)]
    kept = exact.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA), weak)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in brute(rows)})


def test_drop_keeps_one_row_of_each_group(spark):
    kept = exact.drop_exact_duplicates(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "digest", "keep_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(docs).count() == 0
    assert exact.drop_exact_duplicates(docs).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = exact.exact_groups(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
