import numpy as np
import pytest
from larkspur.llm import bpe, tokencount
from larkspur.llm.queries import END_OF_DOCUMENT, tokenizer_path


def brute(ids, eod):
    counts, n = [], 0
    for i in ids:
        if i == eod:
            counts.append((n, True))
            n = 0
        else:
            n += 1
    return counts + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_stitching_equals_a_plain_scan(spark, block):
    r = np.random.default_rng(block)
    files = [r.choice([0, 0, 5, 9, 257], size=n) for n in (0, 1, 2, 50, 333)] + [np.array([0, 0, 0]), np.array([5] * 20), np.array([5] * 9 + [0])]
    rows = [(str(f), b, bytearray(ids[b * block : (b + 1) * block].astype("<u2").tobytes())) for f, ids in enumerate(files) for b in range(-(-len(ids) // block))]
    blocks = spark.createDataFrame(rows, "file string, block long, content binary")
    found = tokencount.document_counts(blocks, 0, block).orderBy("file", "ordinal").collect()
    want = [(str(f), k, n, closed) for f, ids in enumerate(files) for k, (n, closed) in enumerate(brute(ids.tolist(), 0))]
    assert [tuple(x) for x in found] == want


def test_documents_through_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["one two", None, "", "<|endoftext|> is text", "long " * 9000, "é 🙂"])] + [(None, "no id"), (2, "again"), (-5, "minus")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ordinal int").repartition(3)
    own = bpe.BpeTokenizer(bpe.read_tokenizer(tokenizer_path()), specials=False)
    found = tokencount.count_documents(docs, tokenizer_path(), END_OF_DOCUMENT, block=64).collect()
    want = sorted(((i, len(own.encode(t))) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == want
    # many volumes, and files of two records each: tokens and ids still belong together
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        found = tokencount.count_documents(docs, tokenizer_path(), END_OF_DOCUMENT, block=64, volume=6).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == want and len({r.file for r in found}) > 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count_documents(docs, tokenizer_path(), END_OF_DOCUMENT).count() == 0
