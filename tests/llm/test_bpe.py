import random

import numpy as np
import pytest
from larkspur.llm import bpe
from larkspur.llm.queries import tokenizer_path
from tokenizers import Tokenizer

TEXTS = ["", None, " \n\t", "a<|endoftext|>b <|endoftext|> <|startoftext", "İstanbul ΣΑΣ Σ", "x\x1cy z q\u0085w", "don't I'LL we're 'S", "é ́a 가", "🙂🙂👍🏽 日本", "a" * 5000, "123 4٣ Ⅷ", "tab\tcr\r\nx", "ﬁ ŉ ǅ ẞ ß", "ab " * 3000]


@pytest.fixture(scope="module")
def file():
    return bpe.read_tokenizer(tokenizer_path())


def test_ids_and_text_equal_the_library(file):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abcdeé'1 <|>.日\n") for _ in range(r.randint(0, 80))) for _ in range(500)]
    own, library = bpe.BpeTokenizer(file), Tokenizer.from_str(file)
    for t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_special_strings_as_ordinary_text(file):
    library = Tokenizer.from_str(file)
    library.encode_special_tokens = True
    own = bpe.BpeTokenizer(file, specials=False)
    for t in TEXTS:
        assert own.encode(t) == library.encode(t or "", add_special_tokens=False).ids


def naive(symbols, merges):
    out = list(symbols)
    while True:
        best = min(((merges[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in merges), default=None)
        if best is None:
            return out
        i = best[1]
        out[i : i + 2] = [merges[out[i], out[i + 1]][1]]


def test_segment_tree_merges_the_leftmost_lowest():
    r = random.Random(4)
    for _ in range(300):
        merges, pairs = {}, [(a, b) for a in range(6) for b in range(6)]
        r.shuffle(pairs)
        for rank, p in enumerate(pairs[:12]):
            merges[p] = (rank, r.randrange(6, 9) if r.random() < 0.5 else r.randrange(6))
        word = [r.randrange(6) for _ in range(r.randint(1, 40))]
        assert bpe.merge_piece(word, merges) == naive(word, merges)


def test_trees_of_many_pieces_equal_one_tree_each():
    r = random.Random(5)
    for width in (2, 4, 8, 16, 32):
        merges, pairs = {}, [(a, b) for a in range(9) for b in range(9)]
        r.shuffle(pairs)
        for rank, p in enumerate(pairs[:30]):
            merges[p] = (rank, r.randrange(9))
        words = [[r.randrange(6) for _ in range(r.randint(1, width))] for _ in range(400)]
        rows = bpe.merge_together(np.array([w + [-1] * (width - len(w)) for w in words]), bpe.PairTable(merges))
        assert [[s for s in row if s >= 0] for row in rows.tolist()] == [naive(w, merges) for w in words]


def test_pair_table_finds_all_merges_and_no_other():
    r = random.Random(6)
    merges = {(r.randrange(50_000), r.randrange(50_000)): (k, r.randrange(50_000)) for k in range(5000)}
    table = bpe.PairTable(merges)
    asked = [*merges, *((r.randrange(50_000), r.randrange(50_000)) for _ in range(5000))]
    rank, made = table.find(*np.array(asked).T)
    assert [*zip(rank.tolist(), made.tolist(), strict=True)] == [merges.get(p, (bpe.NONE, -1)) for p in asked]


def test_memory_is_bounded_and_keeps_what_is_frequent(file, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    own, whole = bpe.BpeTokenizer(file), bpe.BpeTokenizer(file)
    texts = [" ".join([f"word{i}x{j}" for j in range(30)] + ["often", "y" * 100]) for i in range(20)]
    ids = [own.encode(t) for t in texts]
    assert len(own.young) < 50 + 32 and len(own.old) < 50 + 32 and "often" in own.young and "y" * 100 not in own.young
    monkeypatch.setattr(bpe, "MEMORY", 10**6)
    assert ids == [whole.encode(t) for t in texts] == [bpe.unpacked(i) for i in whole.encode_texts(texts)]


def test_tables(spark, file):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "x", 1)], "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_str(file)
    encoded = bpe.encode_documents(docs, tokenizer_path())
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert ids[3] == library.encode(TEXTS[3], add_special_tokens=False).ids and ids[1] == []
    texts = {r.doc_id: r.text for r in bpe.decode_documents(encoded, tokenizer_path()).collect()}
    assert texts[6] == library.decode(ids[6], skip_special_tokens=False)
    digests = bpe.round_trip_digests(docs, tokenizer_path()).collect()
    assert len(digests) == len(TEXTS) + 1 and {r.doc_id: r.n_tokens for r in digests} == {k: len(v) for k, v in ids.items()}
    assert bpe.round_trip_digests(docs.limit(0), tokenizer_path()).count() == 0
