import random
import re

import numpy as np
import xxhash
from larkspur.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def brute_components(prints, radius=2):
    """prints: list of (doc_id, fingerprint)"""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [low.get(root(i)) for i in range(len(prints))]


def texts():
    r = random.Random(3)
    base = ["".join(r.choice("abcdé ÀB") for _ in range(200)) for _ in range(20)]
    out = [None, "", " \t\n", "one", "two words", "ÀÉ à\x85b\x1cc d", "word " * 5000]
    for b in base:
        out += [b, b, b.upper(), b + " tail", b.replace(" ", "\n\t")]
    return list(enumerate(out))


def test_matches_brute_force(spark):
    rows = texts()
    rows += [(3, "one"), (None, "two words")]  # a repeated row, and one without an id
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA.replace("component_id string", "component_id int"))
    found = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert sorted(map(tuple, found), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []


def test_links_are_exact_for_any_bucket_limit(spark):
    """Clusters of fingerprints near each other, so that buckets overflow and both ways run."""
    r = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(r.randint(0, 3)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    rows = sorted(prints)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in rows]
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_components(list(enumerate(rows)))
    for limit in (2, 8, 1000):
        edges = simhash.links(distinct, bucket_limit=limit).collect()
        index = {s: i for i, s in enumerate(signed)}
        parent = list(range(len(rows)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            assert (rows[index[e.a]] ^ rows[index[e.b]]).bit_count() <= 2
            a, b = root(index[e.a]), root(index[e.b])
            parent[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(rows))] == want


def test_thresholds_sum_by_the_pigeonhole_rule():
    for m in (2, 3, 4):
        _, thresholds = simhash.allocate([[0.0, 5.0 + k, 50.0, 500.0] for k in range(m)], 2)
        assert sum(thresholds) == 2 - m + 1
    # parts with many candidates are left out
    assert simhash.allocate([[0, 1, 9, 99], [0, 1, 9, 99], [0, 1000, 2000, 3000]], 2)[1][2] == -1


def test_parts_keep_correlated_bits_together():
    c = np.full((64, 64), 0.01)
    for a, b in ((1, 40), (7, 63)):
        c[a, b] = c[b, a] = 0.9
    parts = simhash.bit_parts(c, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({1, 40} <= set(p) for p in parts) and any({7, 63} <= set(p) for p in parts)


def test_hot_fingerprints_keep_all_rows(spark):
    rows = [(i, "the same text for all" if i < 300 else f"own words {i} and more {i * 7}") for i in range(400)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 400 and {r.component_id for r in found if r.doc_id < 300} == {0}
