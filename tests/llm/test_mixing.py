import random
import re

import pytest
from larkspur.llm import mixing

SCHEMA = "doc_id long, text string, source string, target int, mix_source int"


def rows(n=3000):
    r = random.Random(1)
    out = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "c", "Z", "é", None])
        out.append((i, " ".join(["w"] * r.randint(0, 60)), source, 1, 2))
    return [*out, (n, None, "a", 1, 2), (n + 1, "", None, 1, 2), (None, "x y", "b", 1, 2), (5, "x y", "b", 1, 2)]


def water(sizes):
    """Targets by reshaping the excess again and again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t = [1.5 * sum(sizes) * w / sum(weights) for w in weights]
    for _ in range(1000):
        over = [i for i in range(len(t)) if t[i] > 2 * sizes[i] + 1e-9]
        if not over:
            break
        excess = sum(t[i] - 2 * sizes[i] for i in over)
        for i in over:
            t[i] = 2.0 * sizes[i]
        free = [i for i in range(len(t)) if t[i] < 2 * sizes[i] - 1e-9]
        for i in free:
            t[i] += excess * weights[i] / sum(weights[j] for j in free)
    return t


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    found = mixing.mixed_sizes(df).collect()
    assert len(found) == len(data)
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    want = dict(zip(names, water([sizes[s] for s in names]), strict=True))
    by_target = {round(t, 6) for t in want.values()}
    assert {round(r.target, 6) for r in found} == by_target
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    source_of = {i: s for i, _, s, *_ in data}
    taken = {}
    for r in found:
        s = "b" if r.doc_id is None else source_of[r.doc_id]
        if r.doc_id != 5:
            taken[s] = taken.get(s, 0) + r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 130, s
    again = mixing.mixed_sizes(df.repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


def test_mix_repeats_rows(spark):
    data = [(i, "a b c", "only", 1, 2) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == 600 and out.select("doc_id").distinct().count() == 400


@pytest.mark.parametrize("data", [[], [(1, None, None, 1, 2)], [(1, "", "a", 1, 2), (1, "", "a", 1, 2)]])
def test_without_words(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    found = mixing.mixed_sizes(df).collect()
    assert len(found) == len(data) and all(r.taken == 0 and r.target == 0.0 for r in found)
    assert mixing.mix(df).columns == df.columns


def test_all_alike(spark):
    """Repeated rows share one hash: the source comes as near as one lump allows."""
    df = spark.createDataFrame([(7, "a b", "s", 1, 2)] * 50, SCHEMA)
    assert {r.taken for r in mixing.mixed_sizes(df).collect()} <= {2, 4}
