import numpy as np
from larkspur.llm import vectors


def brute(rows, cosine=0.93):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        x = None if v is None or None in v or label is None else np.array(v, float)
        unit.append(x / np.linalg.norm(x) if x is not None and len(x) and np.isfinite(x).all() and x @ x > 0 else None)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        low[root(i)] = min(rows[i][0], low.get(root(i), rows[i][0]))
    return sorted((rows[i][0], links[i], low[root(i)]) for i in range(n))


def cases():
    r = np.random.default_rng(0)
    rows, i = [], 0
    for label in (0, 1):
        for size in (1, 2, 5, 60):
            centre = r.standard_normal(16)
            for _ in range(size):
                rows.append((i, (centre + 0.05 * r.standard_normal(16)).astype(np.float32).tolist(), label))
                i += 1
    copy = rows[3][1]
    rows += [(900, copy, 0), (901, copy, 0), (902, copy, 1), (903, copy, None), (904, None, 0), (905, [0.0] * 16, 0), (906, [float("nan")] * 16, 0), (907, copy[:8], 0), (908, [None] * 16, 0), (909, [], 0), (910, [float("inf")] * 16, 1)]
    return rows


def test_matches_brute_force_with_small_windows_and_tiles(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    want = brute(rows)
    for window, tile in ((4, 7), (32, 2048)):
        found = vectors.near_duplicates(df, window=window, tile=tile, recall=0.9999).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_recall_on_the_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    want = {v: n for v, n, _ in brute(rows)}
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).collect()}
    assert found.keys() == want.keys()
    assert sum(found.values()) >= 0.9 * sum(want.values()) and all(found[v] <= want[v] for v in want)


def planted(r, n, centre_share):
    """Unit vectors around a common direction, and as many near pairs (cosine 0.93 to 0.95) as a fifth of them."""
    centre = r.standard_normal(64)
    centre *= np.sqrt(centre_share) / np.linalg.norm(centre)
    crowd = r.standard_normal((n, 64))
    crowd = centre + crowd * (np.sqrt(1 - centre_share) / np.linalg.norm(crowd, axis=1, keepdims=True))
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    near = []
    for x in crowd[: n // 5]:
        y = r.standard_normal(64)
        y -= (y @ x) * x
        c = r.uniform(0.9305, 0.95)
        near.append(c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    return np.concatenate((crowd, near)).astype(np.float32)


def test_passes_grow_until_recall_holds(spark):
    """Many more vectors in a label than a window, spread out or crowded: 0.9 of planted pairs at the threshold's edge."""
    r = np.random.default_rng(3)
    for share, window in ((0.0, 32), (0.6, 64)):
        x = planted(r, 4000, share)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
        found = {t.vec_id: t.component_id for t in vectors.near_duplicates(df, window=window).collect()}
        assert sum(found[4000 + i] == found[i] for i in range(800)) >= 0.9 * 800
        depths = vectors.passes_needed(np.array([0.0] * 16 + [100.0] + [0.0] * (vectors.BINS - 17)), 0.97)
        assert (1 - 2.0**-4) ** depths <= 0.03 < (1 - 2.0**-4) ** (depths - 1)


def test_hot_group_of_near_copies_and_small_partitions(spark):
    r = np.random.default_rng(5)
    hot = r.standard_normal(16) + 0.02 * r.standard_normal((300, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((hot, r.standard_normal((60, 16)))).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # fewer rows in a partition than in a window
    try:
        found = vectors.near_duplicates(df, window=50, tile=64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((t.vec_id, t.n_links, t.component_id) for t in found) == brute(rows)


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
