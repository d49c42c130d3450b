import hashlib
import re

import numpy as np
import pytest
from larkspur.llm import pii
from larkspur.llm.common import table
from pyspark.sql import functions as F

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ROWS = [
    "a.b@c.d@e.f x@y.z_q@w.e", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111 1111 1111 1112", "+1 (456) 555-2186. +12 +123456789012345678 ++49 30 1234567",
    "é🙂 mail a@b.co é +49 (30) 123-4567-", "4111  1111 1111 1111", "1.2.3.4@x.y", "9" * 3000, "a" * 30000 + "@", "1 " * 9000, "x@" + "a." * 4000 + "b", "+" + "1 " * 3000, None, "", "reach me at jo.miller(at)mail[dot]com or (030) 555-1234", "card 4111.1111.1111.1111 on 2021-03-04 10",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pii.learn_model(table(spark, sf_dir, "documents"))


def test_base_matches_brute_force(spark, model):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(ROWS)] + [(0, ROWS[0], "k")], "doc_id long, text string, kind string")
    found = pii.span_digests(pii.find_spans(docs, model)).collect()
    assert len(found) == len(ROWS) + 1
    for r in found:
        want = brute(ROWS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (ROWS[r.doc_id] or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_parts_of_zeros_are_addresses(spark):
    rows = ["10.0.0.1 0.0.0.0 127.0.0.1", "8.8.8.0, 255.255.255.0; 000.00.0.255", "10.0.0.256 0.0.0.00300 1.2.3", "0" * 3000 + ".0.0.0", "0" * 3000 + "256.0.0.0"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in docs.select("doc_id", pii.strict_spans(F.col("text")).alias("found")).collect():
        assert [f"{s.kind}:{s.start}:{s.stop}" for s in r.found] == brute(rows[r.doc_id])


def test_method_adds_disguised_spans_and_leaves_lookalikes(spark, model):
    made = pii.generated_texts(rounds=40, seed=11)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    hit = false = total = 0
    for r in pii.find_spans(docs, model).collect():
        spans = made[r.doc_id][1]
        total += len(spans)
        every = [(c.start, c.stop) for c in [*r.strict, *r.added]]
        hit += sum(any(a < e and b > s for a, b in every) for s, e in spans)
        false += sum(not any(a < e and b > s for s, e in spans) for a, b in every)
    assert hit / total > 0.7
    assert false / max(hit, 1) < 0.05


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "é mail a@b.co, +49 (30) 123-4567 ok"), (2, None)], "doc_id long, text string")
    shown = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs, model)).collect()}
    assert shown == {1: "é mail [email], [phone] ok", 2: ""}


def test_trees_agree_in_both_forms(spark, model):
    rows = np.random.default_rng(1).integers(0, 20, (50, len(pii.FEATURES))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{f} double" for f in pii.FEATURES))
    got = df.select("i", model.column(F.struct(*pii.FEATURES)).alias("s")).orderBy("i").collect()
    assert np.allclose([r.s for r in got], model.scores(rows))


def test_native_and_empty(spark, model, sf_dir):
    found = pii.span_digests(pii.find_spans(table(spark, sf_dir, "documents"), model))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_base_of_a_whole_table_and_zero_parts(spark, model, sf_dir):
    zeros = ["10.0.0.1", "0.0.0.0", "host 192.168.0.1 and 8.8.8.0", "000.00.0.255", "0.0.0.256", "1.0.0.00000"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(zeros)], "doc_id long, text string"))
    found = {r.doc_id: r for r in pii.span_digests(pii.find_spans(docs, model)).collect()}
    for r in docs.collect():
        want = brute(r.text)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert found[r.doc_id].n_ip == sum(x.startswith("ip:") for x in want)


def test_the_model_counts_every_candidate_of_every_row(spark):
    """More rows and more proposals a row than any sample of the table held; rows without an id too."""
    text = " ".join(f"at 030-555-0{k:03d}" for k in range(100, 140)) + " mail "
    rows = [(None if k % 5 == 0 else k, f"row {k} {text}{'a' * (k % 30 + 1)}@b.co") for k in range(2500)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loose = spark.createDataFrame([(0, rows[0][1])], "doc_id long, text string")
    (one,) = pii.candidates(loose).collect()
    assert len(one.open) == 40 and len(one.strict) == 1
    vectors, n = pii.counted_vectors(docs)
    x, strict, side = pii._unpacked(vectors)
    assert n[strict == 0].sum() == 2500 * 40 and n[strict == 1].sum() == 2500
    assert 0.3 < n[side].sum() / n.sum() < 0.7 and set(x[:, 0]) == {0.0, 3.0}
    coarse, m = pii.counted_vectors(docs, most=1)
    assert m.sum() == n.sum() and len(coarse) < len(vectors) and not pii._unpacked(coarse)[0][:, 1:7].any()
    assert [len(a) for a in pii.counted_vectors(docs.filter("text = 'none'"))] == [0, 0]


def test_packed_vectors_hold_the_features(spark):
    rng = np.random.default_rng(4)
    rows = [[int(rng.integers(0, 1 << bits)) for bits in pii.WIDTHS.values()] for _ in range(30)]
    df = spark.createDataFrame([(*map(float, r), k % 2, k % 3 == 0) for k, r in enumerate(rows)], ", ".join(f"{f} double" for f in pii.FEATURES) + ", y int, s boolean")
    keys = np.array([r.v for r in df.select(pii._packed(F.struct(*pii.FEATURES), F.col("y"), F.col("s")).alias("v")).collect()])
    x, y, s = pii._unpacked(keys)
    assert x.astype(int).tolist() == rows and y.tolist() == [k % 2 for k in range(30)] and s.tolist() == [k % 3 == 0 for k in range(30)]


def test_weights_count_as_repeats():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 4, 400), *[rng.integers(0, 9, 400) for _ in pii.FEATURES[1:]]]).astype(float)
    y, seen, w = (x[:, 1] > 5).astype(float), rng.random(400) < 0.5, rng.integers(1, 4, 400)
    repeated = [np.repeat(a, w, axis=0) for a in (x, y, seen)]
    one, other = pii.fit(x, y, seen, w.astype(float)), pii.fit(*repeated, np.ones(w.sum()))
    assert np.allclose(one.scores(x), other.scores(x)) and np.allclose(one.thresholds, other.thresholds)
