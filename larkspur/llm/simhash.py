"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majorities over XXH64 of word shingles. Links are pairs of
fingerprints at Hamming distance ``radius`` (2) or less, found thus:

* equal fingerprints collapse first, so exact copies never meet each other again;
* the 64 bits are grouped into parts, correlated bits together (from the bit
  covariance over all distinct fingerprints);
* a part's threshold says how far two fingerprints may differ inside it to become
  candidates. Pigeonhole: thresholds of m parts that sum to ``radius - m + 1`` miss
  no pair (-1 leaves a part out). Dynamic programming picks the cheapest allocation
  over estimated candidate counts, for two and for three parts;
* each fingerprint probes the buckets within its threshold, and candidates are
  verified on all 64 bits. Buckets up to ``bucket_limit`` fingerprints are verified
  in place and emit a spanning forest, not pairs;
* the fingerprints of larger buckets take an exact way that is linear in their
  number: each is sent to its 64 one-bit neighbours and itself. Two fingerprints
  are within distance 2 if and only if they meet there, so a star per meeting
  point links them all without any pair enumeration.

Components follow by star contraction over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SEED = 42
BITS = 64
PROBE_COST, VERIFY_COST = 1.0, 0.05
#: A fingerprint is hot with more than this share of all rows, and at least so many.
HOT_SHARE, HOT_LEAST = 0.001, 64


# --- fingerprints -----------------------------------------------------------------


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for a text without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- parts and thresholds -----------------------------------------------------------


def bit_covariance(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit, and the bits' absolute correlation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64)), pa.array(np.full(len(i), n, np.int64))], names=["i", "j", "c", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i int, j int, c long, n long").groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # 2080 rows at any size
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.c
        n = r.n
    if not n:
        return 0, np.full(BITS, 0.5), np.zeros((BITS, BITS))
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def bit_parts(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near-equal width; each grows by the bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS - sum(map(len, parts))) // (m - k)
        part = [max(sorted(free), key=lambda b: sum(correlation[b, c] for c in free if c != b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in part))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return int(np.array([sum(1 << b for b in part)], np.uint64).view(np.int64)[0])


def _signed(bit: int) -> int:
    return (1 << bit) if bit < 63 else -(1 << 63)


def candidate_costs(n: int, p: np.ndarray, part: list[int], meeting: float, radius: int) -> list[float]:
    """Estimated cost of a part at thresholds -1, 0 .. radius.

    ``meeting`` is the measured number of pairs that agree on the whole part;
    pairs at distance 1, 2 .. follow from it by the bits' shares of ones.
    """
    near = np.zeros(radius + 1)
    near[0] = 1.0
    for b in part:
        agree = max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-6)
        near[1:] = near[1:] + near[:-1] * (1 - agree) / agree  # odds against the pairs that agree
    floor = max(meeting, n * n / 2 * float(np.prod([p[b] ** 2 + (1 - p[b]) ** 2 for b in part])))
    costs, probes, choose = [0.0], 0.0, 1.0
    for t in range(radius + 1):
        probes += choose
        choose = choose * (len(part) - t) / (t + 1)
        costs.append(PROBE_COST * n * probes + VERIFY_COST * floor * float(near[: t + 1].sum()))
    return costs


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Cheapest thresholds, one per part, that sum to ``radius - m + 1`` (dynamic programming)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                option = (cost + part[t + 1], [*chosen, t])
                if total + t not in grown or option < grown[total + t]:
                    grown[total + t] = option
        best = grown
    return best[radius - len(costs) + 1]


def plan_parts(distinct: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds that cost least, of two and three parts."""
    n, p, correlation = bit_covariance(distinct)
    layouts = [bit_parts(correlation, m) for m in (2, 3)]
    flat = [part for layout in layouts for part in layout]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("v")) for k, part in enumerate(flat)])
    counts = distinct.select(F.inline(keys)).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    meeting = {r.k: float(r.pairs or 0) for r in counts.groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    choices, at = [], 0
    for layout in layouts:
        cost, thresholds = allocate([candidate_costs(n, p, part, meeting.get(at + k, 0.0), radius) for k, part in enumerate(layout)], radius)
        choices.append((cost, layout, thresholds))
        at += len(layout)
    _, layout, thresholds = min(choices, key=lambda c: c[0])
    return layout, thresholds


# --- probe and verify ----------------------------------------------------------------


def probes(distinct: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, value, fp): every bucket that a fingerprint's part reaches within its threshold."""
    rows = []
    for k, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        flips = [0] if t >= 0 else []
        if t >= 1:
            flips += [_signed(b) for b in part]
        if t >= 2:
            flips += [_signed(a) ^ _signed(b) for i, a in enumerate(part) for b in part[:i]]
        own = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        rows += [F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(f)).alias("value")) for f in flips]
    return distinct.select("fp", F.inline(F.array(*rows)))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Verified links that span what is within ``radius``, of one bounded bucket."""
    left = fps.view(np.uint64)
    apart = np.bitwise_count(left[:, None] ^ left[None, :]) <= radius
    unseen, out = set(range(len(fps))), []
    while unseen:
        root = min(unseen)
        unseen.discard(root)
        stack = [root]
        while stack:
            at = stack.pop()
            for other in [o for o in np.flatnonzero(apart[at]).tolist() if o in unseen]:
                unseen.discard(other)
                stack.append(other)
                out.append((int(fps[at]), int(fps[other])))
    return out


def verified_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows with a bounded array ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for fps in batch.column(0).to_pylist() for e in _forest(np.array(fps, np.int64), radius)]
            yield pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Like ``_forest`` for a bucket of any size: memory is linear, and texts that are linked are not compared again."""
    rest, left, out = np.arange(len(fps)), fps.view(np.uint64), []
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(left[rest] ^ left[at]) <= radius
            if near.any():
                found = rest[near].tolist()
                rest = rest[~near]
                stack += found
                out += [(int(fps[at]), int(fps[o])) for o in found]
    return out


def wide_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: edges with the components of all pairs within ``radius``, 1 to 31.

    Pigeonhole: of ``radius + 1`` parts two such fingerprints share one. A bucket is compared
    in one task, which is quadratic in its different, unlinked fingerprints: for n of them
    about ``(radius + 1) / 2 ** (64 / (radius + 1))`` of all pairs.
    """
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    parts = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(list(range(a, b))))).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    buckets = distinct.select("fp", F.inline(F.array(*parts))).groupBy("part", "value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column(0):
                found = _spanning(fps.values.to_numpy(), radius)
                yield pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long").distinct()


def meeting_points(fps: DataFrame) -> DataFrame:
    """Exact links at distance 2 or less, by a star per one-bit neighbour."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(b)).cast("long") for b in range(BITS)])
    points = fps.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("point"))
    low = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("point", "low")
    return points.join(low, "point").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(distinct: DataFrame, radius: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: edges with the components of all pairs within ``radius``."""
    if not 0 <= radius <= 2:
        raise ValueError("the exact way for large buckets covers distances up to 2")
    parts, thresholds = plan_parts(distinct, radius)
    rows = probes(distinct, parts, thresholds)
    size = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    placed = rows.join(size, ["part", "value"])
    small = placed.filter(F.col("size") <= bucket_limit).groupBy("part", "value").agg(F.collect_list("fp").alias("fps"))
    large = placed.filter(F.col("size") > bucket_limit).select("fp").distinct()
    return verified_links(small, radius).unionByName(meeting_points(large) if radius == 2 else meeting_points(large).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs`` (doc_id, text, ...).

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows keep their repeats. A null doc_id keeps its row and never names a
    component unless nothing else is in it (component_id is then null). An empty
    table gives an empty result; other columns of any name are ignored.
    """
    prints = cut(fingerprints(docs, size))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")))
    roots = cut(components(links(distinct.select("fp"), radius, bucket_limit))).select(F.col("node").alias("fp"), "root")
    low = distinct.join(roots, "fp").groupBy("root").agg(F.min("low").alias("linked"))
    named = distinct.join(roots.join(low, "root").select("fp", "linked"), "fp", "left").select("fp", F.coalesce("linked", "low").alias("component_id"))
    # fingerprints of more than a thousandth of the rows are fewer than a thousand: they are broadcast, so no task gets a hot one
    limit = max(HOT_LEAST, HOT_SHARE * (distinct.agg(F.sum("rows")).first()[0] or 0))
    hot = F.broadcast(distinct.filter(F.col("rows") > limit).select("fp"))
    large = prints.join(hot, "fp", "left_semi").join(F.broadcast(named.join(hot, "fp", "left_semi")), "fp")
    rest = prints.join(hot, "fp", "left_anti").join(named.join(hot, "fp", "left_anti"), "fp")
    return rest.unionByName(large).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
