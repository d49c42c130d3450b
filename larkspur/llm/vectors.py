"""Near-duplicate vectors by sorted projection passes.

* Vectors of one label with the same components collapse to one with a count, so a
  common vector is one row from there on.
* A pass sorts all vectors by label and the concatenated signs of random projections
  (range partitioned, each partition sorted), and compares each vector with the
  ``window`` ones before it. What is shuffled is a sketch, one byte a component, with the
  length of its rounding error: most cosines are settled by it for certain, the few
  that are too near ``cosine`` are verified on the whole vectors. Rows at a
  partition's start meet the ends of those before it in a second, small step. Only a
  spanning forest of a partition's links goes on.
* Projections go through the label's centre, since mates of a label may share a
  direction. Labels with no more vectors than a window have one pass, which compares
  all of them. The others have ``first`` passes, in which each vector's depth is
  measured: the bits that it shares with the row a window away. Two vectors at the
  threshold that share as many bits meet in that pass, and the chance of that follows
  from their angle; the label gets as many further passes as bring the expected share of
  such pairs to ``recall``. So passes grow with a label's size and density. (Vectors
  that are linked with half of their window are in the thick of a component and
  don't count there.) Where the passes would compare more pairs than the label has, its
  vectors are compared with each other by tiles instead, without a miss.
* Components are the union over all passes.
* Inside each component, links are counted exactly by tiles: a component of more than
  ``tile`` vectors is cut into blocks, and block pairs are separate tasks that add up
  counts and never emit pairs. What the windows cannot hold of a large group is
  counted there, so there is no cap on partners. The work is quadratic in the number of
  different vectors of one component.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut
from .components import components

SEED = 20_240_501
HASH_BITS = 40
#: Rows compared with their windows by one matrix product.
BLOCK = 1024
#: Room for the rounding of single-precision products.
ROUNDING = 1e-5
#: Centres of labels are broadcast up to so many bytes.
BROADCAST_BYTES = 1 << 25
#: Steps a halving of the chance to meet is divided into, and their number.
FINE, BINS = 4, 160
SURE, MAYBE, EDGE, SIZE, DEPTH = range(5)


def unit_rows(blobs: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def stored_kind(rows: DataFrame) -> str:
    """How components are kept: single precision if that is what the table has."""
    own = rows.schema["embedding"].dataType
    return "<f4" if isinstance(own, ArrayType) and isinstance(own.elementType, FloatType) else "<f8"


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, grp, vkey, vec): grp is label and width, vec the components, vkey a digest of both; null if the vector links with nothing."""
    kind = stored_kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()  # null components become NaN
            groups, keys, vecs = [], [], []
            for i, (label, there) in enumerate(zip(batch.column(1).to_pylist(), lists.is_valid().to_pylist(), strict=True)):
                row, name = None, None
                if label is not None and there:
                    x = flat[offsets[i] : offsets[i + 1]] + 0.0
                    norm = x @ x
                    if norm > 0 and math.isfinite(norm):
                        row, name = x.astype(kind).tobytes(), f"{label}/{len(x)}"
                groups.append(name)
                keys.append(None if row is None else hashlib.blake2b(name.encode() + b"\0" + row, digest_size=16, person=b"vector").digest())
                vecs.append(row)
            yield pa.record_batch([batch.column(0), pa.array(groups, pa.string()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "grp", "vkey", "vec"])

    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return picked.mapInArrow(run, "vec_id long, grp string, vkey binary, vec binary")


# --- projection --------------------------------------------------------------------------


def centres(distinct: DataFrame, kind: str, window: int) -> DataFrame:
    """(grp, n, centre) of the labels with more vectors than a window: their mean unit vector."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def table() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([*sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["grp", "n", "total"])
            sums.clear()
            return out

        for batch in batches:
            names, vecs = (c.to_pylist() for c in batch.columns)
            own: dict[str, list[bytes]] = {}
            for name, vec in zip(names, vecs, strict=True):
                own.setdefault(name, []).append(vec)
            for name, rows in own.items():
                n, total = sums.get(name, (0, 0.0))
                sums[name] = [n + len(rows), total + unit_rows(rows, kind).sum(axis=0)]
            if len(sums) > 4096:
                yield table()
        yield table()

    def whole(key: tuple, rows: pa.Table) -> pa.Table:
        n = sum(rows["n"].to_pylist())
        if n <= window:
            return rows.schema.empty_table().rename_columns(["grp", "n", "centre"])
        mean = sum(np.frombuffer(t, np.float64) for t in rows["total"].to_pylist()) / n
        return pa.table({"grp": [key[0].as_py()], "n": pa.array([n], pa.int64()), "centre": pa.array([mean.tobytes()], pa.binary())})

    return distinct.select("grp", "vec").mapInArrow(partial, "grp string, n long, total binary").groupBy("grp").applyInArrow(whole, "grp string, n long, centre binary")


def _agreement(unit: np.ndarray, middle: np.ndarray, cosine: float) -> np.ndarray:
    """Chance that a vector and one at the threshold, in a direction of no account, fall on the same side of a plane through the centre."""
    along, size = (unit * middle).sum(axis=1), (middle * middle).sum(axis=1)
    inner = cosine - (1 + cosine) * along + size
    lengths = np.sqrt(np.maximum((1 - 2 * along + size) * (1 - 2 * cosine * along + size), 1e-24))
    return np.maximum(0.5, 1 - np.arccos(np.clip(inner / lengths, -1, 1)) / np.pi)


def projected(vectors: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(pass, grp, hash, node, body): vectors (node, grp, vec, centre, lo, hi) in passes lo to hi - 1; without centre, hash 0.

    ``body``: single-precision scale, rounding error and chance that a pair at the
    threshold agrees on a bit, then a byte per component.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        powers = (1 << np.arange(HASH_BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            nodes, groups, vecs, middles, los, his = (c.to_pylist() for c in batch.columns)
            alike: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(groups, los, his, strict=True)):
                alike.setdefault(key, []).append(i)
            for (name, lo, hi), rows in alike.items():
                unit = unit_rows([vecs[i] for i in rows], kind)
                scale = np.abs(unit).max(axis=1) / 127
                coded = np.rint(unit / scale[:, None]).astype(np.int8)
                error = np.sqrt(((unit - coded * scale[:, None]) ** 2).sum(axis=1))
                middle = middles[rows[0]]
                rest = unit - np.frombuffer(middle, np.float64) if middle is not None else unit
                agree = _agreement(unit, unit - rest, cosine)
                head = np.column_stack((scale, error, agree)).astype("<f4")
                body = pa.array([h.tobytes() + c.tobytes() for h, c in zip(head, coded, strict=True)], pa.binary())
                same, own = pa.array([name] * len(rows), pa.string()), pa.array([nodes[i] for i in rows], pa.int64())
                for k in range(lo, hi):
                    width = unit.shape[1]
                    if (width, k) not in planes:
                        planes[width, k] = np.random.default_rng((SEED, width, k)).standard_normal((width, HASH_BITS))
                    hashes = (rest @ planes[width, k] >= 0) @ powers if middle is not None else np.zeros(len(rows), np.int64)
                    yield pa.record_batch([pa.array(np.full(len(rows), k), pa.int32()), same, pa.array(hashes, pa.int64()), own, body], names=["pass", "grp", "hash", "node", "body"])

    return vectors.select("node", "grp", "vec", "centre", "lo", "hi").mapInArrow(run, "pass int, grp string, hash long, node long, body binary")


# --- windows -----------------------------------------------------------------------------


class Strip:
    """Sorted rows of one pass and label: the last ``window`` ones, and which of them are linked so far."""

    def __init__(self, window: int, cosine: float):
        self.window, self.cosine = window, cosine
        self.sketch = None
        self.count = 0

    def add(self, nodes: np.ndarray, hashes: np.ndarray, bodies: list[bytes], compare_from: int = 0, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """Certain and possible links of further rows (at most ``BLOCK``) with their windows, and the rows' depth bins.

        Rows before ``compare_from`` are only kept as others' window; with it, rows
        behind it are not compared with each other. ``pairs`` says of places (in the order
        of all rows added) which pairs count.
        """
        raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), -1)
        scale, error, agree = raw[:, :12].copy().view("<f4").T
        sketch = raw[:, 12:].view(np.int8).astype(np.float32) * scale[:, None]
        old = 0
        if self.sketch is None:
            self.sketch, self.error, self.nodes, self.hashes, self.labels = sketch, error, nodes, hashes, np.arange(len(nodes))
        else:
            old = len(self.nodes)
            self.sketch, self.error = np.concatenate((self.sketch, sketch)), np.concatenate((self.error, error))
            self.nodes, self.hashes = np.concatenate((self.nodes, nodes)), np.concatenate((self.hashes, hashes))
            self.labels = np.concatenate((self.labels, np.arange(self.count, self.count + len(nodes))))
        self.count += len(nodes)
        first = max(old, compare_from)
        near = sketch[first - old :] @ (self.sketch if not compare_from else self.sketch[:compare_from]).T
        row, col = np.nonzero(near >= self.cosine - 2 * float(self.error.max()) - ROUNDING)
        at = row + first
        kept = (col < at) & (at - col <= self.window)
        if pairs is not None:
            gone = self.count - len(self.nodes)
            kept &= pairs(at + gone, col + gone)
        row, col, at = row[kept], col[kept], at[kept]
        value, band = near[row, col], self.error[at] + self.error[col] + ROUNDING
        certain = value >= self.cosine + band
        possible = ~certain & (value >= self.cosine - band)
        sure = self._joined(at[certain], col[certain])
        maybe = [(i, j) for i, j in zip(at[possible].tolist(), col[possible].tolist(), strict=True) if self.labels[i] != self.labels[j]]
        places = np.arange(first, len(self.nodes))
        linked = np.bincount(at[certain] - first, minlength=len(places)) if len(at) else np.zeros(len(places), np.int64)
        deep = places >= self.window
        other = self.hashes[np.maximum(places - self.window, 0)]
        shared = HASH_BITS - np.ceil(np.log2((self.hashes[places] ^ other).astype(np.float64) + 1)).astype(np.int64)
        odds = -np.log2(np.maximum(agree[first - old :], 1e-9)) * (np.minimum(shared, HASH_BITS - 1) + 1)
        bins = np.where(deep, np.minimum(np.ceil(odds * FINE), BINS - 1), 0).astype(np.int64)[linked * 2 < self.window]
        name = self.nodes
        found = [(int(name[i]), int(name[j])) for i, j in sure], [(int(name[i]), int(name[j])) for i, j in maybe], bins
        if len(self.nodes) > self.window and not compare_from:
            for k in ("sketch", "error", "nodes", "hashes", "labels"):
                setattr(self, k, getattr(self, k)[-self.window :])
        return found

    def _joined(self, at: np.ndarray, col: np.ndarray) -> list[tuple[int, int]]:
        """Of these links, in order of ``at``, those that join something new."""
        out, labels = [], self.labels
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False):
            i, others = int(at[lo]), col[lo:hi]
            theirs = labels[others]
            while len(strange := np.flatnonzero(theirs != labels[i])):
                j = int(others[strange[0]])
                out.append((i, j))
                labels[labels == labels[i]] = labels[j]
                theirs = labels[others]
        return out


def pass_links(rows: DataFrame, window: int, cosine: float) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Links (kind, a, b) of neighbours in the sorted order, and the vectors of each label by depth bin (labels with a centre)."""
    spark = rows.sparkSession
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("pass", pa.int32()), ("grp", pa.string()), ("body", pa.binary())])

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[k] for f in found], schema.field(k).type) for k in range(len(schema))], schema=schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                passes, names, hashes, nodes, bodies = batch.slice(at, BLOCK).columns
                passes, names, bodies = passes.to_numpy(), names.to_pylist(), bodies.to_pylist()
                hashes, nodes = hashes.to_numpy(), nodes.to_numpy()
                edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or passes[i] != passes[i - 1]), len(names)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    yield (int(passes[lo]), names[lo]), hashes[lo:hi], nodes[lo:hi], bodies[lo:hi]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, head, last, strip, own = TaskContext.get().partitionId(), 0, [], [], None, None
        depths: dict[str, np.ndarray] = {}
        for key, hashes, nodes, bodies in segments(batches):
            if key != own:
                own, strip = key, Strip(window, cosine)
            sure, maybe, bins = strip.add(nodes, hashes, bodies)
            if hashes.any():
                depths[key[1]] = depths.get(key[1], 0) + np.bincount(bins, minlength=BINS)
            listed = [(int(n), count + i, *key, b) for i, (n, b) in enumerate(zip(nodes, bodies, strict=True))]
            if len(head) < window:
                head += listed[: window - len(head)]
            last = (last + listed)[-window:]
            count += len(nodes)
            if sure or maybe:
                yield table([(SURE, a, b, None, None, None, None, None) for a, b in sure] + [(MAYBE, a, b, None, None, None, None, None) for a, b in maybe])
        # the first rows meet the ends of the partitions before, the last rows the starts of the next
        ends = [(EDGE, n, None, part, at, k, g, b) for at, (n, _, k, g, b) in {row[1]: row for row in (*head, *last)}.items()]
        counted = [(DEPTH, k, int(c), None, None, None, g, None) for g, bins in depths.items() for k, c in enumerate(bins) if c]
        yield table([*ends, *counted, (SIZE, None, None, part, count, None, None, None)])

    def edge(key: tuple, rows: pa.Table) -> pa.Table:
        """Links across partitions whose earlier row lies in this stretch of the whole order."""
        stretch, found = key[0].as_py(), []
        own: dict[tuple, list] = {}
        for row in sorted(zip(*(rows[c].to_pylist() for c in ("pass", "grp", "place", "part", "a", "body")), strict=True)):
            own.setdefault(row[:2], []).append(row[2:])
        for alike in own.values():
            place, part = np.array([r[0] for r in alike]), np.array([r[1] for r in alike])
            if part[0] == part[-1]:
                continue
            here, strip = place // (2 * window) == stretch, Strip(window, cosine)
            counts = lambda at, col, place=place, part=part, here=here: here[col] & (place[at] - place[col] <= window) & (part[at] != part[col])
            for at in range(0, len(alike), BLOCK):
                some = alike[at : at + BLOCK]
                sure, maybe, _ = strip.add(np.array([r[2] for r in some]), np.zeros(len(some), np.int64), [r[3] for r in some], pairs=counts)
                found += [(SURE, *p) for p in sure] + [(MAYBE, *p) for p in maybe]
        return pa.table({"kind": pa.array([f[0] for f in found], pa.int32()), "a": pa.array([f[1] for f in found], pa.int64()), "b": pa.array([f[2] for f in found], pa.int64())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "grp", "hash", "node"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(run, "kind int, a long, b long, part int, at long, pass int, grp string, body binary"))
    sizes = {r.part: r["at"] for r in found.filter(F.col("kind") == SIZE).select("part", "at").collect()}  # a row per partition
    links = found.filter(F.col("kind").isin(SURE, MAYBE)).select("kind", "a", "b")
    if sum(size > 0 for size in sizes.values()) > 1:
        parts = sorted(sizes)
        starts = spark.createDataFrame([*zip(parts, itertools.accumulate([sizes[p] for p in parts[:-1]], initial=0), strict=True)], "part int, start long")
        placed = found.filter(F.col("kind") == EDGE).join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("at"))
        # a row goes to its own stretch of two windows, and to the one before if that can reach it
        own = F.floor(F.col("place") / (2 * window)).cast("long")
        both = F.when((F.col("place") % (2 * window) < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        links = links.unionByName(placed.withColumn("stretch", F.explode(both)).select("stretch", "pass", "grp", "place", "part", "a", "body").groupBy("stretch").applyInArrow(edge, "kind int, a long, b long"))
    depths: dict[str, np.ndarray] = {}
    counted = found.filter(F.col("kind") == DEPTH).groupBy("grp", "a").agg(F.sum("b").alias("n"))
    for r in counted.collect():  # at most BINS rows for a label with more vectors than a window
        depths.setdefault(r.grp, np.zeros(BINS))[r.a] = r.n
    return links, depths


def whole_links(rows: DataFrame, cosine: float, tile: int) -> DataFrame:
    """Links (kind, a, b) among all vectors of each label, a task for each pair of blocks. ``rows``: (grp, n, node, body)."""

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        own, nodes, bodies = rows["own"].to_numpy(), rows["node"].to_numpy(), rows["body"].to_pylist()
        order, strip = np.argsort(own, kind="stable"), Strip(len(own), cosine)
        first = int((own == own.min()).sum()) if own.min() != own.max() else 0
        sure, maybe, _ = strip.add(nodes[order], np.zeros(len(own), np.int64), [bodies[i] for i in order], compare_from=first)
        return pa.table({"kind": pa.array([SURE] * len(sure) + [MAYBE] * len(maybe), pa.int32()), "a": pa.array([p[0] for p in sure + maybe], pa.int64()), "b": pa.array([p[1] for p in sure + maybe], pa.int64())})

    blocks = F.ceil(F.col("n") / tile).cast("int")
    placed = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    name = F.concat_ws("/", "grp", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    return placed.select(name.alias("tile"), "own", "node", "body").groupBy("tile").applyInArrow(link, "kind int, a long, b long")


def passes_needed(bins: np.ndarray, recall: float) -> int:
    """Passes after which the expected share of pairs at the threshold that met is ``recall``, from vectors by depth bin."""
    total = bins.sum()
    if not total:
        return 1
    chance = 2.0 ** (-np.arange(BINS) / FINE)
    missed = lambda k: float((bins * (1 - chance) ** k).sum() / total)
    low, high = 1, 1
    while missed(high) > 1 - recall:
        low, high = high, 2 * high
        if high > 1 << 40:
            return high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if missed(middle) <= 1 - recall else (middle + 1, high)
    return high


def verified(maybe: DataFrame, distinct: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Of the possible links (a, b) those whose whole vectors reach ``cosine`` in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                widths = [len(v) for v in part.column(2).to_pylist()]
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                hit = np.zeros(part.num_rows, bool)
                for width in set(widths):
                    own = [i for i, w in enumerate(widths) if w == width]
                    hit[own] = np.einsum("ij,ij->i", unit_rows([x[i] for i in own], kind), unit_rows([y[i] for i in own], kind)) >= cosine
                close.append(hit)
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(close) if close else np.zeros(0, bool)))

    bodies = distinct.select("node", "vec")
    both = maybe.join(bodies.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(bodies.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, kind: str, cosine: float, window: int, first: int, recall: float) -> DataFrame:
    """(a, b) over nodes: links with the components of what the passes find. ``distinct``: (node, grp, vec)."""
    spark = distinct.sparkSession
    middle = cut(centres(distinct, kind, window))
    held = middle.agg(F.sum(F.length("centre") + F.length("grp") + 32)).first()[0] or 0
    middle = F.broadcast(middle) if held <= BROADCAST_BYTES else middle
    joined = distinct.join(middle, "grp", "left").withColumn("lo", F.lit(0))
    found, depths = pass_links(projected(joined.withColumn("hi", F.when(F.col("centre").isNull(), 1).otherwise(first)), kind, cosine), window, cosine)
    further = [(g, k) for g, bins in depths.items() if (k := passes_needed(bins, recall)) > first]
    if further:
        goals = spark.createDataFrame(further, "grp string, goal long")
        goals = F.broadcast(goals) if held <= BROADCAST_BYTES else goals
        more = distinct.join(middle, "grp").join(goals, "grp").withColumn("whole", F.col("goal") * (2 * window) > F.col("n"))
        passed = more.filter("not whole").select("*", F.lit(first).alias("lo"), F.least("goal", F.lit((1 << 31) - 1)).cast("int").alias("hi"))
        tiled = more.filter("whole").select("*", F.lit(0).alias("lo"), F.lit(1).alias("hi"))
        found = found.unionByName(pass_links(projected(passed, kind, cosine), window, cosine)[0])
        bodies = projected(tiled, kind, cosine).join(middle.select("grp", "n"), "grp")
        found = found.unionByName(whole_links(bodies, cosine, max(window, BLOCK)))
    pairs = cut(found.select("kind", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a", "b").agg(F.min("kind").alias("kind")))
    sure = pairs.filter(F.col("kind") == SURE).select("a", "b")
    return sure.unionByName(verified(pairs.filter(F.col("kind") == MAYBE).select("a", "b"), distinct, kind, cosine))


# --- counts ------------------------------------------------------------------------------


def link_counts(members: DataFrame, kind: str, cosine: float, tile: int, total: int) -> DataFrame:
    """(node, linked): per vector the rows that it links with, its own copies left out.

    ``members``: (node, root, copies, vec), ``total`` of them.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "root").withColumn("own", own)
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small components share a task group, as many groups as hold about a tile each; a large one has a group per pair of blocks
    many = max(1, -(-total // tile))
    group = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(many)))).otherwise(
        F.concat_ws("/", F.col("root").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    )

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, linked = [], []
        roots, names, copies, owns = (rows[c].to_numpy() for c in ("root", "node", "copies", "own"))
        vecs = rows["vec"].to_pylist()
        order = np.argsort(roots, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            unit, times, own = unit_rows([vecs[i] for i in part], kind), copies[part], owns[part]
            low, high = own.min(), own.max()
            a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
            total = np.zeros(len(part), np.int64)
            for at in range(0, len(a), 1024):
                some = a[at : at + 1024]
                close = unit[some] @ unit[b].T >= cosine
                if low == high:
                    close[np.arange(len(some)), np.arange(at, at + len(some))] = False
                total[some] += close @ times[b]
                if low != high:
                    total[b] += times[some] @ close
            nodes.append(names[part])
            linked.append(total)
        return pa.table({"node": np.concatenate(nodes), "linked": np.concatenate(linked)})

    counted = tiles.select(group.alias("tile"), "root", "node", "copies", "own", "vec").groupBy("tile").applyInArrow(count, "node long, linked long")
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(rows: DataFrame, cosine: float = 0.93, window: int = 2048, first: int = 2, recall: float = 0.97, tile: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``rows`` (vec_id, embedding, label, ...).

    Rows link if labels are equal and not null and the cosine is at least ``cosine``.
    Vectors that are null, empty, zero or hold a null or non-finite component, and those
    of another width, link with nothing. Repeated rows are rows of their own that link
    with each other. A null vec_id names no component unless nothing else is in it. An
    empty table gives an empty result; other columns are ignored.
    """
    kind = stored_kind(rows)
    named = valid_vectors(rows)  # made twice from the table: cheaper than a copy on disk
    unique = named.filter("vec is not null").groupBy("vkey", "grp", "vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    distinct = cut(unique.withColumn("node", F.monotonically_increasing_id()))
    roots = cut(components(near_links(distinct.select("node", "grp", "vec"), kind, cosine, window, first, recall)))
    members = distinct.join(roots, "node")
    named_by = members.groupBy("root").agg(F.min("low").alias("component"))
    counts = link_counts(members.select("node", "root", "copies", "vec"), kind, cosine, tile, roots.count())
    inside = members.select("node", "root").join(named_by, "root").join(counts, "node").select("node", "component", "linked")
    facts = distinct.select("node", "vkey", "low", "copies").join(inside, "node", "left").select(
        "vkey", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")
    )
    own = named.select("vec_id", "vkey").join(facts, "vkey", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = own.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
