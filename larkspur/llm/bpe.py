"""Byte-pair encoding with a segment tree over adjacent pair ranks, and decoding.

A piece's symbols sit at the leaves of a segment tree that holds the rank of each
adjacent pair; a node keeps the smallest rank below it and, at ties, the left one.
The root is the next merge. A merge changes three leaves, each a path of updates,
so a piece of n symbols costs O(n log n), long junk tokens included.

Short pieces are merged together: the trees of all new pieces of a group of texts are
the columns of one array, and a round takes every root, merges there and updates the
three paths of all trees at once. Longer pieces have a tree each.

The tokenizer file supplies vocabulary, merge ranks and special tokens. Its own
normaliser and splitter run on rare characters; plain Latin text takes an
equivalent shorter way. Space-separated chunks are remembered in two bounded
generations: when the young one is full it becomes the old one, and what is met again
moves back, so frequent chunks are never merged anew.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import returned

#: Chunks after which a generation of the memory ends (with the group of texts at hand).
MEMORY = 200_000
#: Chunks up to this length are remembered.
MEMORABLE = 64
#: Pieces up to this many symbols are merged together.
TOGETHER = 64
#: Pieces in one such array, and characters of text whose chunks are looked up together.
TREES, GROUP_CHARS = 1 << 14, 1 << 21
NONE = 1 << 60

_tokenizers: dict[str, BpeTokenizer] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merge_piece(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges, each the leftmost of lowest rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    lookup = merges.get
    leaves = 1 << (n - 2).bit_length()
    row = [NONE if m is None else m[0] * n + i for i, m in enumerate(map(lookup, zip(symbols, symbols[1:])))]  # rank * n + position: the smallest is the leftmost lowest
    row += [NONE] * (leaves - n + 1)
    rows = [row]
    while len(row) > 1:
        row = [a if a < b else b for a, b in zip(row[::2], row[1::2])]
        rows.append(row)
    tree = [NONE]
    for row in reversed(rows):
        tree += row
    out, after, before = symbols[:], [*range(1, n), -1], [*range(-1, n - 1)]
    while (top := tree[1]) != NONE:
        i = top % n
        j = after[i]
        left = out[i] = lookup((out[i], out[j]))[1]
        out[j] = -1
        k = after[i] = after[j]
        h = before[i]
        m = None
        if k >= 0:
            before[k] = i
            m = lookup((left, out[k]))
        a = b = leaves + i
        tree[b] = NONE if m is None else m[0] * n + i
        c = leaves + j if k >= 0 else b
        tree[c] = NONE if c != b else tree[b]
        if h >= 0:
            m = lookup((out[h], left))
            a = leaves + h
            tree[a] = NONE if m is None else m[0] * n + h
        while a > 1:  # the paths of the changed leaves, together where they meet
            a >>= 1
            b >>= 1
            c >>= 1
            x, y = tree[2 * a], tree[2 * a + 1]
            tree[a] = x if x < y else y
            if b != a:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if c != b:
                x, y = tree[2 * c], tree[2 * c + 1]
                tree[c] = x if x < y else y
    return [s for s in out if s >= 0]


class PairTable:
    """Merges of symbol pairs for arrays: open addressing with linear steps."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        pairs = np.array([*merges], np.int64).reshape(-1, 2)
        made = np.array([*merges.values()], np.int64).reshape(-1, 2)
        self.bits = max(10, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.full(size, -1, np.int32)
        at, todo, self.steps = self._slot(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs)), 0
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]] = pairs[put, 0] << 32 | pairs[put, 1]
            self.rank[at[put]], self.made[at[put]] = made[put, 0], made[put, 1]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & (size - 1)
            self.steps += 1

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * 40_503 + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` without a merge) and merged symbol of each pair."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key, at = a << 32 | b, self._slot(a, b)
        held = self.keys[at]
        for _ in range(self.steps - 1):
            astray = np.flatnonzero((held != key) & (held >= 0))
            if not len(astray):
                break
            at[astray] = (at[astray] + 1) & (len(self.keys) - 1)
            held[astray] = self.keys[at[astray]]
        same = held == key
        return np.where(same, self.rank[at], NONE), np.where(same, self.made[at], -1)


def merge_together(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge_piece`` of many pieces of one length class: rows of symbols, -1 after a piece's end and for what was merged away."""
    count, width = symbols.shape
    leaves = 1 << max(0, (width - 2).bit_length())
    out, every = symbols.astype(np.int64), np.arange(count)
    tree = np.full((2 * leaves, count), NONE, np.int64)
    place = np.arange(width - 1)[:, None]
    left, right = out[:, :-1].T, out[:, 1:].T
    there = right >= 0
    rank = np.full(there.shape, NONE, np.int64)
    rank[there] = table.find(left[there], right[there])[0]
    tree[leaves : leaves + width - 1] = np.where(rank != NONE, rank * width + place, NONE)  # the smallest key is the leftmost lowest rank
    for level in range(leaves.bit_length() - 2, -1, -1):
        tree[1 << level : 2 << level] = np.minimum(tree[2 << level : 4 << level : 2], tree[(2 << level) + 1 : 4 << level : 2])
    after = np.tile(np.arange(1, width + 2), (count, 1))  # column ``width`` stands for: no neighbour
    before = np.tile(np.arange(-1, width), (count, 1))
    padded = np.concatenate((out, np.full((count, 2), -1, np.int64)), axis=1)
    live = every[tree[1] != NONE]
    while len(live):
        i = tree[1, live] % width
        j = after[live, i]
        merged = table.find(padded[live, i], padded[live, j])[1].astype(np.int64)
        k, h = after[live, j], before[live, i]
        padded[live, i], padded[live, j] = merged, -1
        after[live, i], before[live, k] = k, i
        follows, leads = padded[live, k] >= 0, h >= 0
        first, second = np.concatenate((merged, padded[live, h])), np.concatenate((padded[live, k], merged))
        real = np.concatenate((follows, leads))
        rank = np.full(len(real), NONE, np.int64)
        rank[real] = table.find(first[real], second[real])[0]
        at = np.concatenate((i, np.where(leads, h, i)))
        key = np.where(rank != NONE, rank * width + at, NONE)
        key[len(live) :] = np.where(leads, key[len(live) :], key[: len(live)])
        rows = np.concatenate((live, live, live))
        node = np.concatenate((leaves + np.where(j < leaves, j, i), leaves + at))
        tree[node, rows] = np.concatenate((np.where(j < leaves, NONE, key[: len(live)]), key))
        while node[0] > 1:
            node >>= 1
            tree[node, rows] = np.minimum(tree[2 * node, rows], tree[2 * node + 1, rows])
        live = live[tree[1, live] != NONE]
    return padded[:, :width]


class BpeTokenizer:
    """A word-level BPE tokenizer from the text of a tokenizer file.

    ``specials=False`` treats the strings of special tokens as ordinary text.
    """

    def __init__(self, text: str, specials: bool = True):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.table = PairTable(self.merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = Tokenizer.from_str(text)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.plain = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([self.vocab[c] for c in symbols], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in symbols], np.int64)
        #: ids of chunks as little-endian unsigned 32-bit integers
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """The pieces of a chunk, as bytes; ids of special tokens stand as they are."""
        if self.special_split is not None and "<" in chunk:
            return [p for part in self.special_split.split(chunk) for p in ([self.special[part]] if part in self.special else self._ordinary(part))]
        return self._ordinary(chunk)

    def _ordinary(self, text: str) -> list[bytes]:
        if not text:
            return []
        if text.isascii() or (max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)):
            if text.isalpha():  # letters alone are one piece
                return [text.lower().encode()]
            if text.isprintable():
                return [p.encode() for p in self.plain.findall(text.lower())]
        return [bytes([self.bytes[c] for c in p]) for p, _ in self.split(self.normalise(text))]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 2
        while width <= TOGETHER:
            alike = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            for first in range(0, len(alike), TREES):
                own = alike[first : first + TREES]
                n = sizes[own]
                raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in own.tolist()]), np.uint8).reshape(-1, width)
                place = np.arange(width)
                symbols = np.where(place < n[:, None] - 1, self.inner[raw], np.where(place == n[:, None] - 1, self.final[raw], -1))
                ids = merge_together(symbols, self.table)
                kept = ids >= 0
                packed, at = ids[kept].astype("<u4").tobytes(), 0
                for i, end in zip(own.tolist(), (4 * np.cumsum(kept.sum(axis=1))).tolist(), strict=True):
                    out[i] = packed[at:end]
                    at = end
            width *= 2
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            ids = merge_piece([*self.inner[list(pieces[i][:-1])].tolist(), int(self.final[pieces[i][-1]])], self.merges)
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _learn(self, missing: set[str]) -> None:
        """Puts the packed ids of the chunks into the young generation."""
        whole, shapes = {}, {}
        for c in missing:
            if (known := self.old.get(c)) is not None:
                self.young[c] = known
            elif c.isascii() and c.isalpha():  # one piece
                whole[c] = c.lower().encode()
            else:
                shapes[c] = self._pieces(c)
        pieces = [*{*whole.values(), *(p for shape in shapes.values() for p in shape)}]
        plain = [p for p in pieces if type(p) is bytes]
        coded = dict(zip(plain, self.merged(plain), strict=True)) | {p: np.array([p], "<u4").tobytes() for p in pieces if type(p) is int}
        for c, piece in whole.items():
            self.young[c] = coded[piece]
        for c, shape in shapes.items():
            self.young[c] = b"".join([coded[p] for p in shape])

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; null counts as empty. Neither spaces nor line ends reach a token."""
        at = 0
        while at < len(texts):
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            known, group, missing, chars = self.young, [], set(), 0
            while at < len(texts) and (not group or chars < GROUP_CHARS):
                text = texts[at] or ""
                chunks = text.replace("\n", " ").split(" ")
                missing.update([c for c in chunks if c not in known])
                group.append(chunks)
                chars += len(text)
                at += 1
            self._learn(missing)
            for chunks in group:
                yield b"".join([known[c] for c in chunks])
            for c in missing:
                if len(c) > MEMORABLE:
                    del known[c]

    def forget(self) -> None:
        """Drops the remembered chunks; ids stay the same."""
        self.old, self.young = {}, {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        (packed,) = self.encode_texts([text])
        return unpacked(packed)

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones too, joined by a space (the file has no decoder of its own)."""
        names = self.names
        return " ".join([names[i] for i in ids])


def unpacked(ids: bytes) -> list[int]:
    """Ids from little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, "<u4").tolist()


def tokenizer(text: str, specials: bool = True) -> BpeTokenizer:
    """One tokenizer per worker process and file."""
    key = hashlib.sha256(text.encode()).hexdigest() + str(specials)
    if key not in _tokenizers:
        _tokenizers[key] = BpeTokenizer(text, specials)
    return _tokenizers[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read on the driver; executors get its text by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of ``docs`` (doc_id, text, ...)."""
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file.value)
        for batch in batches:
            packed = list(own.encode_texts(batch.column(1).to_pylist()))
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""
    file = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, its ids decoded, both digested in place.

    Null and empty texts have no tokens. Rows stay as they are, repeats included; an
    empty table gives an empty result; further columns are ignored.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file.value)
        for batch in batches:
            counts, coded, plain = [], [], []
            for ids in own.encode_texts(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                plain.append(hashlib.sha256(own.decode(unpacked(ids)).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returned(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
