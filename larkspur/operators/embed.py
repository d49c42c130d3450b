"""The local embedder: signed feature hashing of words, word pairs and character 4-grams.

Arrow batches in Python, since the hash (BLAKE2b) has no built-in counterpart. Equal
features of a text add up before the logarithm.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

_WORD = re.compile(R.EMBED_WORD)


def features(text: str) -> Counter:
    """Weights of a text's features, named by kind."""
    words = _WORD.findall(text.lower())
    line = " ".join(words)
    kinds = (("w", words, R.WORD_WEIGHT), ("b", (f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)), R.PAIR_WEIGHT), ("c", (line[i : i + 4] for i in range(len(line) - 3)), R.GRAM_WEIGHT))
    total: Counter = Counter()
    for kind, names, weight in kinds:
        for name, n in Counter(names).items():
            total[f"{kind}:{name}"] = n * weight
    return total


def _placed(names: list[str], width: int) -> np.ndarray:
    """Place and sign (place * 2 + lowest bit of the hash) of features."""
    hashes = np.frombuffer(b"".join([hashlib.blake2b(name.encode(), digest_size=8).digest() for name in names]), ">u8").astype(np.uint64)
    return ((hashes >> np.uint64(1)) % np.uint64(width) * np.uint64(2) + (hashes & np.uint64(1))).astype(np.int64)


#: The characters of a line of words; a 4-gram is a number in this base.
_SYMBOLS = [c for c in map(chr, range(128)) if c == " " or _WORD.fullmatch(c)]
_DIGIT = np.zeros(128, np.int64)
_DIGIT[[ord(c) for c in _SYMBOLS]] = range(len(_SYMBOLS))


@functools.cache
def _gram_places(width: int) -> np.ndarray:
    """Place and sign, as ``_placed`` has them, of every 4-gram; -1: not hashed yet."""
    return np.full(len(_SYMBOLS) ** 4, -1, np.int32)


@functools.cache
def _logs(weight: float) -> np.ndarray:
    """Damped weights of a feature that occurs 0, 1, .. times."""
    return np.array([1.0 + math.log(n * weight + 1.0) for n in range(1 << 12)])


def _damped(counts: np.ndarray, weight: float) -> np.ndarray:
    known = _logs(weight)
    if len(counts) == 0 or counts.max() < len(known):
        return known[counts]
    return np.array([1.0 + math.log(n * weight + 1.0) for n in counts.tolist()])


def _grams(line: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a line's 4-grams, in the order in which they first occur."""
    digits, base = _DIGIT[np.frombuffer(line.encode("ascii"), np.uint8)], len(_SYMBOLS)
    codes, first, counts = np.unique(((digits[:-3] * base + digits[1:-2]) * base + digits[2:-1]) * base + digits[3:], return_index=True, return_counts=True)
    order, table = np.argsort(first), _gram_places(width)
    new = np.nonzero(table[codes] < 0)[0]
    table[codes[new]] = _placed([f"c:{line[i : i + 4]}" for i in first[new].tolist()], width)
    return table[codes[order]], counts[order]


def embed(text: str | None, width: int = R.EMBED_WIDTH) -> np.ndarray:
    """Unit vector of a text; the zero vector if it has no feature.

    The sums over ``features``, in their order, with 4-grams as numbers.
    """
    words = _WORD.findall((text or "").lower())
    places, weights = [], []
    for kind, names, weight in (("w:", words, R.WORD_WEIGHT), ("b:", [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)], R.PAIR_WEIGHT)):
        counted = Counter(names)
        places.append(_placed([kind + name for name in counted], width))
        weights.append(_damped(np.fromiter(counted.values(), np.int64, len(counted)), weight))
    line = " ".join(words)
    if len(line) > 3:
        found, counts = _grams(line, width)
        places.append(found.astype(np.int64))
        weights.append(_damped(counts, R.GRAM_WEIGHT))
    place = np.concatenate(places)
    out = np.bincount(place >> 1, np.where(place & 1, 1.0, -1.0) * np.concatenate(weights), width)
    norm = math.sqrt(float(out @ out))
    return out / norm if norm else out


def embed_texts(rows: DataFrame, key: str, text: str = "text", width: int = R.EMBED_WIDTH, model: Callable[[list[str]], list] | None = None, batch: int = 16) -> DataFrame:
    """(key, vector) with the local embedder, or with ``model`` on ``batch`` texts at a time (a remote call, for one)."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [t or "" for t in part.column(1).to_pylist()]
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])] if model else [embed(t, width) for t in texts]
            ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
            flat = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if vectors else np.zeros(0)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "vector"])

    return rows.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, vector array<double>")
