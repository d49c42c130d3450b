"""Language identification by rank-order n-gram profiles.

A language's profile ranks its most frequent letter n-grams (one to three letters,
word edges included). A text ranks its own the same way, and each language is as far
as the sum of the places by which its ranks differ; an n-gram outside the language's
profile counts the most. All of a text's n-grams are ranked, those that no profile holds
too. Profiles are learned from a bounded sample of labelled documents (``per_language``
each, smallest hashes first); every text is then ranked whole, by counting with array
operations: an n-gram is a number made of its code points, so any alphabet will do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ids of sampled documents are broadcast up to this many (about 1 MB).
BROADCAST_IDS = 100_000
EDGE = " "
UNKNOWN = "und"


def letters_only(text: str) -> str:
    """Lower-cased text with one blank for each run of other characters, and at both ends; empty without letters."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return f" {' '.join(words)} " if words else ""


def ngrams(text: str) -> Iterator[str]:
    """N-grams of one to three characters; a blank only at an end, never alone."""
    clean = letters_only(text)
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            gram = clean[i : i + n]
            if gram != EDGE and (n < 3 or gram[1] != EDGE):
                yield gram


@dataclass(frozen=True)
class Profiles:
    """Per language, in order of name, the n-grams by rank."""

    languages: tuple[str, ...]
    ranked: tuple[tuple[str, ...], ...]

    @property
    def known(self) -> list[str]:
        return sorted({g for grams in self.ranked for g in grams})


def learn_profiles(docs: DataFrame, train: Column, per_language: int = 400, places: int = 300) -> Profiles:
    """Profiles from ``docs`` (doc_id, text, lang) where ``train`` holds and lang is not null.

    ``per_language`` bounds the documents that are counted for one language.
    """
    labelled = docs.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = cut(labelled.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id").distinct())
    if chosen.count() <= BROADCAST_IDS:  # per_language times the languages; very many languages are joined by shuffle
        chosen = F.broadcast(chosen)
    sample = docs.filter(train & F.col("lang").isNotNull()).join(chosen, "doc_id", "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(lang, Counter()).update(ngrams(text or ""))
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("place", place).filter(F.col("place") <= places).collect()  # languages times places
    names = tuple(sorted({r.lang for r in rows}))
    return Profiles(names, tuple(tuple(r.gram for r in sorted((r for r in rows if r.lang == name), key=lambda r: r.place)) for name in names))


#: Bits of a code point, and the number that stands for a word's edge (no letter has it).
POINT, EDGE_CODE = 21, 1


def _letter_codes() -> np.ndarray:
    """Each code point's own number if it is a letter, else the edge's."""
    return np.array([c if chr(c).isalpha() else EDGE_CODE for c in range(0x110000)], np.int32)


class Ranker:
    """Out-of-place distances of texts."""

    def __init__(self, profiles: Profiles, places: int):
        self.languages, self.places, self.letters = profiles.languages, places, _letter_codes()
        keys = {self.key(g): g for g in profiles.known}
        self.keys = np.array(sorted(keys), np.int64)
        self.rank = np.full((len(self.languages), len(keys)), -1, np.int64)
        for row, grams in zip(self.rank, profiles.ranked, strict=True):
            place = {g: i for i, g in enumerate(grams)}
            row[:] = [place.get(keys[k], -1) for k in self.keys.tolist()]

    @staticmethod
    def key(gram: str) -> int:
        at = 0
        for c in gram:
            at = at << POINT | (EDGE_CODE if c == EDGE else ord(c))
        return at

    def ranked(self, text: str) -> np.ndarray | None:
        """A text's most frequent n-grams, as numbers; at ties shorter ones, then smaller code points first. None if it has no letter."""
        codes = self.letters[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        if (codes == EDGE_CODE).all():
            return None
        codes = np.concatenate(([EDGE_CODE], codes, [EDGE_CODE]))
        inside = codes != EDGE_CODE
        keep = np.concatenate(([True], inside[1:] | inside[:-1]))  # one edge for each run
        codes, inside = codes[keep], inside[keep]
        two = codes[:-1] << POINT | codes[1:]
        three = (two[:-1] << POINT | codes[2:])[inside[1:-1]]
        grams, counts = np.unique(np.concatenate((codes[inside], two, three)), return_counts=True)
        return grams[np.argsort(-counts, kind="stable")[: self.places]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - its distance as a share of the largest possible one."""
        own = self.ranked(text) if text and self.languages else None
        if own is None:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        there = np.where(self.keys[at] == own, self.rank[:, at], -1)
        away = np.where(there < 0, self.places, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(np.clip(1 - away[best] / (self.places * len(own)), 0.0, 1.0))


_rankers: dict[Profiles, Ranker] = {}


def predict_languages(docs: DataFrame, profiles: Profiles, places: int = 300) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs`` (doc_id, text, ...).

    ``und`` with score 0 for a text that is null or has no letter, or if no profile was
    learned. Letters of no profile give the first language with score 0; equal
    distances go to the language first by name. Repeats stay; an empty table gives an
    empty result; further columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shipped.value
        if given not in _rankers:
            _rankers.clear()
            _rankers[given] = Ranker(given, places)
        own = _rankers[given]
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
