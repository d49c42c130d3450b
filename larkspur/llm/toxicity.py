"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are composed; all but the first are tables of weighted arcs.

* Words to symbols: insult, threat, target, negation, reported speech or other. An
  insult or threat may also be read as marked, with its weight: the one that a match is
  about.
* Match: exactly one marked insult in a clause, or one marked threat with a target soon
  after it.
* Negation: what is marked soon after a negation fades.
* Target: a marked insult gains from a target near it, before or after.
* Reported speech: what is marked after a reporting word fades.

A clause (up to a stop mark or line end) scores the sum over all accepting paths of the
product of their weights. The scores of a document's clauses - the strongest, all
together, and the share of clauses that match - make a probability.

Fixed word lists in four languages seed the lexicon. Words and stems (leading letters)
that occur in toxic rather than in clean documents join the insults, by the lower
confidence bound of their share, and the final weights are fitted; both from a bounded
sample of labelled documents (``max_labelled``, smallest hashes first).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, returned

# Seed lexicon, English, German, Spanish and French.
INSULTS = tuple(
    "clown creep disgusting dumb filth fool garbage idiot imbecile loser moron pathetic pig scum stupid trash ugly vermin worthless "
    "abschaum arschloch blödmann depp dummkopf dumm ekelhaft schwachkopf schwein trottel ungeziefer versager widerlich wertlos "
    "asqueroso basura bobo cerdo despreciable escoria estúpido imbécil inútil patético payaso perdedor tonto "
    "abruti crétin dégoûtant imbécile minable ordure pathétique pourriture raclure répugnant stupide vaurien".split()
)
THREATS = tuple(
    "beat burn crush destroy hang hurt kill murder shoot stab strangle "
    "töte töten umbringen erschießen erschlagen vernichten verprügeln "
    "mataré matar mataremos destruiré golpearé quemaré "
    "tuerai tuer tuerons frapperai détruirai brûlerai étranglerai".split()
)
TARGETS = tuple(
    "you your yours u he him she her they them those these everyone "
    "du dich dir dein deine euch ihr ihn ihm sie "
    "tú ti tu tus usted ustedes él ella ellos ellas vosotros "
    "toi vous ton ta tes votre vos lui elle ils elles".split()
)
NEGATIONS = tuple(
    "not no never isn't aren't don't doesn't wasn't nobody "
    "nicht kein keine keinen nie niemals niemand "
    "nunca jamás nadie tampoco "
    "ne pas jamais aucun personne".split()
)
REPORTED = tuple(
    "said says claimed quoted reported wrote allegedly according called "
    "sagte sagt behauptete schrieb berichtete angeblich laut zitierte "
    "dijo dice afirmó escribió según citó supuestamente "
    "dit affirmé écrit selon prétendu déclaré prétendument".split()
)

SEED_WEIGHT, THREAT_WEIGHT = 3.0, 3.0
NEAR_TARGET, NEGATED, QUOTED = 1.25, 0.5, 0.7
TARGET_SPAN, NEGATION_SPAN, THREAT_SPAN = 4, 3, 3
STEMS = (4, 5, 6, 7)
#: A learned word or stem has so many times the share in toxic documents that it has in clean ones, and the lower bound of its odds is so many times those of any document.
PURITY, LIFT = 100.0, 9.0
#: Terms that a task counts before it hands them on to be summed.
MOST_TERMS = 200_000

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
STOPS = frozenset(".!?;:\n")

#: Symbols; the marked ones stand for what a match is about.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "reported", "other"
THE_INSULT, THE_THREAT = "the insult", "the threat"
UNMARKED = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
MARKED = (THE_INSULT, THE_THREAT)


# --- transducers -------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs (state, input, output, next state, weight) from ``start``; paths end in ``final`` states, with a last weight."""

    start: object
    arcs: tuple[tuple[object, str, str, object, float], ...]
    final: dict

    def leaving(self) -> dict[tuple[object, str], list[tuple[str, object, float]]]:
        out: dict = {}
        for state, read, write, goal, weight in self.arcs:
            out.setdefault((state, read), []).append((write, goal, weight))
        return out


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``a`` writes is read by ``b``; weights multiply. Only states that can be reached are made."""
    of_a, of_b = a.leaving(), b.leaving()
    reads: dict = {}
    for state, read in of_a:
        reads.setdefault(state, []).append(read)
    start = (a.start, b.start)
    arcs, seen, todo = [], {start}, [start]
    while todo:
        at = todo.pop()
        for read in reads.get(at[0], ()):
            for middle, goal_a, weight_a in of_a[at[0], read]:
                for write, goal_b, weight_b in of_b.get((at[1], middle), ()):
                    goal = (goal_a, goal_b)
                    arcs.append((at, read, write, goal, weight_a * weight_b))
                    if goal not in seen:
                        seen.add(goal)
                        todo.append(goal)
    return Transducer(start, tuple(arcs), {(x, y): v * w for x, v in a.final.items() for y, w in b.final.items() if (x, y) in seen})


def marking(threat: float = THREAT_WEIGHT) -> Transducer:
    """Symbols to themselves; threats also to marked ones. (Insults have weights of their own, see ``Reader.score_clause``.)"""
    return Transducer(0, (*((0, s, s, 0, 1.0) for s in UNMARKED), (0, THREAT, THE_THREAT, 0, threat), (0, THE_INSULT, THE_INSULT, 0, 1.0)), {0: 1.0})


def matching(span: int = THREAT_SPAN) -> Transducer:
    """One marked insult, or one marked threat with a target among the next ``span`` words."""
    arcs = [(state, s, s, state, 1.0) for state in ("open", "done") for s in UNMARKED]
    arcs += [("open", THE_INSULT, THE_INSULT, "done", 1.0), ("open", THE_THREAT, THE_THREAT, 1, 1.0)]
    for k in range(1, span + 1):
        arcs += [(k, s, s, k + 1, 1.0) for s in UNMARKED if s != TARGET and k < span]
        arcs.append((k, TARGET, TARGET, "done", 1.0))
    return Transducer("open", tuple(arcs), {"done": 1.0})


def fading(cause: str, factor: float, span: int | None) -> Transducer:
    """Multiplies what is marked among the ``span`` words after ``cause`` (None: anywhere after it) by ``factor``."""
    last = span or 1
    arcs = []
    for k in range(last + 1):
        after = 0 if not k else k if span is None else (k + 1) % (last + 1)
        arcs += [(k, s, s, 1 if s == cause else after, 1.0) for s in UNMARKED]
        arcs += [(k, s, s, after, factor if k else 1.0) for s in MARKED]
    return Transducer(0, tuple(arcs), {k: 1.0 for k in range(last + 1)})


def aiming(factor: float = NEAR_TARGET, span: int = TARGET_SPAN) -> Transducer:
    """Multiplies a marked insult by ``factor`` if a target is at most ``span`` words before or after it."""
    arcs = [("settled", s, s, "settled", 1.0) for s in UNMARKED + MARKED]
    for k in range(span + 1):  # k words after a target; 0: there was none so near
        after = (k + 1) % (span + 1) if k else 0
        arcs += [(k, s, s, 1 if s == TARGET else after, 1.0) for s in UNMARKED]
        arcs += [(k, THE_INSULT, THE_INSULT, "settled" if k else ("since", 1), factor if k else 1.0), (k, THE_THREAT, THE_THREAT, "settled", 1.0)]
    for k in range(1, span + 1):  # k words after the insult
        arcs += [(("since", k), s, s, ("since", k + 1) if k < span else "settled", 1.0) for s in UNMARKED if s != TARGET]
        arcs.append((("since", k), TARGET, TARGET, "settled", factor))
    return Transducer(0, tuple(arcs), {state: 1.0 for state in ["settled", *range(span + 1), *(("since", k) for k in range(1, span + 1))]})


def clause_machines() -> tuple[Transducer, ...]:
    return (marking(), matching(), fading(NEGATION, NEGATED, NEGATION_SPAN), aiming(), fading(REPORT, QUOTED, None))


class ClauseGrammar:
    """The composed machine, states numbered."""

    #: After so many other words in a row no state changes any more.
    SETTLED = max(TARGET_SPAN, NEGATION_SPAN, THREAT_SPAN) + 1

    def __init__(self):
        first, *rest = clause_machines()
        whole = first
        for machine in rest:
            whole = compose(whole, machine)
        number: dict = {}
        for state in [whole.start, *(a[0] for a in whole.arcs), *(a[3] for a in whole.arcs)]:
            number.setdefault(state, len(number))
        self.arcs: list[dict[str, list[tuple[int, float]]]] = [{} for _ in number]
        for state, read, _, goal, weight in whole.arcs:
            self.arcs[number[state]].setdefault(read, []).append((number[goal], weight))
        self.final = {number[s]: w for s, w in whole.final.items()}

    def step(self, weights: dict[int, float], symbol: str, factor: float = 1.0, into: dict[int, float] | None = None) -> dict[int, float]:
        """Weights of the states after one more symbol, summed over paths; added to ``into``."""
        out = {} if into is None else into
        for state, w in weights.items():
            for goal, f in self.arcs[state].get(symbol, ()):
                out[goal] = out.get(goal, 0.0) + w * f * factor
        return out

    def score(self, clause: list[tuple[int, str, float]]) -> float:
        """Sum over the accepting paths of a clause (place, symbol, weight); places between are other words."""
        weights, at = {0: 1.0}, clause[0][0] if clause else 0
        for place, symbol, weight in clause:
            for _ in range(min(place - at, self.SETTLED)):
                weights = self.step(weights, OTHER)
            at = place + 1
            after = self.step(weights, symbol)
            weights = self.step(weights, THE_INSULT, weight, after) if symbol == INSULT else after
        for state in [*weights]:
            weights[state] *= self.final.get(state, 0.0)
        return sum(weights.values())


# --- lexicon and reader --------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """Lexicon and final weights. ``insults`` maps words to weights, ``stems`` leading letters."""

    insults: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (-3.0, 1.5, 0.3, 0.0)

    def insult(self, word: str) -> float:
        weight = self.insults.get(word, 0.0)
        if self.stems:
            for n in STEMS:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        return weight


SEED = Grammar(dict.fromkeys(INSULTS, SEED_WEIGHT), {})
LISTED = {word: kind for kind, words in ((REPORT, REPORTED), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for word in words}


class Reader:
    """Runs a grammar over texts; remembers words' symbols within bounds."""

    def __init__(self, grammar: Grammar, memory: int = 300_000):
        self.grammar, self.memory, self.machine = grammar, memory, ClauseGrammar()
        self.plain: set[str] = set()
        self.symbols: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """Symbol and weight of a word; None for an ordinary one."""
        if word in self.plain:
            return None
        if (known := self.symbols.get(word)) is not None:
            return known
        if word in STOPS:
            out = ("stop", 0.0)
        elif (weight := self.grammar.insult(word)) > 0:
            out = (INSULT, weight)
        else:
            out = (LISTED[word], 0.0) if word in LISTED else None
        if len(self.plain) + len(self.symbols) >= self.memory:
            self.plain.clear()
            self.symbols.clear()
        if out is None:
            self.plain.add(word)
        else:
            self.symbols[word] = out
        return out

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses that match anything, and the number of all clauses."""
        scores, count, clause, told = [], 1, [], False
        plain, symbol = self.plain, self.symbol
        for at, word in enumerate([*TOKEN.findall(text.lower()), "."]):
            if word in plain:
                continue
            found = symbol(word)
            if found is None:
                continue
            if found[0] == "stop":
                if told and (score := self.machine.score(clause)) > 0:  # without insult or threat nothing is marked
                    scores.append(score)
                count, clause, told = count + 1, [], False
            else:
                clause.append((at, *found))
                told = told or found[0] in (INSULT, THREAT)
        return scores, count - 1

    def features(self, text: str | None) -> tuple[float, float, float]:
        scores, count = self.clauses(text or "")
        return (max(scores, default=0.0), math.log1p(sum(scores)), len(scores) / count)

    def score(self, text: str | None) -> float:
        a, *b = self.grammar.weights
        z = a + sum(w * x for w, x in zip(b, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled documents.

    A document that is labelled more than once counts as toxic if one label says so.
    """
    known = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled ids


def _lower_bound(hits: float, n: float, z: float = 2.2) -> float:
    """Wilson's lower confidence bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn_grammar(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int = 16_000, max_entries: int = 4_000) -> Grammar:
    """A grammar from the labelled documents for which ``train`` holds.

    ``max_labelled`` bounds the documents, ``max_entries`` the learned words and stems.
    Without labels of both kinds the seed grammar is returned.
    """
    sample = cut(_sample(docs, labels, train, max_labelled))

    def counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = [*toxic, *(k for k in clean if k not in toxic)]
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w for w in TOKEN.findall((text or "").lower()) if w not in STOPS}
                found = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}
                (toxic if label else clean).update(found)
            if len(toxic) + len(clean) > MOST_TERMS:  # summed below
                yield counted(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield counted(toxic, clean)

    counts = sample.select("text", "toxic").mapInArrow(returned(terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = {int(r.toxic > 0): r.n for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return SEED
    odds, bar = totals[1] / totals[0], PURITY * totals[1] / totals[0]
    rows = counts.filter((F.col("toxic") >= 4) & (F.col("toxic") >= F.lit(bar) * F.col("clean"))).orderBy(F.desc(F.col("toxic") - F.lit(bar) * F.col("clean")), "term").limit(max_entries).collect()
    words, stems = dict(SEED.insults), {}
    for r in rows:
        low = _lower_bound(r.toxic, r.toxic + r.clean)
        if (lift := low / (1 - low) / odds) > LIFT:
            weight = min(6.0, math.log(lift))
            if r.term.endswith("*"):
                stems[r.term[:-1]] = weight
            else:
                words[r.term] = max(words.get(r.term, 0.0), weight)
    grammar = Grammar(words, stems)
    featured = _features(sample, grammar)
    return Grammar(words, stems, _fit(featured))


def _features(sample: DataFrame, grammar: Grammar) -> np.ndarray:
    """Rows of features and label, of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(grammar)
        for batch in batches:
            rows = [(*own.features(text), float(label)) for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.float64()) for k in range(4)], names=["a", "b", "c", "y"])

    rows = sample.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(run, "a double, b double, c double, y double").collect()
    return np.array(sorted(tuple(r) for r in rows), np.float64)


def _fit(rows: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; slopes below zero are set to zero, so weight never lowers a score."""
    x, y = np.column_stack((np.ones(len(rows)), rows[:, :3])), (rows[:, 3] > 0).astype(float)
    free = [0, 1, 2, 3]
    while True:
        b = np.zeros(4)
        for _ in range(rounds):
            z = np.clip(x[:, free] @ b[free], -30, 30)
            p = 1 / (1 + np.exp(-z))
            penalty = np.diag([0.0 if k == 0 else ridge for k in free]) + 1e-9 * np.eye(len(free))
            step = np.linalg.solve((x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + penalty, x[:, free].T @ (y - p) - penalty @ b[free])
            b[free] += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        down = [k for k in free if k and b[k] < 0]
        if not down:
            return tuple(float(v) for v in b)
        free = [k for k in free if k not in down]


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score), a row for each row of ``docs`` (doc_id, text, ...).

    Null and empty texts get the score of a text that matches nothing. Repeats stay; an
    empty table gives an empty result; further columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(shipped.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; null and empty texts stay, repeated rows go or stay together, an empty table stays empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(returned(run), docs.schema)
