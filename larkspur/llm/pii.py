"""Personal data by candidate generation and gradient-boosted selection. DataFrame functions only on the rows.

* Strict spans: four patterns with their checks (the base). They always stay.
* Candidates: wider patterns propose spans of the same kinds - spelled-out separators,
  missing prefixes, unusual grouping - which may overlap; those that touch a strict
  span are settled already and go.
* Selection: boosted trees score each candidate by its format and its context. The
  trees are fitted on the driver with NumPy over counted vectors of features and run as
  plain column expressions. A threshold per kind, calibrated on the half of the table
  that the trees have not seen, selects; of overlapping selections the best stays.

The training table counts the candidates of all documents by their vectors (a candidate
is positive if it is a strict span) and has generated texts with disguised personal data
and with look-alikes: dates, versions, amounts, tables of numbers. The documents' rows
weigh together as much as the generated ones, however many they are.

Patterns keep to possessive or bounded repeats, so long junk takes linear time and no
deep recursion.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns; a start inside a run that a longer start covers is skipped.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]{{1,63}}+|\.[A-Za-z0-9-]{{1,63}}+){{1,6}}+| at [A-Za-z0-9-]{{1,63}}+(?: dot [A-Za-z0-9-]{{1,63}}+){{1,6}}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| dot |\[dot\]|\(dot\)| \. )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{4}){2}[ ./_-]{0,2}[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:tel:)?[(]?[0-9][0-9() ./-]{6,18}[0-9](?![0-9A-Za-z])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Words that hint at a kind, and words that hint at something else.
CUES = {"email": "mail|contact|write|reach", "ip": "ip|host|server|address|ping|node", "card": "card|visa|master|credit|debit|pay", "phone": "phone|tel|call|mobile|fax|dial|cell|whatsapp"}
OTHERS = "price|total|date|version|isbn|order|page|ticket|build|serial|table|sum|chapter|usd|eur"

CONTEXT = 24
#: Features and the bits that each has in a packed vector; larger values count as the largest there.
WIDTHS = {"kind": 2, "chars": 6, "digits": 6, "letters": 6, "marks": 6, "groups": 6, "longest": 6, "spelled": 1, "luhn": 1, "octets": 1, "cue": 1, "other": 1, "opens": 1, "lead": 4, "date": 1, "even": 1}
FEATURES = tuple(WIDTHS)
#: Different vectors that the driver gets at most; beyond that sizes are counted in coarser steps, and no row is left out.
MOST_VECTORS = 200_000


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _span_type() -> str:
    return "array<struct<kind:string,start:int,stop:int,match:string>>"


def _spans(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Matches of ``pattern`` with their places in code points: the pieces between matches give the places."""
    empty = F.array().cast(_span_type())
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["p"])
        stop = start + F.length(pair["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), pair["m"].alias("match"))
        return F.struct(stop.alias("at"), F.array_append(state["out"], span).alias("out"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda state: state["out"])
    return F.when(hint & text.rlike(pattern), placed).otherwise(empty)


def _octets_ok(match: Column) -> Column:
    return match.rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$")


def strict_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed, then by place."""
    checks = {
        "email": lambda m: F.lit(True),
        "ip": _octets_ok,
        "card": lambda m: F.call_function("luhn_check", _digits(m)),
        "phone": lambda m: F.length(_digits(m)).between(8, 15),
    }
    hints = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def checked(kind: str) -> Column:
        return F.filter(_spans(text, kind, STRICT[kind], hints[kind]), lambda x: checks[kind](x["match"]))

    return F.concat(*[checked(k) for k in KINDS])


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def loose_spans(text: Column) -> Column:
    """Proposed spans of all kinds, overlaps included."""
    spelled = [F.contains(text, F.lit(x)) for x in ("@", "(at)", "[at]", " dot ")]
    number = text.rlike(r"[0-9][^A-Za-z]{6}")
    dotted = text.rlike(r"[0-9](?:\[|\(| dot | \. )")
    hints = {"email": spelled[0] | spelled[1] | spelled[2] | spelled[3], "ip": dotted, "card": number, "phone": number}
    found = [_spans(text, k, LOOSE[k], hints[k]) for k in KINDS[:-1]]
    dialled = F.filter(_spans(text, "phone", LOOSE["phone"], number), lambda x: F.length(_digits(x["match"])).between(8, 15))
    return F.concat(*found, dialled)


def features(span: Column, text: Column) -> Column:
    """Format and context of a span, as a struct of doubles."""
    m = span["match"]
    digits = _digits(m)
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, begin + 1, span["start"] - begin))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    longest = F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))
    kind = F.lit(0)
    cue = F.lit(False)
    for k, name in enumerate(KINDS):
        kind = F.when(span["kind"] == name, k).otherwise(kind)
        cue = F.when(span["kind"] == name, before.rlike(CUES[name])).otherwise(cue)
    sizes = F.transform(groups, F.length)
    values = {
        "kind": kind,
        "chars": F.length(m),
        "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "marks": F.length(F.regexp_replace(m, "[A-Za-z0-9 ]", "")),
        "groups": F.size(groups),
        "longest": longest,
        "spelled": m.rlike(r"(?i)\(at\)|\[at\]| at |dot|\[\.\]|\(\.\)"),
        "luhn": F.coalesce(F.call_function("luhn_check", F.when(digits != "", digits)), F.lit(False)),
        "octets": _octets_ok(m),
        "cue": cue,
        "other": before.rlike(OTHERS),
        "opens": m.rlike(r"^\(|^00|^tel:"),
        "lead": F.substring(F.concat(digits, F.lit("0")), 1, 1).cast("int"),
        "date": m.rlike(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}"),
        "even": F.size(F.array_distinct(sizes)) <= 1,
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, strict, open): strict spans, and proposals that touch none of them."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = whole.select("doc_id", "text", strict_spans(F.col("text")).alias("strict"), loose_spans(F.col("text")).alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("strict", lambda b: _touches(b, c)))
    return found.select("doc_id", "text", "strict", free.alias("open"))


# --- boosted trees ---------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A split on ``feature`` < ``at``, or a leaf with ``value``."""

    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.at, self.low.apply(x), self.high.apply(x))

    def column(self, row: Column) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(row[FEATURES[self.feature]] < self.at, self.low.column(row)).otherwise(self.high.column(row))


@dataclass(frozen=True)
class Model:
    """Boosted trees over ``FEATURES`` and a threshold of the log-odds per kind."""

    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def column(self, row: Column) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree.column(row)
        return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, depth: int, ridge: float, least: int) -> Tree:
    best, gain = None, 1e-6
    total_g, total_h, total_w = g.sum(), h.sum(), w.sum()
    if depth and total_w >= 2 * least:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch, cw = x[order, f], np.cumsum(g[order]), np.cumsum(h[order]), np.cumsum(w[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            cuts = cuts[(cw[cuts] >= least) & (total_w - cw[cuts] >= least)]
            if not len(cuts):
                continue
            lg, lh = cg[cuts], ch[cuts]
            value = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - total_g**2 / (total_h + ridge)
            k = int(np.argmax(value))
            if value[k] > gain:
                gain, best = float(value[k]), (f, float(v[cuts[k] + 1]))
    if best is None:
        return Tree(value=float(total_g / (total_h + ridge)))
    f, at = best
    low = x[:, f] < at
    return Tree(f, at, _grow(x[low], g[low], h[low], w[low], depth - 1, ridge, least), _grow(x[~low], g[~low], h[~low], w[~low], depth - 1, ridge, least))


def _shrunk(tree: Tree, rate: float) -> Tree:
    if tree.feature < 0:
        return Tree(value=tree.value * rate)
    return Tree(tree.feature, tree.at, _shrunk(tree.low, rate), _shrunk(tree.high, rate))


def fit(x: np.ndarray, y: np.ndarray, seen: np.ndarray, weight: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Model:
    """Logistic boosting on the rows ``seen``; thresholds on the others. Each row counts ``weight`` times.

    A kind's threshold is the lowest score above which the unseen rows reach
    ``precision``, and never below even odds of nine to one; without unseen positives
    the kind selects nothing.
    """
    xs, ys, ws = x[seen], y[seen], weight[seen]
    share = min(max((ys * ws).sum() / ws.sum() if len(ys) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z, trees = np.full(len(xs), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _shrunk(_grow(xs, (ys - p) * ws, p * (1 - p) * ws, ws, depth, 1.0, 8), rate)
        z += tree.apply(xs)
        trees.append(tree)
    model, limits = Model(start, tuple(trees), ()), []
    rest, labels, counts = x[~seen], y[~seen], weight[~seen]
    scores = model.scores(rest)
    for k in range(len(KINDS)):
        own = rest[:, 0] == k
        order = np.argsort(-scores[own], kind="stable")
        s, n, hit = scores[own][order], np.cumsum(counts[own][order]), np.cumsum((labels * counts)[own][order])
        ends = np.flatnonzero(np.append(s[1:] < s[:-1], True)) if len(s) else np.array([], int)  # equal scores pass together
        good = ends[hit[ends] >= precision * n[ends]]
        limits.append(max(float(np.log(9.0)), float(s[good[-1]])) if len(good) and hit[good[-1]] else float("inf"))
    return Model(start, tuple(trees), tuple(limits))


# --- training table ----------------------------------------------------------------------


def generated_texts(rounds: int = 300, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with disguised personal data (and where it is) and look-alikes, always the same."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def check_digit(body: str) -> int:
        return -sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(body)))) % 10

    def luhn(n: int) -> str:
        body = r.choice("3456") + number(n - 2)
        return body + str(check_digit(body))

    def no_card(n: int) -> str:
        """Digits whose last one is not the check digit, so that they are no card number."""
        body = number(n - 1)
        return body + str((check_digit(body) + r.randint(1, 9)) % 10)

    def grouped(digits: str) -> str:
        return " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email() -> str:
        at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", "[dot]"), (" (at) ", " (dot) "), ("[at]", ".")])
        return f"{word()}{r.choice(['', '.' + word(), number(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'example', 'de'])}"

    def ip() -> str:
        return r.choice(["[.]", "(.)", " dot ", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        c = luhn(16)
        return r.choice([".", "/", "_", " - ", "  "]).join(c[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"({a}) {b} {c}", f"tel:{a}{b}{c}", f"{a}.{b}.{c}"])

    cues = {email: ["mail me:", "contact", "write to"], ip: ["host", "server ip", "ping"], card: ["card", "visa", "pay with"], phone: ["call", "phone:", "tel.", "mobile"]}
    fakes = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(10, 23)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
        lambda: " ".join(number(r.randint(1, 3)) for _ in range(5)),
        lambda: grouped(no_card(16)),
        lambda: f"{number(1)}.{number(9)}",
        lambda: no_card(r.randint(8, 19)),
        lambda: f"{number(3)} {number(3)} {number(3)}",
        lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: f"{r.randint(256, 999)} . {r.randint(256, 999)} . {number(3)} . {number(3)}",
        lambda: f"{word()} at {word()} dot {word()} {word()}",
        lambda: f"{number(4)}-{number(4)}",
    ]
    tags = ["total", "order", "version", "table", "page", "date", "isbn", "", "", ""]
    out = []
    for _ in range(rounds):
        for make, hints in cues.items():
            lead = f"{word()} {word()} {r.choice([*hints, '']) if make in (card, phone, ip) else r.choice([*hints, '', ''])} "
            if make in (phone, card) and lead.endswith("  "):
                lead += f"{r.choice(hints)} "
            item = make()
            out.append((f"{lead}{item} {word()} {word()}", [(len(lead), len(lead) + len(item))]))
        for make in fakes:
            out.append((f"{word()} {r.choice(tags)} {make()} {word()}", []))
    return out


def _table(found: DataFrame, spans: str) -> np.ndarray:
    """Rows of features, from the array column ``spans`` of a bounded number of documents."""
    rows = found.select("doc_id", F.explode(spans).alias("span"), "text").select("doc_id", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), features(F.col("span"), F.col("text")).alias("f"))
    taken = rows.collect()
    return np.array(sorted((r.doc_id or 0, r.start, r.stop, *r.f) for r in taken), np.float64).reshape(len(taken), 3 + len(FEATURES))


def _packed(row: Column, *flags: Column) -> Column:
    """Features and flags as one long, the last flag in the lowest bit."""
    out = F.lit(0).cast("long")
    for f, bits in WIDTHS.items():
        out = F.shiftleft(out, bits).bitwiseOR(F.least(row[f], F.lit(float((1 << bits) - 1))).cast("long"))
    for flag in flags:
        out = F.shiftleft(out, 1).bitwiseOR(flag.cast("long"))
    return out


def _unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and sides of packed vectors."""
    x, at = np.zeros((len(keys), len(FEATURES))), 2
    for k, bits in reversed(list(enumerate(WIDTHS.values()))):
        x[:, k] = (keys >> at) & ((1 << bits) - 1)
        at += bits
    return x, (keys >> 1 & 1).astype(float), (keys & 1).astype(bool)


def _steps(step: int) -> int:
    """Mask that leaves packed sizes in steps of ``1 << step``."""
    mask, at = 0b11, 2
    for bits in reversed(list(WIDTHS.values())):
        mask |= ((1 << bits) - (1 << step if bits == 6 else 1)) << at
        at += bits
    return mask


def counted_vectors(docs: DataFrame, most: int = MOST_VECTORS) -> tuple[np.ndarray, np.ndarray]:
    """Packed vectors (features, strict, side) of all candidates of all rows of ``docs``, in order, and how often each occurs.

    Sides are halves of the texts by hash. More than ``most`` vectors are counted by
    sizes in steps of 2, 4 .. 64; then at most 65 536 are left.
    """

    def labelled(spans: str, y: int) -> Column:
        return F.transform(spans, lambda c: F.struct(F.lit(y).alias("y"), c.alias("span")))

    side = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    rows = candidates(docs).select("text", F.explode(F.concat(labelled("open", 0), labelled("strict", 1))).alias("c"))
    counts = cut(rows.select(_packed(features(F.col("c.span"), F.col("text")), F.col("c.y"), side).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    for step in range(7):
        coarse = counts.groupBy(F.col("v").bitwiseAND(F.lit(_steps(step))).alias("v")).agg(F.sum("n").alias("n"))
        if step == 6 or coarse.count() <= most:
            break
    taken = coarse.collect()
    found = np.array(sorted(map(tuple, taken)), np.int64).reshape(len(taken), 2)
    return found[:, 0], found[:, 1]


def learn_model(docs: DataFrame) -> Model:
    """Trees and thresholds, from the proposals and strict spans of all rows of ``docs`` and from generated texts."""
    spark = docs.sparkSession
    made = generated_texts()
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    own = _table(candidates(texts), "open")
    label = [float(any(a < stop and start < b and min(stop, b) - max(start, a) >= 0.6 * max(stop - start, b - a) for a, b in made[int(i)][1])) for i, start, stop in own[:, :3]]
    vectors, n = counted_vectors(docs)
    real, strict, side = _unpacked(vectors)
    x = np.concatenate((np.minimum(own[:, 3:], [(1 << bits) - 1 for bits in WIDTHS.values()]), real))
    y = np.concatenate((label, strict))
    seen = np.concatenate((own[:, 0].astype(np.int64) // 15 % 2 == 0, side))
    weight = np.concatenate((np.ones(len(own)), n * (len(own) / max(n.sum(), len(own)))))
    return fit(x, y, seen, weight)


# --- selection -----------------------------------------------------------------------------


def find_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, strict, added): per row of ``docs`` its strict spans and the selected further ones.

    Places are code points, ends exclusive; null texts count as empty; repeats stay; an
    empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    found = candidates(docs)

    def scored(c: Column) -> Column:
        row = features(c, F.col("text"))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), row.alias("f"))

    def judged(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), model.column(c["f"]).alias("score"))

    limit = F.lit(float("inf"))
    limits = {k: v for k, v in zip(KINDS, model.thresholds, strict=True)}

    def passes(c: Column) -> Column:
        at = limit
        for k, v in limits.items():
            at = F.when(c["kind"] == k, F.lit(v)).otherwise(at)
        return c["score"] >= at

    scores = found.withColumn("featured", F.transform("open", scored)).withColumn("judged", F.transform("featured", judged))
    chosen = scores.withColumn("passed", F.filter("judged", passes))

    def beaten(c: Column, d: Column) -> Column:
        first = (d["score"] > c["score"]) | ((d["score"] == c["score"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & ((d["stop"] > c["stop"]) | ((d["stop"] == c["stop"]) & (d["kind"] < c["kind"]))))))
        return _touches(c, d) & first

    added = F.filter("passed", lambda c: ~F.exists("passed", lambda d: beaten(c, d)))
    return chosen.select("doc_id", "text", "strict", added.alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the strict spans, and the list of all spans."""
    plain = lambda a: F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string")))
    count = lambda k: F.size(F.filter("strict", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    bare = lambda a: F.transform(a, lambda c: F.struct(order[c["kind"]].alias("k"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    every = F.array_sort(F.concat(bare("strict"), bare("added")))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(plain("strict"), ","), 256).alias("base_sha256"), F.array_join(plain(every), ",").alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of ``find_spans`` replaced by its kind in brackets; touching spans become one."""
    bare = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    every = F.array_sort(F.concat(bare("strict"), bare("added")))

    def step(state: Column, c: Column) -> Column:
        fresh = c["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(c["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], gap, F.lit("["), c["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], c["stop"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest).alias("text"))
