"""Chat formatting by schema fingerprints.

A record's layout is recognised by its fingerprint: a hash of all its nested field
paths (array levels as ``[]``) with the kind of what is there: value, list or object. A
registry maps fingerprints to declarative mappings - which paths hold lists of turns,
which fields hold role and text, which flat fields follow each other as turns - and
one interpreter turns any mapped record into canonical turns. New layouts are new
entries, not new code. Only fields that are known to say nothing about turns, and
unnamed plain values beside them, stay out of the fingerprint; a record of any other
shape is refused rather than misread.

The template writes each turn as ``### role:``, the text and ``</turn>``. Inside roles
and texts the escape character and the control strings are replaced reversibly, so no
text can open, close or forge a turn. The loss mask covers the assistants' texts.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings of roles in common layouts.
ROLE_NAMES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "model": "assistant", "bot": "assistant", "system": "system"}

OPEN, CLOSE = "### ", "</turn>"
ESCAPES = {"\\": "\\b", "###": "\\h", "</turn>": "\\e", "\n": "\\n"}


# Fields that tell nothing about turns, wherever they stand.
IGNORED = frozenset("id uuid source dataset license lang language meta metadata score rating tags category timestamp created model weight".split())

VALUE, LIST, OBJECT = "value", "list", "object"


@dataclass(frozen=True)
class Part:
    """Where a layout's turns stand: a field that is one turn's text, or a list of turns.

    ``role``: the turn's role. ``turns``: names of the role and text fields of a list's
    turns. ``optional`` parts may be absent. ``joined`` text continues the turn before it
    after a blank line. ``unread`` parts belong to the layout but not to the conversation.
    """

    path: str
    role: str = ""
    turns: tuple[str, str] = ()
    optional: bool = False
    joined: bool = False
    unread: bool = False

    def shapes(self) -> list[frozenset[tuple[str, str]]]:
        """The (path, kind) sets that this part can have."""
        if not self.turns:
            return [frozenset({(self.path, VALUE)})] + [frozenset()] * self.optional
        role, text = (f"{self.path}[].{f}" for f in self.turns)
        listed, blocks = (self.path, LIST), f"{text}[]"
        own = {listed, (f"{self.path}[]", OBJECT), (role, VALUE)}
        plain = {(text, VALUE)}
        block = {(text, LIST), (blocks, OBJECT), (f"{blocks}.type", VALUE), (f"{blocks}.text", VALUE)}
        return [frozenset(s) for s in ({listed}, own, own | plain, own | block, own | plain | block)] + [frozenset()] * self.optional


@dataclass(frozen=True)
class Layout:
    """A declarative mapping to turns: parts in order. ``spelling`` keeps roles as they are spelled."""

    name: str
    parts: tuple[Part, ...]
    spelling: bool = False

    def shapes(self) -> list[frozenset[tuple[str, str]]]:
        return [frozenset().union(*chosen) for chosen in itertools.product(*(p.shapes() for p in self.parts))]


CHAT = ("role", "content")
#: Layouts in common use.
LAYOUTS = (
    Layout("turn rows", (Part("turns", turns=("role", "text")),), spelling=True),
    Layout("messages", (Part("messages", turns=CHAT),)),
    Layout("conversations", (Part("conversations", turns=("from", "value")),)),
    Layout("prompt-response", (Part("system", "system", optional=True), Part("prompt", "user"), Part("response", "assistant"))),
    Layout("prompt-completion", (Part("system", "system", optional=True), Part("prompt", "user"), Part("completion", "assistant"))),
    Layout("instruction", (Part("system", "system", optional=True), Part("instruction", "user"), Part("input", "user", optional=True, joined=True), Part("output", "assistant"))),
    Layout("question-answer", (Part("question", "user"), Part("answer", "assistant"))),
    Layout("chat prompt, response", (Part("prompt", turns=CHAT), Part("response", "assistant"))),
    Layout("chat prompt, chat completion", (Part("prompt", turns=CHAT), Part("completion", turns=CHAT))),
    Layout("preference", (Part("prompt", "user"), Part("chosen", "assistant"), Part("rejected", unread=True))),
    Layout("chat preference", (Part("prompt", turns=CHAT, optional=True), Part("chosen", turns=CHAT), Part("rejected", turns=CHAT, unread=True))),
)


def paths(value: object, at: str = "") -> set[tuple[str, str]]:
    """(path, kind) of all that is in a parsed record, itself left out. Nulls count as absent, ignored fields too."""
    found: set[tuple[str, str]] = set()
    inner = [(f"{at}.{k}" if at else k, v) for k, v in value.items() if k not in IGNORED] if isinstance(value, dict) else [(f"{at}[]", v) for v in value] if isinstance(value, list) else []
    for path, v in inner:
        if v is not None:
            found.add((path, OBJECT if isinstance(v, dict) else LIST if isinstance(v, list) else VALUE))
            found |= paths(v, path)
    return found


def path_hash(found: frozenset[tuple[str, str]]) -> str:
    return hashlib.sha1(json.dumps(sorted(found)).encode()).hexdigest()


class Registry:
    """Layouts by fingerprint. Plain values at the top that no layout names (a rank, a title) don't change a fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        shapes = [(shape, layout) for layout in layouts for shape in layout.shapes()]
        self.named = frozenset(path for shape, _ in shapes for path, _ in shape)
        self.by_hash: dict[str, Layout] = {}
        for shape, layout in shapes:
            self.by_hash.setdefault(path_hash(shape), layout)

    def fingerprint(self, record: object) -> str:
        return path_hash(frozenset((p, k) for p, k in paths(record) if p in self.named or k != VALUE or "." in p or "[" in p))

    def find(self, record: object) -> Layout | None:
        return self.by_hash.get(self.fingerprint(record))


def _text(value: object) -> str:
    """A text; the text blocks of a list one after the other."""
    if isinstance(value, list):
        return "".join(_text(block.get("text")) for block in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) in order. Null texts are empty; unknown roles keep their spelling."""
    out: list[tuple[str, str]] = []
    for part in layout.parts:
        value = record.get(part.path)
        if part.unread or (value is None and part.role != "assistant"):
            continue
        if part.turns:
            for turn in value or []:
                role, text = (_text((turn or {}).get(f)) for f in part.turns)
                out.append((role if layout.spelling else ROLE_NAMES.get(role, role), text))
        elif part.joined and out:
            if text := _text(value):
                out[-1] = (part.role, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((part.role, _text(value)))
    return out


def escape(text: str) -> str:
    return text.replace("\\", ESCAPES["\\"]).replace("###", ESCAPES["###"]).replace(CLOSE, ESCAPES[CLOSE])


_BACK = {v[1]: k for k, v in ESCAPES.items()}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask as spans of code points (end exclusive)."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head = f"{OPEN}{escape(role).replace(chr(10), ESCAPES[chr(10)])}:\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"\n{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 2
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(f"\n{CLOSE}\n")[:-1]:
        head, _, body = part[len(OPEN) :].partition(":\n")
        out.append((unescape(head), unescape(body)))
    return out


def format_records(records: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(conv_id, layout, formatted, loss) from (conv_id, record), a record being a JSON object.

    ``loss`` holds the mask's spans. A null record, broken JSON or an unknown layout
    gives a null layout, an empty text and no spans; of layouts with one shape the first
    listed is taken. Rows stay as they are, repeats included; an empty table gives an
    empty result; further columns are ignored.
    """
    known = registry or Registry()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, masks = [], [], []
            for raw in batch.column(1):
                layout, text, spans = None, "", []
                try:
                    record = json.loads(raw.as_py() or "null")
                except ValueError:
                    record = None
                if isinstance(record, dict) and (layout := known.find(record)) is not None:
                    text, spans = render(canonical_turns(record, layout))
                names.append(layout.name if layout else None)
                texts.append(text)
                masks.append([{"start": a, "stop": b} for a, b in spans])
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(masks, span)], names=["conv_id", "layout", "formatted", "loss"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(run, "conv_id long, layout string, formatted string, loss array<struct<start: long, stop: long>>")


def turn_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows (conv_id, turn, role, text): one JSON record per conversation.

    Turns go by turn number, null numbers first, ties by role and text; null roles and
    texts are empty; repeated rows are repeated turns; rows without conv_id form one
    conversation. Further columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                trained = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
