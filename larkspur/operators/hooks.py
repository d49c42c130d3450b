"""Optional model calls over tables. Without a model, callers keep the rule-based columns.

``model`` maps a list of prompts to a list of replies (null for a failed call). It is
shipped to the executors, so it must open its own connections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Model = Callable[[list[str]], list[str | None]]

# How much of history and passages a prompt carries.
HISTORY_CHARS, PROMPT_TURNS, TURN_CHARS = 400, 4, 500


def complete(rows: DataFrame, prompt: Column, model: Model, batch: int = 16) -> DataFrame:
    """``rows`` with ``reply``; rows whose prompt is null aren't sent. Retries are the model's affair."""
    keyed = rows.withColumn("__prompt", prompt)
    place = len(rows.columns)
    schema = rows.schema.add("reply", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            prompts = part.column(place).to_pylist()
            replies: list[str | None] = [None] * len(prompts)
            asked = [i for i, p in enumerate(prompts) if p is not None]
            for at in range(0, len(asked), batch):
                chosen = asked[at : at + batch]
                for i, reply in zip(chosen, model([prompts[i] for i in chosen]), strict=True):
                    replies[i] = reply
            yield pa.record_batch([*part.columns[:place], pa.array(replies, pa.string())], names=[*part.schema.names[:place], "reply"])

    return keyed.mapInArrow(run, schema)


def condense_prompt(question: Column, history: Column) -> Column:
    turns = F.transform(history, lambda t: F.concat(t["role"], F.lit(": "), F.left(t["content"], F.lit(HISTORY_CHARS))))
    return F.concat(F.lit("Rewrite the last question so that it stands alone. Reply with the question only.\n\n"), F.array_join(turns, "\n"), F.lit("\nquestion: "), question)


def condensed(reply: Column, fallback: Column) -> Column:
    """First line of the reply without quotes; the rules' rewrite if there is none."""
    line = T.stripped(F.regexp_replace(F.get(F.split(T.stripped(reply), "\n"), 0), "^[\"']+|[\"']+$", ""))
    return F.coalesce(F.nullif(line, F.lit("")), fallback)


def rerank_prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit('Score each passage from 0 to 10 for how well it answers the question. Reply with JSON: {"scores": [{"id": 0, "score": 0}]}\n\nQuestion: '), question, F.lit("\n\n"), F.array_join(passages, "\n\n"))


def rerank_scores(reply: Column) -> Column:
    """MAP<INT, DOUBLE> of passage scores in a reply; null if it can't be read."""
    parsed = F.from_json(T.parse_json_reply(reply).cast("string"), "scores array<struct<id:int,score:double>>")
    return F.map_from_entries(parsed["scores"])


def answer_prompt(question: Column, context: Column, history: Column) -> Column:
    """Sources, the last turns and the question."""
    recent = F.slice(history, F.greatest(F.size(history) - PROMPT_TURNS + 1, F.lit(1)), PROMPT_TURNS)
    turns = F.array_join(F.transform(recent, lambda t: F.concat(t["role"], F.lit(": "), F.left(t["content"], F.lit(TURN_CHARS)))), "\n")
    rules = "Answer from the numbered sources only and cite them as [n]. If they don't answer the question, reply INSUFFICIENT_EVIDENCE."
    return F.concat(F.lit(f"{rules}\n\n"), F.when(turns != "", F.concat(turns, F.lit("\n\n"))).otherwise(""), F.lit("Sources:\n\n"), context, F.lit("\n\nQuestion: "), question)


def judge_prompt(question: Column, expected: Column, answer: Column) -> Column:
    return F.concat(F.lit("Grade the answer against the expected one: 2 right, 1 partly, 0 wrong. Reply with JSON: {\"score\": 0}\n\nQuestion: "), question, F.lit("\nExpected: "), expected, F.lit("\nAnswer: "), answer)


def judge_score(reply: Column) -> Column:
    """The grade as a share of the best, or null."""
    grade = F.from_json(T.parse_json_reply(reply).cast("string"), "score int")["score"]
    return F.when(grade.between(0, 2), grade / 2)
