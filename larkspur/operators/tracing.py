"""Stage spans, counters and job tags for runs that are made of actions."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "correlation_id string, seq int, name string, ms double, attrs map<string,string>"


@dataclass
class Trace:
    """Spans and counters of one run; jobs inside a stage carry the run's id as a tag."""

    spark: SparkSession
    correlation_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    spans: list[tuple[str, float, dict[str, str]]] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str, **attrs: object) -> Iterator[dict[str, object]]:
        """Times the actions inside; the span is recorded even if they fail."""
        noted, began = dict(attrs), time.perf_counter()
        self.spark.addTag(self.correlation_id)
        try:
            yield noted
        finally:
            self.spark.removeTag(self.correlation_id)
            self.spans.append((name, (time.perf_counter() - began) * 1000, {k: str(v) for k, v in noted.items()}))

    def add(self, counter: str, n: int = 1) -> None:
        self.counters[counter] = self.counters.get(counter, 0) + n

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(self.correlation_id, i, name, ms, attrs) for i, (name, ms, attrs) in enumerate(self.spans)], SCHEMA)


class JsonFormatter(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "logger": record.name, "message": record.getMessage(), **getattr(record, "fields", {})})


class Health:
    """Index statistics that are asked for at most once in ``seconds``."""

    def __init__(self, probe, seconds: float = 15.0, clock=time.monotonic):
        self.probe, self.seconds, self.clock, self.seen = probe, seconds, clock, None

    def check(self) -> dict:
        if self.seen is None or self.clock() - self.seen[0] > self.seconds:
            try:
                self.seen = (self.clock(), {"reachable": True, **self.probe()})
            except Exception as e:
                self.seen = (self.clock(), {"reachable": False, "error": str(e)[:200]})
        return self.seen[1]
