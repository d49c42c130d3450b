"""A sink to, and a paged scan of, an index behind a caller's client.

The client is any object with ``push(actions) -> list of rejected keys`` and
``page(doc_id, skip, top) -> rows``; it is made on the executors by ``connect``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

BATCH, PAGE = 100, 1000
ACTIONS = ("mergeOrUpload", "merge", "delete")


class RemoteFailure(Exception):
    """A failed call, with its status and a retry delay if the service names one."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def with_retry(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
    """``call`` with retries on statuses that may pass, waiting twice as long each time or as told."""
    for attempt in range(R.RETRY_ATTEMPTS):
        try:
            return call()
        except RemoteFailure as e:
            if e.status not in R.RETRYABLE or attempt == R.RETRY_ATTEMPTS - 1:
                raise
            sleep(min(R.RETRY_CAP_SECONDS, e.retry_after if e.retry_after is not None else 0.5 * 2**attempt))
    raise AssertionError


def send(rows: DataFrame, action: str, connect: Callable[[], object], key: str = "chunk_id") -> DataFrame:
    """(sent, rejected) per batch after pushing ``rows`` in batches; reading the result does the work."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}")

    def run(pages: Iterator) -> Iterator:
        import pandas as pd

        client = connect()
        for page in pages:
            records = page.to_dict("records")
            for at in range(0, len(records), BATCH):
                part = [{"action": action, **r} for r in records[at : at + BATCH]]
                rejected = with_retry(lambda part=part: client.push(part))
                yield pd.DataFrame({"sent": [len(part)], "rejected": [[str(k) for k in rejected]]})

    return (rows.select(key) if action == "delete" else rows).mapInPandas(run, "sent long, rejected array<string>")


def scan_documents(spark: SparkSession, doc_ids: DataFrame, connect: Callable[[], object], schema: str) -> DataFrame:
    """Remote rows of each document, page by page."""

    def run(pages: Iterator) -> Iterator:
        import pandas as pd

        client = connect()
        for page in pages:
            for doc_id in page["doc_id"]:
                skip = 0
                while rows := with_retry(lambda doc_id=doc_id, skip=skip: client.page(doc_id, skip, PAGE)):
                    yield pd.DataFrame(rows)
                    skip += len(rows)
                    if len(rows) < PAGE:
                        break

    return doc_ids.select("doc_id").mapInPandas(run, schema)


def rejected(results: DataFrame) -> DataFrame:
    """(key): all keys that the service refused. Keep ``results`` first, since reading them sends."""
    return results.select(F.explode("rejected").alias("key"))
