"""What the corpus operators share: table access, shared checkpoints, text classes.

Intermediate tables are cut with ``DataFrame.checkpoint`` into the folder that the
session names in ``spark.checkpoint.dir``; a lost executor then costs a re-read,
never a recomputation of a whole iteration.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (" ", "\n", "\t", "\r", "\x0b", "\x0c")

#: Used only if the session names no checkpoint folder and runs on one machine (tests, notebooks); a cluster must name one.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/larkspur"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def squeezed(text: Column) -> Column:
    """The text without any white space character; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def bucket_of(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % F.lit(modulus)


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over slices of at most ``rows`` rows; what a task has freed goes back to the system at its end.

    Workers are kept for later tasks, and without that each keeps the most it ever held.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task
