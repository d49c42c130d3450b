"""Plans cut where a result is used several times.

A plan is a tree: a table that five later steps read is planned, and often computed, five
times. Where such tables stand above each other the plan grows by their product.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used only if the session names no checkpoint folder and runs on one machine.
LOCAL = "/tmp/checkpoints/larkspur"

Keep = Callable[[DataFrame], DataFrame]


def keeper(spark: SparkSession) -> Keep:
    """A function that computes a table once, as files in the checkpoint folder that all machines share.

    A cluster that names no such folder gets plans that are not cut. Files stay until the
    folder is cleaned.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        return lambda df: df

    def keep(df: DataFrame) -> DataFrame:
        path = f"{named or LOCAL}/tables-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
