"""Folders for what a job writes on its way, and tables written there once to be read more often."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in spark.checkpoint.dir; in local mode without that setting, in a folder of our own. It stays, as results are read from it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    yield f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: worked out once however often it is used, and lost executors lose nothing of it."""
    with scratch_folder(df.sparkSession, name) as folder:
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
