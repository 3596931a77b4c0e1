"""Continuous ingestion: messages into findings; at every moment equal to the batch result, however late a message comes.

A result is kept as Parquet in buckets by its key's hash. A micro-batch reads the buckets that it touches,
merges its rows and writes these buckets whole under its own number; a reader lists the folders and opens of each bucket
the one with the highest number. A batch that runs again reads what was there before it and writes the same again,
so nothing counts twice, and nothing but the touched buckets is read or classified again. Of each bucket the newest
version and the one before it stay; older ones are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import classify, dedup_memories, dedup_messages

BUCKETS = 64
_VERSION = re.compile(r"/batch=(\d+)/bucket=(\d+)$")


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, folder: str) -> dict[int, list[tuple[int, str]]]:
    """For each bucket its versions as (batch, path), the newest first. Two folders a bucket and those of a batch at work are all there are."""
    files, place = _hadoop(spark, f"{folder}/batch=*/bucket=*")
    found: dict[int, list[tuple[int, str]]] = {}
    for status in files.globStatus(place) or []:
        path = status.getPath().toString()
        batch, bucket = map(int, _VERSION.search(path).groups())
        found.setdefault(bucket, []).append((batch, path))
    return {bucket: sorted(own, reverse=True) for bucket, own in found.items()}


def latest(spark: SparkSession, folder: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The rows of each bucket (of `only` these, if given) as its last batch (before that number, if one is given) wrote them; None if there are none yet."""
    newest = []
    for bucket, own in versions(spark, folder).items():
        if only is None or bucket in only:
            newest += [path for batch, path in own if before is None or batch < before][:1]
    return spark.read.option("basePath", folder).parquet(*newest) if newest else None


def rewrite(rows: DataFrame, folder: str, number: int) -> None:
    """Writes rows with their column `bucket` as that batch's version of their buckets, and deletes versions that no run of it needs."""
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")
    for own in versions(rows.sparkSession, folder).values():
        for _, path in [v for v in own if v[0] <= number][2:]:
            files, place = _hadoop(rows.sparkSession, path)
            files.delete(place, True)


def merged(batch: DataFrame, folder: str, number: int, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """merge() of the batch's rows and those that its buckets held before."""
    touched = {r.bucket for r in batch.select("bucket").distinct().collect()}  # buckets at most
    old = latest(batch.sparkSession, folder, number, touched)
    if old is not None:
        batch = batch.unionByName(old.select(*batch.columns))
    return merge(batch)


def stream_messages(messages: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges a stream of messages(conversation_id, msg_index, role, content) into out/messages (each content of a conversation once) and out/findings."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.select("conversation_id", "msg_index", "role", "content", bucket_of(F.col("conversation_id"), buckets).alias("bucket"))
        rewrite(merged(rows, f"{out}/messages", number, dedup_messages), f"{out}/messages", number)
        kept = batch.sparkSession.read.option("basePath", f"{out}/messages").parquet(f"{out}/messages/batch={number}")
        found = dedup_memories(classify(kept)).withColumn("bucket", bucket_of(F.col("conversation_id"), buckets))
        rewrite(found, f"{out}/findings", number)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings(spark: SparkSession, out: str) -> DataFrame | None:
    """The structured memory of all messages that have come so far."""
    rows = latest(spark, f"{out}/findings")
    return None if rows is None else rows.drop("bucket", "batch")
