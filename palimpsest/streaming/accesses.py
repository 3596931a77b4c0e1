"""Accesses to memories, counted as they come: a windowed aggregate in the state store, small deltas, a compacted base.

The stream keeps counts of (day, id) under a watermark, so its state holds the open days only. Each micro-batch writes the new
totals of what it changed as one delta; totals, not differences, so a batch that runs again changes nothing. After every
`compact_every` deltas they go into the base, of which only the days that they name are replaced, and are deleted. A
reader takes base and deltas together and of each (day, id) the total of the highest batch, which is right at every
moment of a compaction: a delta that is in the base already says the same again.

What a read touches is one base and fewer than `compact_every` deltas, however many batches there were. Accesses later
than `delay` behind the newest one are not counted (Spark's rule for watermarks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import COLUMNS, tracked

_SCHEMA = "id string, n long, last timestamp, batch long, day string"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delta_numbers(spark: SparkSession, out: str) -> list[int]:
    """The batches whose deltas are whole and not yet in the base."""
    files, place = _folder(spark, f"{out}/deltas")
    if not files.exists(place):
        return []
    names = [s.getPath() for s in files.listStatus(place)]
    return sorted(int(p.getName().removeprefix("batch=")) for p in names if p.getName().startswith("batch=") and files.exists(_folder(spark, f"{p}/_SUCCESS")[1]))


def _rows(spark: SparkSession, out: str, numbers: list[int], days: list[str] | None = None) -> DataFrame:
    """The newest total of each (day, id) in the base and these deltas."""
    files, base = _folder(spark, f"{out}/base")
    parts = [spark.read.schema(_SCHEMA).parquet(*[f"{out}/deltas/batch={n}" for n in numbers])] if numbers else []
    if files.exists(base):
        parts.append(spark.read.schema(_SCHEMA).parquet(f"{out}/base"))
    rows = parts[0] if parts else spark.createDataFrame([], _SCHEMA)
    for other in parts[1:]:
        rows = rows.unionByName(other)
    if days is not None:
        rows = rows.filter(F.col("day").isin(days))
    newest = F.max_by(F.struct("n", "last", "batch"), "batch")
    return rows.groupBy("day", "id").agg(newest.alias("t")).select("id", "t.*", "day")


def counts(spark: SparkSession, out: str) -> DataFrame:
    """(id, n, last) of all accesses that have come so far."""
    return _rows(spark, out, delta_numbers(spark, out)).groupBy("id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def compact(spark: SparkSession, out: str) -> None:
    """Brings all deltas into the base; only their days' folders are replaced."""
    numbers = delta_numbers(spark, out)
    if not numbers:
        return
    found = spark.read.schema(_SCHEMA).parquet(*[f"{out}/deltas/batch={n}" for n in numbers])
    days = [r.day for r in found.select("day").distinct().toLocalIterator()]  # those that the watermark leaves open
    rows = _rows(spark, out, numbers, days)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/base")
    for n in numbers:
        files, place = _folder(spark, f"{out}/deltas/batch={n}")
        files.delete(place, True)


def stream_accesses(log: DataFrame, out: str, checkpoint: str, delay: str = "1 day", compact_every: int = 20) -> StreamingQuery:
    """Counts a stream of accesses(id, ts) into out."""
    totals = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    day = F.date_format("window.start", "yyyy-MM-dd")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "n", "last", F.lit(number).cast("long").alias("batch"), day.alias("day"))
        rows.write.mode("overwrite").parquet(f"{out}/deltas/batch={number}")
        if len(delta_numbers(batch.sparkSession, out)) >= compact_every:
            compact(batch.sparkSession, out)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_accesses(memories: DataFrame, out: str) -> DataFrame:
    """memories with the accesses that have come so far, as store.tracked() counts them in a batch."""
    return tracked(memories.select(*COLUMNS), counts(memories.sparkSession, out))
