"""The memory table on disk: partitions by project and part of its ids, bucketed and sorted by id, changed in place.

A change touches the partitions of its ids and no others, so a few new rows of a hot project replace a few of its
parts, not all of it. They are replaced by dynamic partition overwrite, which stages new files before it swaps folders. Within them the change is joined by id, the bucket column, so only
the change itself is shuffled and the table's side never is. An id belongs to one project, as it is made from it.

One writer at a time; a reader may meet a missing folder for the moment of a swap. Each change is idempotent, so a write that
was cut off is mended by doing it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import COLUMNS, new_memories, update

_KINDS = {"importance_score": "double", "created_at": "timestamp", "updated_at": "timestamp", "accessed_at": "timestamp", "access_count": "int"}
_OWN = [c for c in COLUMNS if c != "project_id"] + ["write_seq"]
_PLACE = ["project_id", "part"]
#: Up to so many touched partitions are named in the scan's partition filter; beyond, a semi join prunes at run time.
NAMED = 1000


class MemoryTable:
    """The table of this name (created if there is none) below folder. parts: of a project's ids; choose them so that a part is what one change may rewrite."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 8, parts: int = 16):
        self.spark, self.name, self.folder, self.buckets, self.parts = spark, name, folder, buckets, parts
        columns = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in _OWN)
        spark.sql(
            f"create table if not exists {name} ({columns}, project_id string, part int) using parquet options (partitionOverwriteMode 'dynamic') "
            f"partitioned by (project_id, part) clustered by (id) sorted by (id) into {buckets} buckets location '{folder}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*COLUMNS)

    def merge(self, rows: DataFrame, now: Column, ordered: bool = False) -> None:
        """store.upsert of rows(project_id, content, memory_type, importance_score, metadata, write_seq) into the table.

        ordered: a row takes the place of one that was written before it in write_seq's order only, so batches may come in any order.
        """
        added = new_memories(rows, now, keep_seq=True).withColumn("part", self._part())
        new = added.select(*[F.col(c).alias(f"new_{c}") for c in [*_OWN, *_PLACE]])
        old = self._partitions(added.select(*_PLACE))
        both = old.join(new, old["id"] == new["new_id"], "full_outer")
        taken = F.col("new_id").isNotNull()
        if ordered:
            taken = taken & (F.col("write_seq").isNull() | (F.col("new_write_seq") >= F.col("write_seq")))
        self._replace(both.select(*[F.when(taken, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in [*_OWN, *_PLACE]]))

    def update(self, changes: DataFrame, now: Column) -> None:
        """store.update by changes(id, content, importance_score, metadata)."""
        self._rewrite(changes, lambda old: update(old, changes, now, also=("write_seq", "part")))

    def delete(self, ids: DataFrame) -> None:
        """store.delete of ids(id). A project without rows loses its folder."""
        gone = ids.select("id").distinct()
        every = self.spark.table(self.name).select("id", *_PLACE)
        emptied = every.join(gone.withColumn("gone", F.lit(1)), "id", "left").groupBy(*_PLACE).agg(F.count("*").alias("n"), F.count("gone").alias("gone")).filter("n = gone")
        emptied = [(r.project_id, str(r.part)) for r in emptied.select(*_PLACE).toLocalIterator()]
        self._rewrite(gone, lambda old: old.join(gone, "id", "left_anti"))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        named = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        files = hadoop(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for project, part in emptied:
            folder = hadoop(self.folder, named("project_id", project))
            files.delete(hadoop(folder, named("part", part)), True)
            if not files.listStatus(folder):
                files.delete(folder, True)
        self.spark.catalog.refreshTable(self.name)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def _partitions(self, places: DataFrame) -> DataFrame:
        """The table's rows in these partitions."""
        table, asked = self.spark.table(self.name), places.distinct()
        named: dict[str, list[int]] = {}
        for place in (found := asked.limit(NAMED + 1).collect()):
            named.setdefault(place.project_id, []).append(place.part)
        if len(found) > NAMED:
            return table.join(asked, _PLACE, "left_semi")
        wanted = F.lit(False)
        for project, parts in named.items():
            wanted = wanted | ((F.col("project_id") == project) & F.col("part").isin(parts))
        return table.filter(wanted)

    def _rewrite(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        touched = self.spark.table(self.name).select("id", *_PLACE).join(ids.select("id").distinct(), "id", "left_semi").select(*_PLACE)
        self._replace(change(self._partitions(touched)))

    def _replace(self, rows: DataFrame) -> None:
        rows.select(*_OWN, *_PLACE).write.insertInto(self.name, overwrite=True)
