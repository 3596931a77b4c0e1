"""The memory table: upserts, updates, filters, retention, access tracking.

memories(id, project_id, content, memory_type, importance_score, created_at, updated_at,
accessed_at, access_count, metadata, source_hash); metadata is JSON. Functions take and return whole
tables and never change their inputs; every time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import CATEGORIES
from ..functions.text import memory_id
from .grams import candidates, postings

COLUMNS = ["id", "project_id", "content", "memory_type", "importance_score", "created_at", "updated_at", "accessed_at", "access_count", "metadata", "source_hash"]


def memory_rows(extracted: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Extracted findings with a project_id as rows to add: chatter is dropped, provenance goes into the metadata. also: further columns to keep."""
    kinds = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[0], c[5])])
    metadata = F.to_json(F.struct(
        F.col("category").alias("knowledge_type"), F.lit("conversation").alias("source_type"), F.col("conversation_id").alias("source_id"), "provenance",
        F.col("msg_index").alias("message_index"), "role", "confidence", "status"))
    kept = extracted.filter("category <> 'irrelevant'")
    order = F.format_string("%s:%09d:%d", "conversation_id", "msg_index", "class_order")
    return kept.select("project_id", "content", F.coalesce(kinds[F.col("category")], F.lit("temporary")).alias("memory_type"), F.col("importance").alias("importance_score"), metadata.alias("metadata"), order.alias("write_seq"), *also)


def of_known_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows whose project exists."""
    return rows.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")


def of_unknown_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    return rows.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_anti")


def new_memories(rows: DataFrame, now: Column, keep_seq: bool = False) -> DataFrame:
    """Rows to add as memories; of several with one id the last written stays. keep_seq: with their write_seq."""
    made = rows.withColumn("id", memory_id(F.col("project_id"), F.col("content")))
    last = Window.partitionBy("id").orderBy(F.desc("write_seq"))
    made = made.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    values = {"created_at": now, "updated_at": now, "accessed_at": now, "access_count": F.lit(0), "source_hash": F.sha2("content", 256)}
    return made.withColumns(values).select(*COLUMNS, *(["write_seq"] if keep_seq else []))


def upsert(memories: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Adds rows; a row with a known id takes the old one's place, and its history starts afresh."""
    added = new_memories(rows, now)
    return memories.join(added.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(added)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def update(memories: DataFrame, changes: DataFrame, now: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """changes(id, content, importance_score, metadata; null where nothing changes; one row an id). New content gets its hash, the id stays."""
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in ("content", "importance_score", "metadata")])
    rows = memories.join(new, "id", "left")
    touched = F.coalesce(*[F.col(f"new_{c}").cast("string") for c in ("content", "importance_score", "metadata")]).isNotNull()
    values = {c: F.coalesce(f"new_{c}", c) for c in ("content", "importance_score", "metadata")}
    values |= {"source_hash": F.when(F.col("new_content").isNotNull(), F.sha2("new_content", 256)).otherwise(F.col("source_hash")), "updated_at": F.when(touched, now).otherwise(F.col("updated_at"))}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in COLUMNS], *also)


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti").select(*memories.columns)


def resolution_rows(issues: DataFrame, now: Column) -> DataFrame:
    """issues(project_id, issue, write_seq) as rows to add; the open issue itself stays as it is."""
    metadata = F.to_json(F.struct("issue", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("resolution_date"), F.lit("resolution").alias("knowledge_type")))
    return issues.select("project_id", F.concat(F.lit("RESOLVED: "), "issue").alias("content"), F.lit("resolved").alias("memory_type"), F.lit(0.8).alias("importance_score"), metadata.alias("metadata"), "write_seq")


def metadata_map(metadata: Column) -> Column:
    """Metadata as a map of strings; what is no JSON object is empty."""
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(metadata, "map<string,string>"), none)


def mark_stale(memories: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """marks(id, reason): importance falls to 0.1 and the metadata says why; type and status stay."""
    rows = memories.join(marks.select("id", "reason"), "id")
    flags = F.create_map(F.lit("stale"), F.lit("true"), F.lit("stale_reason"), F.col("reason"), F.lit("stale_date"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    old = F.map_filter(metadata_map(F.col("metadata")), lambda k, _: ~k.isin("stale", "stale_reason", "stale_date"))
    changes = rows.select("id", F.lit(None).cast("string").alias("content"), F.lit(0.1).alias("importance_score"), F.to_json(F.map_concat(old, flags)).alias("metadata"))
    return update(memories, changes, now)


def top(memories: DataFrame, limit: int) -> DataFrame:
    """The first rows of each project by importance, then by the last update."""
    best = Window.partitionBy("project_id").orderBy(F.desc("importance_score"), F.desc("updated_at"), "id")
    return memories.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def project_memories(memories: DataFrame, types: list[str] | None = None, least: float = 0.0, limit: int = 50) -> DataFrame:
    kept = memories.filter(F.col("importance_score") >= least)
    return top(kept.filter(F.col("memory_type").isin(types)) if types else kept, limit)


def substring_index(memories: DataFrame) -> DataFrame:
    """(project_id, gram, key): which memories hold which three letters. Write it to search the same memories again."""
    return postings(memories.select("project_id", F.col("id").alias("key"), F.lower("content").alias("text")), 3)


def search(memories: DataFrame, queries: DataFrame, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """queries(query_id, project_id, query): memories whose content holds the query in any case; % and _ in it are wild.

    Equal queries of a project are searched once. What stands between wildcards leads to candidates by substring_index
    (worked out if it isn't given), which are then checked whole; only queries without three letters in a row meet all
    memories of their project. Ids are unique in a project.
    """
    literal = F.filter(F.split(F.lower("query"), r"[%_\\]"), lambda p: F.length(p) >= 3)
    asked = queries.select("project_id", "query").distinct().withColumn("parts", literal)
    wild = F.col("query").rlike(r"[%_\\]")
    held = F.when(wild, F.ilike("content", F.concat(F.lit("%"), "query", F.lit("%")))).otherwise(F.contains(F.lower("content"), F.lower("query")))
    found = candidates(asked.filter(F.size("parts") > 0).withColumnRenamed("query", "needle"), substring_index(memories) if index is None else index, 3)
    pairs = memories.join(found.select("project_id", F.col("needle").alias("query"), F.col("key").alias("id")), ["project_id", "id"])
    short = memories.join(asked.filter(F.size("parts") == 0).select("project_id", "query"), "project_id")
    pairs = pairs.select(*memories.columns, "query").unionByName(short.select(*memories.columns, "query"))
    best = Window.partitionBy("project_id", "query").orderBy(F.desc("importance_score"), F.desc("updated_at"), "id")
    kept = pairs.filter(held).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return kept.join(queries.select("query_id", "project_id", "query"), ["project_id", "query"])


def lookup(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories of ids(id), each once."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def documents(memories: DataFrame, paths: DataFrame) -> DataFrame:
    """(project_id, path, content) of paths(project_id, path): the first memory that names document:<path>, if there is one."""
    asked = paths.select("project_id", "path").distinct().withColumn("query_id", F.to_json(F.struct("project_id", "path")))
    found = search(memories, asked.select("query_id", "project_id", F.concat(F.lit("document:"), "path").alias("query")), 1)
    return asked.join(found.select("query_id", "content"), "query_id").select("project_id", "path", "content")


def timestamp_of(text: Column) -> Column:
    """A time written with a space, or with a T with or without fractions of a second; null if it is none of these. The session's time zone should be UTC."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "yyyy-MM-dd'T'HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def is_stale(days: int, now: Column) -> Column:
    old = F.col("updated_at") < now - F.make_dt_interval(F.lit(days))
    return F.coalesce((F.col("memory_type") != "permanent") & (F.col("importance_score") < 0.7) & old, F.lit(False))


def without_stale(memories: DataFrame, days: int, now: Column) -> DataFrame:
    return memories.filter(~is_stale(days, now))


def tracked(memories: DataFrame, log: DataFrame) -> DataFrame:
    """log(id, ts), or counts(id, n, last) of one: each access counts, the last one's time is kept; updated_at doesn't move."""
    seen = log.select("id", "n", "last") if "n" in log.columns else log.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rows = memories.join(seen, "id", "left")
    values = {"access_count": (F.col("access_count") + F.coalesce("n", F.lit(0))).cast("int"), "accessed_at": F.greatest("accessed_at", "last")}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in COLUMNS])


def by_size(rows: DataFrame, most: int) -> DataFrame:
    """rows with `accepted`: whether the content is within the limit."""
    return rows.withColumn("accepted", F.length("content") <= most)


def last_actions(actions: DataFrame, limit: int) -> DataFrame:
    """The most recent actions of each agent; all of them if limit is not above 0."""
    if limit <= 0:
        return actions
    recent = Window.partitionBy("agent_id").orderBy(F.desc("seq"))
    return actions.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= limit).drop("_n")
