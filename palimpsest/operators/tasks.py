"""Task analysis: keywords, type, complexity, needed knowledge; gaps and second retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import COMMON_WORDS, EASY, GAPS, HARD, NEEDED_KNOWLEDGE, TASK_TYPES
from ..functions.text import holds_any


def plain_words(text: Column) -> Column:
    """Words of letters alone, longer than three and not common, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z]+\b"), F.lit(0)), lambda w: ~w.isin(COMMON_WORDS) & (F.length(w) > 3))


def task_keywords(text: Column) -> Column:
    return F.slice(F.array_distinct(plain_words(text)), 1, 10)


def task_type(text: Column) -> Column:
    out, text = F, F.lower(text)
    for kind, words in TASK_TYPES:
        out = out.when(holds_any(text, words), kind)
    return out.otherwise("general")


def complexity(text: Column) -> Column:
    low = F.lower(text)
    hard, easy = holds_any(low, HARD), holds_any(low, EASY)
    return F.when(hard, "high").when(easy, "low").when(F.length(text) > 150, "medium").otherwise("low")


def needed_knowledge(text: Column) -> Column:
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(holds_any(low, words), kind) for kind, words in NEEDED_KNOWLEDGE]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def analysed(tasks: DataFrame) -> DataFrame:
    """tasks(task_id, project_id, task) with their analysis."""
    t = F.col("task")
    return tasks.select("*", task_keywords(t).alias("keywords"), task_type(t).alias("task_type"), complexity(t).alias("complexity"), needed_knowledge(t).alias("required_knowledge_types"))


def top_keywords(tasks: DataFrame, limit: int = 10) -> DataFrame:
    """(task_id, word, n, rank): the most frequent words of each task, first seen first among equals."""
    words = tasks.select("task_id", F.posexplode(plain_words(F.col("task"))).alias("pos", "word"))
    counts = words.groupBy("task_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("task_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("first")


def gaps(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, gap): knowledge types that a task's items(task_id, knowledge_type) lack."""
    present = items.groupBy("task_id").agg(F.collect_set("knowledge_type").alias("present"), F.count("*").alias("n_items"))
    rows = tasks.select("task_id").join(present, "task_id", "left")
    kinds, n = F.coalesce("present", F.array().cast("array<string>")), F.coalesce("n_items", F.lit(0))
    missing = [F.when(~F.array_contains(kinds, kind) & (F.lit(True) if few is None else n < few), message) for kind, message, few in GAPS]
    return rows.select("task_id", F.explode(F.array_compact(F.array(*missing))).alias("gap"))


def second_terms(tasks: DataFrame) -> DataFrame:
    """Queries (query_id, project_id, query, task_id, term) of a second pass: the first three keywords of more than four letters."""
    long_words = F.slice(F.filter(task_keywords(F.col("task")), lambda k: F.length(k) > 4), 1, 3)
    return tasks.select("task_id", "project_id", F.posexplode(long_words).alias("term", "query")).withColumn("query_id", F.concat_ws("/", "task_id", F.col("term").cast("string")))


def second_pass(found: DataFrame, known: DataFrame, limit: int = 3) -> DataFrame:
    """found(task_id, term, rank, id) without known(task_id, id); the first `limit` of each task in term order."""
    first = Window.partitionBy("task_id", "id").orderBy("term", "rank")
    fresh = found.join(known.select("task_id", "id"), ["task_id", "id"], "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = Window.partitionBy("task_id").orderBy("term", "rank")
    return fresh.withColumn("extra_rank", F.row_number().over(order)).filter(F.col("extra_rank") <= limit).select("task_id", "extra_rank", "id")
