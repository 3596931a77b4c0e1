"""Messages to structured memory: drop repeats, classify, drop repeats again, report.

Every window and grouping partitions by conversation_id first, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import findings
from ..functions.text import TokenCounter, content_key, estimated_tokens, normalized, provenance


def dedup_messages(messages: DataFrame) -> DataFrame:
    """The first of the messages with equal normalized content in each conversation; roles don't matter."""
    same = Window.partitionBy("conversation_id", "_key").orderBy("msg_index")
    keyed = messages.withColumn("_key", content_key(F.col("content"))).withColumn("_n", F.row_number().over(same))
    return keyed.filter("_n = 1").drop("_key", "_n")


def classify(messages: DataFrame) -> DataFrame:
    """A row for each finding in each message."""
    found = messages.select("conversation_id", "msg_index", "role", F.explode(findings(F.col("content"))).alias("f"))
    return found.select("conversation_id", "msg_index", "role", "f.*").withColumn("provenance", provenance(F.col("conversation_id"), F.col("msg_index")))


def dedup_memories(found: DataFrame) -> DataFrame:
    """The first of the findings of a category with the same first 200 characters, in each conversation."""
    same = Window.partitionBy("conversation_id", "category", "_key").orderBy("msg_index", "class_order")
    keyed = found.withColumn("_key", F.left(normalized(F.col("content")), F.lit(200))).withColumn("_n", F.row_number().over(same))
    return keyed.filter("_n = 1").drop("_key", "_n")


def extract(messages: DataFrame) -> DataFrame:
    """dedup_messages, classify, dedup_memories."""
    return dedup_memories(classify(dedup_messages(messages)))


def conversation_stats(messages: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    """Messages, repeats and tokens of each conversation."""
    rows = messages.select("conversation_id", content_key(F.col("content")).alias("key"), count_tokens(F.col("content")).alias("tokens"))
    by_key = rows.groupBy("conversation_id", "key").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return by_key.groupBy("conversation_id").agg(
        F.sum("n").alias("message_count"), (F.sum("n") - F.count("*")).alias("duplicate_messages"), F.sum("tokens").alias("original_tokens")
    )


def message_sketches(messages: DataFrame, by: list[str], lg_k: int = 14) -> DataFrame:
    """For each value of `by` (a day, a source): messages, and a sketch of their distinct normalized contents. Keep these rows; they add up."""
    return messages.groupBy(*by).agg(F.count("*").alias("message_count"), F.hll_sketch_agg(content_key(F.col("content")), lg_k).alias("sketch"))


def sketched_stats(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages and about how many distinct ones of sketches put together, over all or for each value of `by`.

    However the messages were split, the estimate is that of one sketch over all; its standard error is about 0.83 / sqrt(2 ** lg_k).
    """
    merged = sketches.groupBy(*(by or [])).agg(F.sum("message_count").alias("message_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_messages"))
    return merged.withColumn("duplicate_messages", F.greatest(F.col("message_count") - F.col("distinct_messages"), F.lit(0)))


def category_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("conversation_id", "category").agg(F.count("*").alias("n"))


def category_rollup(memories: DataFrame) -> DataFrame:
    """Counts by category, role and status with subtotals over the whole table."""
    return memories.cube("category", "role", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def token_breakdown(memories: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    kept = memories.filter("category <> 'irrelevant'")
    return kept.groupBy("conversation_id", "category").agg(F.sum(count_tokens(F.col("content"))).alias("tokens"))


def compression_report(messages: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    """For each conversation: tokens before and after, and the reduction, which may be negative."""
    after = token_breakdown(extract(messages), count_tokens).groupBy("conversation_id").agg(F.sum("tokens").alias("structured"))
    both = conversation_stats(messages, count_tokens).join(after, "conversation_id", "left")
    tokens = F.coalesce("structured", F.lit(0))
    percent = F.when(F.col("original_tokens") > 0, F.round((1 - tokens / F.col("original_tokens")) * 100, 2)).otherwise(0.0)
    return both.select("conversation_id", "message_count", "duplicate_messages", "original_tokens", tokens.alias("structured_tokens"), percent.alias("reduction_percent"))


def chat_tokens(messages: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    """Tokens of each conversation as a chat: three for a message and its fields, one more for a name, three for the reply."""
    of_message = 3 + count_tokens(F.col("role")) + count_tokens(F.col("content"))
    if "name" in messages.columns:
        of_message = of_message + F.when(F.col("name").isNotNull(), count_tokens(F.col("name")) + 1).otherwise(0)
    return messages.groupBy("conversation_id").agg((F.sum(of_message) + 3).alias("chat_tokens"))
