"""Evaluation of memory and retrieval against written expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TokenCounter, estimated_tokens


def expectations_met(expectations: DataFrame, texts: DataFrame) -> DataFrame:
    """(scenario_id, kind, n, found): how many of expectations(scenario_id, kind, needle) texts(scenario_id, text) hold, in any case."""
    rows = expectations.join(texts, "scenario_id", "left").withColumn("hit", F.coalesce(F.contains(F.lower("text"), F.lower("needle")), F.lit(False)))
    by = rows.groupBy("scenario_id", "kind", "needle").agg(F.max("hit").alias("hit"))
    return by.groupBy("scenario_id", "kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("found"))


def scenario_metrics(met: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row a scenario of tokens(scenario_id, original, structured, prepared): retention, removal, reductions and failures; 100 % where nothing is expected.

    prepared: the tokens of the context made for the scenario's task; structured: those of its memories.
    """
    def of(kind: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    by = met.groupBy("scenario_id").agg(*[of(k, c).alias(f"{k}_{c}") for k in ("important", "irrelevant", "decision", "open_issue") for c in ("n", "found")])
    rows = tokens.join(by, "scenario_id", "left").na.fill(0)

    def reduction(column: str):
        return F.when(F.col("original") > 0, F.round((F.col("original") - F.col(column)) / F.col("original") * 100, 1)).otherwise(0.0)

    def percent(part, n):
        return F.when(F.col(n) > 0, F.round(part / F.col(n) * 100, 1)).otherwise(100.0)

    return rows.select(
        "scenario_id", "original", "structured", "prepared", (F.col("prepared") < F.col("original")).alias("is_smaller"), reduction("structured").alias("structured_reduction_pct"), reduction("prepared").alias("reduction_pct"),
        percent(F.col("important_found"), "important_n").alias("retention_pct"), percent(F.col("irrelevant_n") - F.col("irrelevant_found"), "irrelevant_n").alias("removal_pct"), (F.col("irrelevant_n") > 0).alias("has_irrelevant"),
        ((F.col("important_found") < F.col("important_n")) | (F.col("irrelevant_found") > 0) | (F.col("decision_found") < F.col("decision_n")) | (F.col("open_issue_found") < F.col("open_issue_n"))).alias("failed"))


def aggregate(metrics: DataFrame) -> DataFrame:
    """One row over all scenarios; reductions count only where there is one."""
    reduced = F.when(F.col("is_smaller"), F.col("reduction_pct"))
    return metrics.agg(
        F.count("*").alias("scenario_count"), F.count_if(~F.col("is_smaller")).alias("compact_inputs"), F.count(reduced).alias("reduced_inputs"), F.round(F.avg(reduced), 1).alias("avg_reduction"),
        F.round(F.percentile(reduced, 0.5), 1).alias("median_reduction"), F.max(reduced).alias("best_reduction"), F.min(reduced).alias("worst_reduction"), F.round(F.avg("retention_pct"), 1).alias("avg_retention"),
        F.round(F.avg(F.when(F.col("has_irrelevant"), F.col("removal_pct"))), 1).alias("avg_removal"), F.count_if("failed").alias("total_failures"))


def haystacks(texts: DataFrame) -> DataFrame:
    """(scenario_id, text): the lower-cased texts(scenario_id, text) of each scenario, one a line, in order of their text."""
    lines = F.array_sort(F.collect_list(F.lower("text")))  # a scenario is one conversation
    return texts.groupBy("scenario_id").agg(F.array_join(lines, "\n").alias("text"))


def retrieval_hits(results: DataFrame, expected: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    """(query_id, n_results, n_relevant, hit, tokens) for each query of expected(query_id, needle).

    results(query_id, id, file_path, content): a result is relevant if its path holds one of the query's needles, in any case.
    """
    asked = expected.groupBy("query_id").agg(F.collect_set(F.lower("needle")).alias("needles"))  # written by people: a few
    rows = asked.join(results.select("query_id", F.lower(F.coalesce("file_path", F.lit(""))).alias("path"), count_tokens(F.col("content")).alias("t")), "query_id", "left")
    relevant = F.exists("needles", lambda n: F.contains("path", n))
    by = rows.groupBy("query_id").agg(F.count("path").alias("n_results"), F.count_if(relevant).alias("n_relevant"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return by.select("query_id", "n_results", "n_relevant", (F.col("n_relevant") > 0).alias("hit"), "tokens")


def hit_rate(hits: DataFrame) -> DataFrame:
    """One row: queries, the percentage of those with a relevant result, and the mean tokens of their results."""
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("double")) * 100, 1).alias("hit_rate_pct"), F.round(F.avg("tokens"), 2).alias("mean_tokens"))
