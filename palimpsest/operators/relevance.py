"""Layered relevance of memories for many queries at once, with reasons.

A project's pool is cut to its best rows before the join, keywords are worked out once for each
memory and each query, indexes tell which pairs can score at all, and those are scored by column expressions. ``scorer``
can be any function that takes the joined rows and returns them with ``score`` and ``reasons``; it sees the pairs that have
a word, a kind or a phrase in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.patterns import INTENT_BOOSTS
from ..functions.text import keywords, stem_variants, stripped
from ..sources.scratch import written
from .grams import candidates, grams, postings
from .store import metadata_map, timestamp_of, top

Scorer = Callable[[DataFrame], DataFrame]


def intent_words(query: Column) -> Column:
    return F.transform(F.split(stripped(F.lower(query)), r"\s+"), lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", ""))


def boost_table(spark) -> DataFrame:
    """(word, category, boost): the fixed table."""
    rows = [(w, c, b) for w, own in INTENT_BOOSTS.items() for c, b in own.items()]
    return spark.createDataFrame(rows, "word string, category string, boost double")


def intent_boosts(queries: DataFrame) -> DataFrame:
    """(query_id, category, boost): the largest boost of each category that the query's words name, 1 at least."""
    words = queries.select("query_id", F.explode(intent_words(F.col("query"))).alias("word"))
    found = words.join(F.broadcast(boost_table(queries.sparkSession)), "word")  # a fixed table
    return found.groupBy("query_id", "category").agg(F.greatest(F.lit(1.0), F.max("boost")).alias("boost"))


def prepared_queries(queries: DataFrame) -> DataFrame:
    """queries(project_id, query, ...) with what scoring needs of them."""
    trimmed = stripped(F.col("query"))
    return queries.select(*queries.columns, F.lower(trimmed).alias("q"), F.array_distinct(keywords(trimmed)).alias("q_words"), intent_words(F.col("query")).alias("q_intent"))


def stand_ins(word: Column) -> Column:
    """The words that match a query's word: itself, its singular or plural, and if it is long its parts of four letters or more."""
    n = F.length(word)
    sizes = F.sequence(F.lit(4), n)
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(word, at, k))))
    return F.when(n >= 5, F.array_distinct(F.concat(stem_variants(word), inner))).otherwise(stem_variants(word))


def prepared_memories(memories: DataFrame, pool: int) -> DataFrame:
    meta = metadata_map(F.col("metadata"))
    rows = top(memories, pool).withColumnRenamed("rank", "pool_rank")
    return rows.select("*", F.lower("content").alias("text"), F.array_distinct(keywords(F.col("content"))).alias("words"), meta.alias("meta"))


def kind_of(meta: Column) -> Column:
    return F.coalesce(meta["knowledge_type"], F.lit(""))


def is_named(kind: Column, q: Column) -> Column:
    """Whether the query holds a part of the kind's name."""
    return F.exists(F.split(kind, "_"), lambda p: (p != "") & F.contains(q, p))


def keyword_hits(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """(project_id, query, id, overlap): the query's words that a memory has: equal, as singular or plural, or one within the other.

    Each word of a project's queries meets each word of its memories once, by equality with what stands for it, or by four
    letters of the words that hold it; queries and memories then come to the words.
    """
    words = pool.select("project_id", "id", F.explode("words").alias("word"))
    known = words.select("project_id", "word").distinct()
    wanted = asked.select("project_id", "query", F.explode("q_words").alias("q_word"))
    each = wanted.select("project_id", "q_word").distinct()
    same = each.select("project_id", "q_word", F.explode(stand_ins(F.col("q_word"))).alias("word")).join(known, ["project_id", "word"])
    within = known.select("project_id", "word", F.explode(grams(F.col("word"), 4)).alias("gram")).join(each.filter(F.length("q_word") >= 5).withColumn("gram", F.left("q_word", F.lit(4))), ["project_id", "gram"])
    matches = same.select("project_id", "q_word", "word").unionByName(within.filter(F.contains("word", "q_word")).select("project_id", "q_word", "word")).distinct()
    found = matches.join(words, ["project_id", "word"]).select("project_id", "q_word", "id").distinct()
    return wanted.join(found, ["project_id", "q_word"]).groupBy("project_id", "query", "id").agg(F.array_sort(F.collect_list("q_word")).alias("overlap"))


def likely_pairs(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """(project_id, query, id, overlap): every pair that layered_score can give a score, and few others.

    A pair scores by common words, by the memory's kind (which the query names or boosts), or as a phrase. A phrase with a
    keyword inside has that word in common; only queries without one look for their letters.
    """
    none = F.array().cast("array<string>")
    kinds = pool.select("project_id", kind_of(F.col("meta")).alias("kind"), "id")
    boosted = F.coalesce(boost_of(F.col("kind"), F.col("q_intent"), False), F.lit(1.0)) > 1.2
    by_kind = asked.join(kinds.select("project_id", "kind").distinct(), "project_id").filter(is_named(F.col("kind"), F.col("q")) | boosted)
    by_kind = by_kind.select("project_id", "query", "kind").join(kinds, ["project_id", "kind"]).select("project_id", "query", "id", none.alias("overlap"))
    inside = F.regexp_replace("q", r"^[a-z0-9_+#.]+|[a-z0-9_+#.]+$", "")
    bare = asked.filter((F.col("q") != "") & (F.size(keywords(inside)) == 0)).select("project_id", "query", "q")
    texts = pool.select("project_id", F.col("id").alias("key"), "text")
    by_letters = candidates(bare.filter(F.length("q") >= 3).select("project_id", F.col("query").alias("needle"), F.array("q").alias("parts")), postings(texts, 3), 3)
    short = bare.filter(F.length("q") < 3).join(texts, "project_id").filter(F.contains("text", "q")).select("project_id", F.col("query").alias("needle"), "key")
    phrases = by_letters.unionByName(short).select("project_id", F.col("needle").alias("query"), F.col("key").alias("id"), none.alias("overlap"))
    every = keyword_hits(pool, asked).unionByName(by_kind).unionByName(phrases)
    return every.groupBy("project_id", "query", "id").agg(F.max("overlap").alias("overlap"))  # an empty list is below all others


def boost_of(category: Column, words: Column, demote: bool) -> Column:
    """The query's boost of one category; null if no word names it. Entries below 1 count as 1 unless demote."""
    table = F.create_map(*[F.lit(x) for w, own in INTENT_BOOSTS.items() for c, b in own.items() for x in (f"{w}:{c}", b)])
    most = F.array_max(F.transform(words, lambda w: F.try_element_at(table, F.concat(w, F.lit(":"), category))))
    return most if demote else F.when(most.isNotNull(), F.greatest(most, F.lit(1.0)))


def layered_score(as_of: Column, demote: bool = False) -> Scorer:
    """The default scorer. as_of: the time from which ages count. demote: let boosts below 1 demote."""

    def score(rows: DataFrame) -> DataFrame:
        kind = kind_of(F.col("meta"))
        status = F.coalesce(F.col("meta")["status"], F.lit("active"))
        rows = rows.withColumns({
            "_kind": kind, "_status": status, "_overlap": F.col("overlap"),
            "_phrase": (F.col("q") != "") & F.contains("text", "q"),
            "_boost": F.coalesce(boost_of(kind, F.col("q_intent"), demote), F.lit(1.0)),
            "_stale": boost_of(F.lit("stale_info"), F.col("q_intent"), demote).isNotNull(), "_resolved": boost_of(F.lit("resolved_issue"), F.col("q_intent"), demote).isNotNull(),
        })
        n = F.size("_overlap")
        named = is_named(F.col("_kind"), F.col("q"))
        words = F.when(n > 0, 0.6 + F.log1p(n.cast("double"))).otherwise(0.0)
        base = F.when(F.col("_phrase"), 2.0).otherwise(0.0) + words + F.when(named, 0.5).otherwise(0.0)
        rows = rows.withColumns({"_named": named, "_base": base})
        floor = (F.col("_base") == 0) & (F.col("_boost") > 1.2)
        boosted = F.when(floor, 0.4 * F.col("_boost")).otherwise(F.col("_base")) * F.col("_boost")
        stale, resolved = (F.col("_status") == "stale") & ~F.col("_stale"), (F.col("_status") == "resolved") & ~F.col("_resolved")
        rejected = F.col("_status") == "rejected"
        state = F.when(stale, 0.5).when(resolved, 0.75).when(rejected, 0.8).otherwise(1.0)
        age = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp("updated_at")) / 86400.0, F.lit(0.0))
        if isinstance(rows.schema["updated_at"].dataType, StringType):
            rows = rows.withColumn("updated_at", timestamp_of(F.col("updated_at")))
        recency = F.when(F.col("updated_at").isNull(), 1.0).otherwise(0.7 + 0.3 * F.exp(-age / 30.0))
        total = boosted * state * (0.5 + F.col("importance_score")) * recency
        shown = F.concat(F.lit("keywords: ['"), F.array_join(F.slice("_overlap", 1, 6), "', '"), F.lit("']"))
        boost_text = F.concat(F.when(F.col("_boost") > 1, "intent boost x").otherwise("intent demote x"), F.col("_boost").cast("string"), F.lit(" ("), "_kind", F.lit(")"))
        reasons = F.array_compact(F.array(
            F.when(F.col("_phrase"), "exact phrase match"), F.when(n > 0, shown), F.when(F.col("_named"), F.concat(F.lit("metadata type: "), "_kind")),
            F.when(floor, F.concat(F.lit("intent match: "), "_kind")), F.when((F.col("_boost") != 1) & (boosted > 0), boost_text),
            F.when(stale, "demoted: stale").when(resolved, "demoted: resolved").when(rejected, "demoted: rejected approach"), F.concat(F.lit("importance "), F.col("importance_score").cast("string"))))
        rows = rows.withColumns({"score": total, "reasons": reasons})
        return rows.drop("_kind", "_status", "_overlap", "_phrase", "_boost", "_stale", "_resolved", "_named", "_base")

    return score


def search_pool(memories: DataFrame, pool: int = 200) -> DataFrame:
    """The rows that searches look at, `pool` of each project at most, prepared and written once; for any number of ranked()."""
    return written(prepared_memories(memories, pool), "pool")


def ranked(memories: DataFrame, queries: DataFrame, scorer: Scorer, limit: int = 10, pool: int = 200, least: float = 0.05, prepared: DataFrame | None = None) -> DataFrame:
    """The best memories for each of queries(query_id, project_id, query): score above least, rounded to four places, ties in pool order.

    Equal queries of a project are scored once. Pairs come from indexes over words, kinds and letters of each project's
    pool (`pool` rows at most) and are dealt by query and memory, so neither a hot project nor its queries share a task.
    prepared: search_pool(memories, pool), where it is used more than once. Ids are unique in a project.
    """
    rows = search_pool(memories, pool) if prepared is None else prepared
    asked = written(prepared_queries(queries.select("project_id", "query").distinct()), "asked")
    pairs = likely_pairs(rows, asked).join(rows.drop("words"), ["project_id", "id"]).join(asked.drop("q_words"), ["project_id", "query"])
    kept = scorer(pairs).filter(F.col("score") > least).withColumn("score", F.round("score", 4))
    best = Window.partitionBy("project_id", "query").orderBy(F.desc("score"), "pool_rank")
    found = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).drop("q", "q_intent", "text", "overlap")
    return found.join(queries.select("query_id", "project_id", "query"), ["project_id", "query"])


def exported(rows: DataFrame) -> DataFrame:
    """(query_id, rank, result) of ranked rows: one JSON object each for tools that read results."""
    result = F.struct(F.col("id").alias("memory_id"), "content", "score", "reasons", "memory_type", F.col("importance_score").alias("importance"), F.col("meta")["provenance"].alias("provenance"))
    return rows.select("query_id", "rank", F.to_json(result).alias("result"))
