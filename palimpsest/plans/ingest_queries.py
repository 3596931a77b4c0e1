"""Registered queries of ingestion and the memory table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens
from ..functions.classify import has_hint, is_chatter
from ..functions.patterns import CATEGORIES, CHATTER, HINTS, REJECTED
from ..operators import ingest, store
from ..sources.memory_table import MemoryTable
from ..sources.scratch import scratch_folder
from ..streaming import accesses
from ..streaming.memories import stream_memories
from .seeds import ctes, seed, spark_seed


def now():
    return F.lit("2025-06-15 00:00:00").cast("timestamp")


NOW_SQL = "timestamp '2025-06-15 00:00:00'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- the same rules in DuckDB's words
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORMAL = rf"regexp_replace({STRIP.format('lower({0})')}, '\s+', ' ', 'g')"
TOKENS = "(case when length({0}) = 0 then 0 else greatest(1, length({0}) // 4) end)"


def first_match_sql(patterns: list[str]) -> str:
    import re

    out = []
    for p in patterns:
        whole = STRIP.format(f"regexp_extract(text, {quoted('(?i)' + p)}, 0)")
        if re.compile(p).groups:
            group = f"regexp_extract(text, {quoted('(?i)' + p)}, 1)"
            whole = f"(case when {group} <> '' then {STRIP.format(group)} else {whole} end)"
        out.append(f"case when length({whole}) >= 8 then left({whole}, 400) end")
    return f"coalesce({', '.join(out)})"


UNIQUE_SQL = ctes("messages") + f""", uniq as (select * from (select *, row_number() over (partition by conversation_id, {NORMAL.format('content')} order by msg_index) as n from messages) where n = 1)"""
_CHATTER_SQL = f"(length(text) < 120 and not regexp_matches(text, {quoted('(?i)' + HINTS)}) and ({' or '.join(f'regexp_matches(text, {quoted("(?i)" + p)})' for p in CHATTER)}))"
FOUND_SQL = (
    UNIQUE_SQL
    + f", t as (select *, {STRIP.format('content')} as text from uniq), flagged as (select *, {_CHATTER_SQL} as chatter from t), found as ("
    + " union all ".join(
        [f"select conversation_id, msg_index, role, 0 as class_order, 'irrelevant' as category, text as content, 0.9::double as confidence, 0.05::double as importance, 'active' as status from flagged where chatter"]
        + [
            f"select conversation_id, msg_index, role, {k}, '{c}', hit, {conf}::double, {imp}::double, "
            + (f"case when regexp_matches(text, {quoted('(?i)' + REJECTED)}) then 'rejected' else '{status}' end" if c == "decision" else f"'{status}'")
            + f" from (select *, {first_match_sql(patterns)} as hit from flagged where not chatter) where hit is not null"
            for k, (c, patterns, conf, imp, status, _) in enumerate(CATEGORIES, 1)
        ]
    )
    + f"), kept as (select * from (select *, row_number() over (partition by conversation_id, category, left({NORMAL.format('content')}, 200) order by msg_index, class_order) as n from found) where n = 1)"
)


def _messages(spark, d):
    return seed(spark, d, "messages")


def _extracted(spark, d):
    return ingest.extract(_messages(spark, d))


def message_dedup(spark, d):
    return ingest.dedup_messages(_messages(spark, d))


def chatter_detection(spark, d):
    text = T.stripped(F.col("content"))
    return _messages(spark, d).select("conversation_id", "msg_index", is_chatter(text).alias("chatter"), has_hint(text).alias("hint"))


def message_classifier(spark, d):
    return ingest.classify(ingest.dedup_messages(_messages(spark, d))).drop("class_order")


def memory_dedup(spark, d):
    return _extracted(spark, d).select("conversation_id", "msg_index", "category", "content", "status")


def conversation_stats(spark, d):
    return ingest.conversation_stats(_messages(spark, d))


def category_counts(spark, d):
    return ingest.category_counts(_extracted(spark, d))


def category_rollup(spark, d):
    return ingest.category_rollup(_extracted(spark, d))


def token_breakdown(spark, d):
    return ingest.token_breakdown(_extracted(spark, d))


def compression_report(spark, d):
    return ingest.compression_report(_messages(spark, d))


def chat_token_total(spark, d):
    named = F.when(F.col("msg_index") % 2 == 0, F.concat(F.lit("speaker "), "conversation_id"))
    return ingest.chat_tokens(_messages(spark, d).withColumn("name", named))


def content_hashes(spark, d):
    c = F.col("content")
    return _messages(spark, d).select("conversation_id", "msg_index", T.content_key(c).alias("content_key"), T.conversation_id(c).alias("default_id"), T.memory_id(F.col("conversation_id"), c).alias("memory_id"), T.provenance(F.col("conversation_id"), F.col("msg_index")).alias("provenance"))


def token_reduction(spark, d):
    c = F.col("content")
    rows = _messages(spark, d).select("conversation_id", "msg_index", T.estimated_tokens(c).alias("original_tokens"), T.estimated_tokens(F.left(T.normalized(c), F.lit(200))).alias("optimized_tokens"))
    o, p = F.col("original_tokens"), F.col("optimized_tokens")
    return rows.select("*", (o - p).alias("saved_tokens"), T.reduction_percent(o, p).alias("reduction_percent"), T.reduction_message(o, p).alias("message"))


# --- the memory table
def _memories(spark, d):
    return seed(spark, d, "memories")


def _rows(spark, d):
    with_project = _extracted(spark, d).withColumn("project_id", F.concat(F.lit("p"), (F.regexp_extract("conversation_id", "[0-9]+", 0).cast("int") % 10).cast("string")))
    return store.memory_rows(with_project)


ROWS_SQL = FOUND_SQL + """, rows_ as (select 'p' || cast(cast(conversation_id[2:] as int) % 10 as string) as project_id, content, case category when 'stale_info' then 'stale' when 'decision' then 'permanent' when 'permanent_knowledge' then 'permanent'
  when 'resolved_issue' then 'resolved' else 'task' end as memory_type, importance as importance_score, category, status, conversation_id, msg_index, class_order, role, confidence from kept where category <> 'irrelevant')"""


def store_memories(spark, d):
    rows = _rows(spark, d)
    meta = F.from_json("metadata", "knowledge_type string, source_type string, source_id string, provenance string, message_index int, role string, confidence double, status string")
    return rows.select("project_id", "content", "memory_type", "importance_score", meta.alias("m")).select("project_id", "content", "memory_type", "importance_score", "m.*")


def project_check(spark, d):
    rows, projects = _rows(spark, d), seed(spark, d, "projects")
    known = store.of_known_projects(rows, projects).groupBy("project_id").agg(F.count("*").alias("n")).withColumn("accepted", F.lit(True))
    unknown = store.of_unknown_projects(rows, projects).groupBy("project_id").agg(F.count("*").alias("n")).withColumn("accepted", F.lit(False))
    return known.unionByName(unknown)


def _batch(spark, d):
    """Rows to add: a third of the memories again under their own ids' contents, and all extracted ones."""
    return _rows(spark, d).drop("metadata").withColumn("metadata", F.lit(None).cast("string"))


def memory_upsert(spark, d):
    existing = _memories(spark, d).withColumn("id", T.memory_id(F.col("project_id"), F.col("content"))).dropDuplicates(["id"])
    return store.upsert(existing, _batch(spark, d).unionByName(existing.filter("importance_score >= 0.7").select("project_id", "content", F.lit("task").alias("memory_type"), F.lit(0.33).alias("importance_score"), F.lit("a").alias("write_seq"), F.lit(None).cast("string").alias("metadata"))), now()).select("id", "project_id", "memory_type", "importance_score", "updated_at", "source_hash")


def _changes(spark, d):
    m = _memories(spark, d)
    odd = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    return m.filter(odd % 3 == 0).select("id", F.when(odd % 2 == 0, F.concat(F.lit("new "), "id")).alias("content"), F.when(odd % 5 == 0, 0.95).alias("importance_score"), F.lit(None).cast("string").alias("metadata"))


CHANGES_SQL = ", changes as (select id, case when odd % 2 = 0 then 'new ' || id end as new_content, case when odd % 5 = 0 then 0.95 end as new_score from (select id, ('0x' || sha256(id)[1:2])::int as odd from memories) where odd % 3 = 0)"


def memory_update(spark, d):
    return store.update(_memories(spark, d), _changes(spark, d), now()).select("id", "content", "importance_score", "updated_at", "source_hash")


def memory_delete(spark, d):
    return store.delete(_memories(spark, d), _changes(spark, d)).select("id", "project_id")


def mark_resolved(spark, d):
    issues = _memories(spark, d).filter("memory_type = 'task'").select("project_id", F.col("id").alias("issue"), F.col("id").alias("write_seq"))
    return store.new_memories(store.resolution_rows(issues, now()), now()).select("id", "project_id", "content", "memory_type", "importance_score", F.get_json_object("metadata", "$.issue").alias("issue"), F.get_json_object("metadata", "$.resolution_date").alias("resolved"))


def mark_stale(spark, d):
    marks = _memories(spark, d).filter("memory_type = 'stale'").select("id", F.lit("superseded").alias("reason"))
    out = store.mark_stale(_memories(spark, d), marks, now())
    return out.select("id", "importance_score", "memory_type", "updated_at", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("stale", "stale_reason", "stale_date", "status")])


def metadata_parse(spark, d):
    return _memories(spark, d).select("id", store.metadata_map(F.col("metadata")).alias("m")).select("id", *[F.col("m")[k].alias(k) for k in ("knowledge_type", "status", "source_id")], F.size("m").alias("n_keys"))


def memory_filter(spark, d):
    return store.project_memories(_memories(spark, d), ["task", "permanent"], 0.5, 50).select("project_id", "rank", "id")


def memory_top(spark, d):
    return store.top(_memories(spark, d), 10).select("project_id", "rank", "id", "importance_score")


def _asked(spark, d):
    return seed(spark, d, "tasks").select(F.col("task_id").alias("query_id"), "project_id", F.element_at(F.split("task", " "), -1).alias("query"))


def substring_search(spark, d):
    return store.search(_memories(spark, d), _asked(spark, d), 10).select("query_id", "rank", "id")


def memory_lookup(spark, d):
    ids = seed(spark, d, "tasks").select(F.concat(F.lit("m"), F.substring("task_id", 2, 20), F.lit("-1")).alias("id"))
    return store.lookup(_memories(spark, d), ids).select("id", "content", "access_count")


def stale_cleanup(spark, d):
    return store.without_stale(_memories(spark, d), 30, now()).select("id", "memory_type", "updated_at")


def stale_cleanup_count(spark, d):
    return _memories(spark, d).groupBy("project_id").agg(F.count_if(store.is_stale(30, now())).alias("removed"), F.count("*").alias("n"))


def oversize_routing(spark, d):
    return store.by_size(_memories(spark, d), 600).groupBy("project_id", "accepted").agg(F.count("*").alias("n"))


def access_tracking(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("m"), (F.col("user_id") % 500).cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return store.tracked(_memories(spark, d), log).select("id", "access_count", "accessed_at", "updated_at")


def access_stream(spark, d):
    """access_tracking by a stream of the log; late accesses would be years late."""
    log = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{d}/event[s].parquet")
    log = log.select(F.concat(F.lit("m"), (F.col("user_id") % 500).cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    with scratch_folder(spark, "accesses") as folder:
        accesses.stream_accesses(log, f"{folder}/out", f"{folder}/check", "3650 days").awaitTermination()
        return accesses.with_accesses(_memories(spark, d), f"{folder}/out").select("id", "access_count", "accessed_at", "updated_at")


def memory_stream(spark, d):
    """The memory table after a stream of all messages, a second each."""
    given = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversation[s].parquet")
    number = F.regexp_extract("conversation_id", "[0-9]+", 0).cast("long")
    messages = spark_seed(spark, "messages", conversations=given).withColumns({"project_id": F.concat(F.lit("p"), (number % 10).cast("string")), "ts": F.timestamp_seconds(1_750_000_000 + number * 2000 + F.col("msg_index"))})
    with scratch_folder(spark, "memories") as folder:
        name = "memories_" + folder.rpartition("-")[2]
        table = MemoryTable(spark, name, f"{folder}/table", 2, 4)
        stream_memories(messages, table, f"{folder}/check", now(), "0 seconds").awaitTermination()
        return table.read().select("id", "project_id", "memory_type", "importance_score", "updated_at", "source_hash")


def corpus_stats(spark, d):
    """Distinct messages of all conversations by sketches of each role, against one pass and the exact number."""
    messages = _messages(spark, d)
    merged = ingest.sketched_stats(ingest.message_sketches(messages, ["role"]))
    whole = ingest.sketched_stats(ingest.message_sketches(messages, [])).select(F.col("distinct_messages").alias("once"))
    exact = messages.agg(F.count_distinct(T.content_key(F.col("content"))).alias("exact"))
    rows = merged.withColumn("k", F.lit(0)).join(whole.withColumn("k", F.lit(0)), "k").join(exact.withColumn("k", F.lit(0)), "k")  # a row each
    near = F.abs(F.col("distinct_messages") - F.col("exact")) <= 1 + 4 * 0.83 / 2**7 * F.col("exact")
    return rows.select("message_count", F.col("exact").alias("distinct_messages"), (F.col("distinct_messages") == F.col("once")).alias("merged_as_one"), near.alias("within_bound"))


def model_token_stats(spark, d):
    """conversation_stats by a model's tokens; the vocabulary is a public one of the same kind."""
    import public_tokenizers

    folder = os.environ.get("PALIMPSEST_TOKENIZERS", os.path.dirname(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    words = tokens.Vocabulary(os.path.join(folder, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ingest.conversation_stats(_messages(spark, d), tokens.model_tokens("gpt-4o", {"cl100k_base": words}))


def agent_history(spark, d):
    actions = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action_type"))
    return store.last_actions(actions, 3)


def projects_upsert(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("write_seq"))
    return store.last_of_each(events, "id", "write_seq")


QUERIES = {f.__name__: f for f in (message_dedup, chatter_detection, message_classifier, memory_dedup, conversation_stats, category_counts, category_rollup, token_breakdown, compression_report, chat_token_total, content_hashes, token_reduction,
           store_memories, project_check, memory_upsert, memory_update, memory_delete, mark_resolved, mark_stale, metadata_parse, memory_filter, memory_top, substring_search, memory_lookup, stale_cleanup, stale_cleanup_count, oversize_routing, access_tracking, access_stream, memory_stream, corpus_stats, model_token_stats, agent_history, projects_upsert)}

_M = ctes("memories")
_TOP = "row_number() over (partition by project_id order by importance_score desc, updated_at desc, id)"
_STALE = f"coalesce(memory_type <> 'permanent' and importance_score < 0.7 and updated_at < {NOW_SQL} - interval 30 day, false)"
SQL = {
    "message_dedup": UNIQUE_SQL + " select conversation_id, msg_index, role, content from uniq",
    "chatter_detection": ctes("messages") + f" select conversation_id, msg_index, {_CHATTER_SQL} as chatter, regexp_matches(text, {quoted('(?i)' + HINTS)}) as hint from (select *, {STRIP.format('content')} as text from messages)",
    "message_classifier": FOUND_SQL + " select conversation_id, msg_index, role, category, content, confidence, importance, status, 'Conversation ' || conversation_id || ', Message #' || msg_index as provenance from found",
    "memory_dedup": FOUND_SQL + " select conversation_id, msg_index, category, content, status from kept",
    "conversation_stats": ctes("messages") + f" select conversation_id, count(*) as message_count, count(*) - count(distinct {NORMAL.format('content')}) as duplicate_messages, sum({TOKENS.format('content')})::bigint as original_tokens from messages group by 1",
    "category_counts": FOUND_SQL + " select conversation_id, category, count(*) as n from kept group by 1, 2",
    "category_rollup": FOUND_SQL + " select category, role, status, count(*) as n, grouping_id(category, role, status)::int as level from kept group by cube (category, role, status)",
    "token_breakdown": FOUND_SQL + f" select conversation_id, category, sum({TOKENS.format('content')})::bigint as tokens from kept where category <> 'irrelevant' group by 1, 2",
    "compression_report": FOUND_SQL + f""", a as (select conversation_id, sum({TOKENS.format('content')})::bigint as s from kept where category <> 'irrelevant' group by 1),
  b as (select conversation_id, count(*) as message_count, count(*) - count(distinct {NORMAL.format('content')}) as duplicate_messages, sum({TOKENS.format('content')})::bigint as original_tokens from messages group by 1)
  select conversation_id, message_count, duplicate_messages, original_tokens, coalesce(s, 0) as structured_tokens, case when original_tokens > 0 then round((1 - coalesce(s, 0) / original_tokens) * 100, 2) else 0.0 end as reduction_percent from b left join a using (conversation_id)""",
    "chat_token_total": ctes("messages") + f" select conversation_id, (sum(3 + {TOKENS.format('role')} + {TOKENS.format('content')} + case when msg_index % 2 = 0 then 1 + {TOKENS.format("('speaker ' || conversation_id)")} else 0 end) + 3)::bigint as chat_tokens from messages group by 1",
    "content_hashes": ctes("messages") + f" select conversation_id, msg_index, sha256({NORMAL.format('content')}) as content_key, left(sha256(content), 12) as default_id, left(sha256(conversation_id || ':' || content), 16) as memory_id, 'Conversation ' || conversation_id || ', Message #' || msg_index as provenance from messages",
    "token_reduction": ctes("messages") + f""" select *, original_tokens - optimized_tokens as saved_tokens, case when original_tokens > 0 then round((original_tokens - optimized_tokens) / original_tokens * 100, 2) else 0.0 end as reduction_percent,
  case when optimized_tokens >= original_tokens then 'This input is already compact.' else printf('Estimated context reduction: %.1f%%', round_even((original_tokens - optimized_tokens) / original_tokens * 100, 1)) end as message
  from (select conversation_id, msg_index, {TOKENS.format('content')}::int as original_tokens, {TOKENS.format('left(' + NORMAL.format('content') + ', 200)')}::int as optimized_tokens from messages)""",
    "store_memories": ROWS_SQL + " select project_id, content, memory_type, importance_score, category as knowledge_type, 'conversation' as source_type, conversation_id as source_id, 'Conversation ' || conversation_id || ', Message #' || msg_index as provenance, msg_index as message_index, role, confidence, status from rows_",
    "project_check": ROWS_SQL + f", projects as ({ctes('projects').split('projects as (', 1)[1]} select project_id, count(*) as n, project_id in (select id from projects) as accepted from rows_ group by 1",
    "memory_upsert": ROWS_SQL + f""", memories as ({ctes('memories').split('memories as (', 1)[1]}, existing as (select distinct on (id) * from (select left(sha256(project_id || ':' || content), 16) as id, project_id, content, memory_type, importance_score, updated_at, source_hash from memories)),
  added as (select left(sha256(project_id || ':' || content), 16) as id, project_id, content, memory_type, importance_score, printf('%s:%09d:%d', conversation_id, msg_index, class_order) as seq from rows_
    union all select id, project_id, content, 'task', 0.33, 'a' from existing where importance_score >= 0.7),
  last_ as (select * from (select *, row_number() over (partition by id order by seq desc) as n from added) where n = 1)
  select id, project_id, memory_type, importance_score, updated_at, source_hash from existing where id not in (select id from last_)
  union all select id, project_id, memory_type, importance_score, {NOW_SQL}, sha256(content) from last_""",
    "memory_update": _M + CHANGES_SQL + f" select id, coalesce(new_content, content) as content, coalesce(new_score, importance_score)::double as importance_score, case when new_content is not null or new_score is not null then {NOW_SQL} else updated_at end as updated_at, case when new_content is not null then sha256(new_content) else source_hash end as source_hash from memories left join changes using (id)",
    "memory_delete": _M + CHANGES_SQL + " select id, project_id from memories where id not in (select id from changes)",
    "mark_resolved": _M + " select left(sha256(project_id || ':RESOLVED: ' || id), 16) as id, project_id, 'RESOLVED: ' || id as content, 'resolved' as memory_type, 0.8::double as importance_score, id as issue, '2025-06-15T00:00:00' as resolved from memories where memory_type = 'task'",
    "mark_stale": _M + f""" select id, case when memory_type = 'stale' then 0.1 else importance_score end::double as importance_score, memory_type, case when memory_type = 'stale' then {NOW_SQL} else updated_at end as updated_at,
  case when memory_type = 'stale' then 'true' end as stale, case when memory_type = 'stale' then 'superseded' end as stale_reason, case when memory_type = 'stale' then '2025-06-15T00:00:00' end as stale_date, case when json_valid(metadata) then metadata ->> '$.status' end as status from memories""",
    "metadata_parse": _M + " select id, m ->> '$.knowledge_type' as knowledge_type, m ->> '$.status' as status, m ->> '$.source_id' as source_id, case when m is null then 0 else len(json_keys(m)) end::int as n_keys from (select id, case when json_valid(metadata) then metadata::json end as m from memories)",
    "memory_filter": _M + f" select * from (select project_id, {_TOP}::int as rank, id from memories where importance_score >= 0.5 and memory_type in ('task', 'permanent')) where rank <= 50",
    "memory_top": _M + f" select * from (select project_id, {_TOP}::int as rank, id, importance_score from memories) where rank <= 10",
    "substring_search": ctes("memories", "tasks") + " select * from (select task_id as query_id, row_number() over (partition by task_id order by importance_score desc, updated_at desc, id)::int as rank, id from memories join (select task_id, project_id, string_split(task, ' ')[-1] as query from tasks) using (project_id) where content ilike '%' || query || '%') where rank <= 10",
    "memory_lookup": ctes("memories", "tasks") + " select id, content, access_count from memories where id in (select 'm' || task_id[2:] || '-1' from tasks)",
    "stale_cleanup": _M + f" select id, memory_type, updated_at from memories where not {_STALE}",
    "stale_cleanup_count": _M + f" select project_id, count_if({_STALE})::bigint as removed, count(*) as n from memories group by 1",
    "oversize_routing": _M + " select project_id, length(content) <= 600 as accepted, count(*) as n from memories group by 1, 2",
    "access_tracking": _M + ", log as (select 'm' || (user_id % 500) || '-' || (event_id % 5) as id, count(*) as n, max(ts) as last from events group by 1) select id, (access_count + coalesce(n, 0))::int as access_count, greatest(accessed_at, last) as accessed_at, updated_at from memories left join log using (id)",
    "corpus_stats": ctes("messages") + f" select count(*) as message_count, count(distinct {NORMAL.format('content')}) as distinct_messages, true as merged_as_one, true as within_bound from messages",
    "memory_stream": ROWS_SQL + f""", made as (select *, left(sha256(project_id || ':' || content), 16) as id, row_number() over (partition by project_id, content order by conversation_id desc, msg_index desc, class_order desc) as n from rows_)
  select id, project_id, memory_type, importance_score, {NOW_SQL} as updated_at, sha256(content) as source_hash from made where n = 1""",
    "agent_history": "select agent_id, seq, action_type from (select user_id as agent_id, event_id as seq, event_type as action_type, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 3",
    "projects_upsert": "select id, name, write_seq from (select user_id % 50 as id, event_type as name, event_id as write_seq, row_number() over (partition by user_id % 50 order by event_id desc) as n from events) where n = 1",
}
SQL["access_stream"] = SQL["access_tracking"]
