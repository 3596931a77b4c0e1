"""Registered queries of ranking, tasks and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import COMMON_WORDS, EASY, GAPS, HARD, INTENT_BOOSTS, NEEDED_KNOWLEDGE, STOP_WORDS, TASK_TYPES
from ..operators import context, relevance, tasks
from .ingest_queries import NOW_SQL, STRIP, TOKENS, _memories, now, quoted
from .seeds import ctes, seed


def _tasks(spark, d):
    return seed(spark, d, "tasks")


def _asked(spark, d):
    return _tasks(spark, d).select(F.col("task_id").alias("query_id"), "project_id", F.col("task").alias("query"))


def _ranked(spark, d, limit=10, demote=False):
    return relevance.ranked(_memories(spark, d), _asked(spark, d), relevance.layered_score(now(), demote), limit)


def query_keywords(spark, d):
    rows = relevance.prepared_queries(_asked(spark, d))
    return rows.select("query_id", F.array_join("q_words", ",").alias("words"))


def intent_boosts(spark, d):
    return relevance.intent_boosts(_asked(spark, d))


def ranked_search(spark, d):
    return _ranked(spark, d).select("query_id", "rank", "id", "score", F.array_join("reasons", "; ").alias("reasons"))


def task_analysis(spark, d):
    rows = tasks.analysed(_tasks(spark, d))
    return rows.select("task_id", "task", F.array_join("keywords", ",").alias("keywords"), "task_type", "complexity", F.array_join("required_knowledge_types", ",").alias("required"))


def top_keywords(spark, d):
    return tasks.top_keywords(_memories(spark, d).select(F.col("id").alias("task_id"), F.regexp_replace("content", "[^ -~]+", " ").alias("task")))


def context_gaps(spark, d):
    return tasks.gaps(_tasks(spark, d), context.knowledge(_ranked(spark, d, 3)).withColumnRenamed("query_id", "task_id"))


def knowledge_projection(spark, d):
    return context.knowledge(_ranked(spark, d)).select("query_id", "rank", "id", "source_type", "source_title", "title", "knowledge_type", "score")


def context_decisions(spark, d):
    return context.knowledge(_ranked(spark, d)).filter("knowledge_type = 'decision'").select("query_id", "rank", "id")


def current_state(spark, d):
    state = context.current_state(_memories(spark, d), ("open_issue", "issue"))
    return state.select("project_id", F.array_join("active_issues", "|").alias("active_issues"), F.array_join("recent_decisions", "|").alias("recent_decisions"))


QUERIES = {f.__name__: f for f in (query_keywords, intent_boosts, ranked_search, task_analysis, top_keywords, context_gaps, knowledge_projection, context_decisions, current_state)}


def _list(words):
    return "[" + ", ".join(map(quoted, words)) + "]"


def _any(column, words):
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[a-zA-Z][a-zA-Z0-9_+#.]{{1,}}'), lambda w: not list_contains(" + _list(STOP_WORDS).replace("{", "{{") + ", w) and length(w) > 2)"
_PLAIN = r"list_filter(regexp_extract_all(lower({0}), '\b[a-zA-Z]+\b'), lambda w: not list_contains(" + _list(COMMON_WORDS) + ", w) and length(w) > 3)"
_BOOSTS = "boosts(word, category, boost) as (values " + ", ".join(f"('{w}', '{c}', {b}::double)" for w, own in INTENT_BOOSTS.items() for c, b in own.items()) + ")"
#: ordered and distinct
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def scored_sql(queries: str, limit: int, most: int = 200) -> str:
    """CTEs up to ranked(query_id, rank, id, score, reasons, kind, ...) for a CTE asked(query_id, project_id, query)."""
    return f"""{_BOOSTS}, asked as ({queries}),
  aq as (select query_id, project_id, lower({STRIP.format('query')}) as q, {_WORDS.format(STRIP.format('query'))} as q_words from asked),
  qw as (select query_id, trim(unnest(string_split_regex(q, '\\s+')), '?.,!') as word from aq),
  qb as (select query_id, category, greatest(1.0, max(boost)) as boost from qw join boosts using (word) group by 1, 2),
  pool as (select * from (select *, row_number() over (partition by project_id order by importance_score desc, updated_at desc, id) as pool_rank from memories) where pool_rank <= {most}),
  pm as (select *, lower(content) as text, list_distinct({_WORDS.format('content')}) as words, coalesce(case when json_valid(metadata) then metadata ->> '$.knowledge_type' end, '') as kind,
    coalesce(case when json_valid(metadata) then metadata ->> '$.status' end, 'active') as status from pool),
  pairs as (select pm.*, aq.query_id, q, list_sort(list_filter(list_distinct(q_words), lambda w: list_contains(words, w)
      or (case when ends_with(w, 's') and length(w) > 3 then list_contains(words, w[1:-2]) or (ends_with(w, 'es') and list_contains(words, w[1:-3])) else list_contains(words, w || 's') end)
      or (length(w) >= 5 and len(list_filter(words, lambda c: length(c) >= 4 and (contains(c, w) or contains(w, c)))) > 0))) as overlap_,
      coalesce(b.boost, 1.0) as boost, s.boost is not null as has_stale, r.boost is not null as has_resolved
    from pm join aq using (project_id) left join qb b on b.query_id = aq.query_id and b.category = pm.kind left join qb s on s.query_id = aq.query_id and s.category = 'stale_info' left join qb r on r.query_id = aq.query_id and r.category = 'resolved_issue'),
  p2 as (select *, q <> '' and contains(text, q) as phrase, len(list_filter(string_split(kind, '_'), lambda p: p <> '' and contains(q, p))) > 0 as named from pairs),
  p3 as (select *, (case when phrase then 2.0 else 0.0 end + case when len(overlap_) > 0 then 0.6 + ln(1.0 + len(overlap_)) else 0.0 end + case when named then 0.5 else 0.0 end)::double as base from p2),
  p4 as (select *, base = 0 and boost > 1.2 as floor_, (case when base = 0 and boost > 1.2 then 0.4 * boost else base end) * boost as boosted, status = 'stale' and not has_stale as d_stale, status = 'resolved' and not has_resolved as d_resolved from p3),
  p5 as (select *, boosted * (case when d_stale then 0.5 when d_resolved then 0.75 when status = 'rejected' then 0.8 else 1.0 end)::double * (0.5 + importance_score) * (0.7 + 0.3 * exp(-greatest((epoch({NOW_SQL}) - epoch(updated_at)) / 86400.0, 0.0) / 30.0)) as raw from p4),
  ranked as (select * from (select *, round(raw, 4) as score, row_number() over (partition by query_id order by round(raw, 4) desc, pool_rank)::int as rank from p5 where raw > 0.05) where rank <= {limit})"""


_ASKED = "select task_id as query_id, project_id, task as query from tasks"
_MT = ctes("memories", "tasks")
_REASONS_LIST = """list_filter([case when phrase then 'exact phrase match' end, case when len(overlap_) > 0 then 'keywords: [''' || array_to_string(overlap_[1:6], ''', ''') || ''']' end, case when named then 'metadata type: ' || kind end,
  case when floor_ then 'intent match: ' || kind end, case when boost <> 1 and boosted > 0 then 'intent boost x' || boost || ' (' || kind || ')' end,
  case when d_stale then 'demoted: stale' when d_resolved then 'demoted: resolved' when status = 'rejected' then 'demoted: rejected approach' end, 'importance ' || importance_score], lambda x: x is not null)"""
_REASONS = f"array_to_string({_REASONS_LIST}, '; ')"
_TYPE = "case " + " ".join(f"when {_any('lower(task)', w)} then '{k}'" for k, w in TASK_TYPES) + " else 'general' end"
_NEED = "list_filter([" + ", ".join(f"case when {_any('lower(task)', w)} then '{k}' end" for k, w in NEEDED_KNOWLEDGE) + "], lambda x: x is not null)"
SQL = {
    "query_keywords": ctes("tasks") + f", k as (select task_id, {_WORDS.format(STRIP.format('task'))} as w from tasks) select task_id as query_id, array_to_string({_UNIQUE.format('w')}, ',') as words from k",
    "intent_boosts": ctes("tasks") + f", {_BOOSTS}, qw as (select task_id as query_id, trim(unnest(string_split_regex(lower(task), '\\s+')), '?.,!') as word from tasks) select query_id, category, greatest(1.0, max(boost))::double as boost from qw join boosts using (word) group by 1, 2",
    "ranked_search": _MT + ", " + scored_sql(_ASKED, 10) + f" select query_id, rank, id, score, {_REASONS} as reasons from ranked",
    "task_analysis": ctes("tasks") + f""", k as (select *, {_PLAIN.format('task')} as w, {_NEED} as need from tasks) select task_id, task, array_to_string(({_UNIQUE.format('w')})[1:10], ',') as keywords, {_TYPE} as task_type,
  case when {_any('lower(task)', HARD)} then 'high' when {_any('lower(task)', EASY)} then 'low' when length(task) > 150 then 'medium' else 'low' end as complexity, case when len(need) > 0 then array_to_string(need, ',') else 'general' end as required from k""",
    "top_keywords": ctes("memories") + f""", k as (select id, {_PLAIN.format("regexp_replace(content, '[^ -~]+', ' ', 'g')")} as w from memories), e as (select id, unnest(w) as word, generate_subscripts(w, 1) as pos from k), c as (select id, word, count(*) as n, min(pos) as first_ from e group by 1, 2)
  select * from (select id as task_id, word, n, row_number() over (partition by id order by n desc, first_)::int as rank from c) where rank <= 10""",
    "context_gaps": _MT + ", " + scored_sql(_ASKED, 3) + ", p as (select task_id, count(id) as n, list(distinct case when kind = '' then 'general' else kind end) as kinds from tasks left join ranked on query_id = task_id group by 1), g as (" + " union all ".join(
        f"select task_id, {quoted(m)} as gap from p where not coalesce(list_contains(kinds, '{k}'), false)" + (f" and n < {few}" if few else "") for k, m, few in GAPS) + ") select * from g",
    "knowledge_projection": _MT + ", " + scored_sql(_ASKED, 10) + " select query_id, rank, id, 'memory' as source_type, coalesce(case when json_valid(metadata) then metadata ->> '$.source_id' end, 'Memory') as source_title, 'Knowledge from ' || id as title, case when kind = '' then 'general' else kind end as knowledge_type, score from ranked",
    "context_decisions": _MT + ", " + scored_sql(_ASKED, 10) + " select query_id, rank, id from ranked where kind = 'decision'",
    "current_state": ctes("memories") + """, t as (select * from (select *, row_number() over (partition by project_id order by importance_score desc, updated_at desc, id) as r, case when json_valid(metadata) then metadata ->> '$.knowledge_type' end as kind from memories where memory_type in ('task', 'state') and importance_score >= 0.5) where r <= 5)
  select project_id, coalesce(string_agg(content, '|' order by r) filter (kind in ('open_issue', 'issue')), '') as active_issues, coalesce(string_agg(content, '|' order by r) filter (kind = 'decision'), '') as recent_decisions from t group by 1""",
}
