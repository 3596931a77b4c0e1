"""Registered queries of contexts, runs, second retrieval, exports and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.patterns import CONSTRAINTS, EASY, GAPS, HARD
from ..functions.text import estimated_tokens, memory_id
from ..operators import context, evaluate, index, ingest, relevance, store
from .index_queries import SQL as INDEX_SQL
from .index_queries import _I, _index
from .ingest_queries import FOUND_SQL, NOW_SQL, STRIP, TOKENS, _memories, _messages, now, quoted
from .retrieval_queries import _ASKED, _MT, _PLAIN, _REASONS_LIST, _TYPE, _UNIQUE, _any, _asked, _ranked, _tasks, scored_sql
from .seeds import ctes, seed

AS_OF = "2025-06-15T00:00:00"


def _scorer():
    return relevance.layered_score(now())


def second_pass(spark, d):
    known = _ranked(spark, d, 3).select(F.col("query_id").alias("task_id"), "id")
    return context.extra_memories(_tasks(spark, d), _memories(spark, d), _scorer(), known)


def _projects(spark, d):
    return seed(spark, d, "projects").select("id", F.concat(F.lit("Project "), "id").alias("name")).distinct()


def _packages(spark, d):
    return context.packages(_tasks(spark, d), _memories(spark, d), _scorer(), AS_OF, _index(spark, d), projects=_projects(spark, d))


def context_package(spark, d):
    return _packages(spark, d).select("task_id", "project_id", "context_id", "n_knowledge", F.array_join("files", "|").alias("files"), F.array_join("constraints", "|").alias("constraints"), F.sha2("context_text", 256).alias("text_sha256"), "estimated_tokens")


def context_sections(spark, d):
    packed = context.packages(_tasks(spark, d), _memories(spark, d), _scorer(), AS_OF, projects=_projects(spark, d))
    text = context.sectioned_text(packed)
    return packed.select("task_id", F.sha2(text, 256).alias("text_sha256"), estimated_tokens(text).alias("estimated_tokens"))


def context_export(spark, d):
    return context.exported(_packages(spark, d))


def search_export(spark, d):
    return relevance.exported(_ranked(spark, d))


def context_run_summary(spark, d):
    return context.run_summary(_tasks(spark, d), _memories(spark, d), _scorer(), AS_OF, _projects(spark, d), _index(spark, d))


def context_action_log(spark, d):
    return context.action_log(context.runs(_tasks(spark, d), _memories(spark, d), _scorer(), AS_OF, _projects(spark, d), _index(spark, d)))


def learned_focus(spark, d):
    made = store.new_memories(context.learned_rows(_tasks(spark, d)), now())
    return made.select("id", "project_id", "content", "memory_type", "importance_score", F.get_json_object("metadata", "$.knowledge_type").alias("knowledge_type"))


# --- evaluation: every conversation is a scenario, its memories a project of their own
NEEDLES = [("important", "nightly export"), ("important", "two machines"), ("irrelevant", "thanks!"), ("decision", "second cache"), ("open_issue", "login page")]
_SCENARIO_TASK = "case when cast(substr(conversation_id, 2) as int) % 2 = 0 then 'fix the import bug in the loader' else 'why was the second cache rejected' end"


def _scenarios(spark, d):
    return _messages(spark, d).select("conversation_id").distinct()


def _prepared(spark, d):
    rows = store.memory_rows(ingest.extract(_messages(spark, d)).withColumn("project_id", F.col("conversation_id")))
    asked = _scenarios(spark, d).select(F.col("conversation_id").alias("task_id"), F.col("conversation_id").alias("project_id"), F.expr(_SCENARIO_TASK).alias("task"))
    return context.packages(asked, store.new_memories(rows, now()), _scorer(), AS_OF, limit=12)


def _met(spark, d, packed):
    stored = ingest.extract(_messages(spark, d)).filter("category <> 'irrelevant'").select(F.col("conversation_id").alias("scenario_id"), F.col("content").alias("text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("needle")) for k, n in NEEDLES])
    expected = _scenarios(spark, d).select(F.col("conversation_id").alias("scenario_id"), F.explode(kinds).alias("k")).select("scenario_id", "k.*")
    shown = packed.select(F.col("task_id").alias("scenario_id"), F.explode(F.concat("contents", "decisions", "constraints")).alias("text"))
    important = F.col("kind") == "important"
    either = evaluate.expectations_met(expected.filter(important), evaluate.haystacks(stored.unionByName(shown)))
    return either.unionByName(evaluate.expectations_met(expected.filter(~important), evaluate.haystacks(stored)))


def expectations_met(spark, d):
    return _met(spark, d, _prepared(spark, d))


def scenario_metrics(spark, d):
    packed = _prepared(spark, d)
    tokens = ingest.compression_report(_messages(spark, d)).select(F.col("conversation_id").alias("scenario_id"), F.col("original_tokens").alias("original"), F.col("structured_tokens").alias("structured"))
    tokens = tokens.join(packed.select(F.col("task_id").alias("scenario_id"), F.col("estimated_tokens").alias("prepared")), "scenario_id")
    return evaluate.scenario_metrics(_met(spark, d, packed), tokens)


def evaluation_summary(spark, d):
    return evaluate.aggregate(scenario_metrics(spark, d))


# --- retrieval of files: cards of the index as memories, questions with the paths that should be found
QUESTIONS = [("where is load defined", "doc_1"), ("which file defines the part class", ".py"), ("import of the mod module", ".ts"), ("set add method", ".go"), ("nothing of this kind", "absent/")]


def _cards(spark, d):
    meta = F.to_json(F.struct(F.lit("permanent_knowledge").alias("knowledge_type"), F.lit("active").alias("status"), F.col("path").alias("file_path")))
    cards = index.file_cards(_index(spark, d))
    values = {"id": memory_id(F.col("project_id"), F.col("content")), "memory_type": F.lit("permanent"), "importance_score": F.lit(0.6), "updated_at": now(), "metadata": meta}
    return cards.withColumns(values).drop("path")


def _questions(spark, d):
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("query"), F.lit(n).alias("needle")) for k, (q, n) in enumerate(QUESTIONS)])
    rows = _cards(spark, d).select("project_id").distinct().select("project_id", F.explode(asked).alias("a"))
    return rows.select(F.concat_ws("-", "project_id", F.col("a.k").cast("string")).alias("query_id"), "project_id", "a.query", "a.needle")


def retrieval_hits(spark, d):
    asked = _questions(spark, d)
    found = relevance.ranked(_cards(spark, d), asked, _scorer(), 5, 500)
    return evaluate.retrieval_hits(found.select("query_id", "id", F.col("meta")["file_path"].alias("file_path"), "content"), asked.select("query_id", "needle"))


def retrieval_hit_rate(spark, d):
    return evaluate.hit_rate(retrieval_hits(spark, d))


def document_lookup(spark, d):
    base = _memories(spark, d)
    kept = base.withColumn("content", F.concat(F.lit("document:docs/"), F.substring_index("id", "-", 1), F.lit(".md "), "content"))
    paths = _tasks(spark, d).select("project_id", F.concat(F.lit("docs/m"), F.substring("task_id", 2, 20), F.lit(".md")).alias("path"))
    return store.documents(kept, paths)


def timestamp_parse(spark, d):
    ts = F.col("ts").cast("timestamp")
    said = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "dd/MM/yyyy"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", store.timestamp_of(said).alias("parsed"))


QUERIES = {f.__name__: f for f in (second_pass, context_package, context_sections, context_export, search_export, context_run_summary, context_action_log, learned_focus, expectations_met, scenario_metrics, evaluation_summary, retrieval_hits, retrieval_hit_rate, document_lookup, timestamp_parse)}


def _tagged(sql: str, tag: str) -> str:
    """scored_sql's names with a tag, so that one query can rank twice."""
    return re.sub(r"\b(boosts|asked|aq|qw|qb|pool|pm|pairs|p[2-5]|ranked)\b", lambda m: m[1] + tag, sql)


def _constraints(text: str) -> str:
    found = "[]::varchar[]"
    for p in CONSTRAINTS:
        found = f"list_concat({found}, regexp_extract_all({text}, {quoted(p)}, 0))"
    return f"list_filter(list_transform({found}, lambda x: {STRIP.format('x')}), lambda x: length(x) > 10)"


# texts as a JSON dump in ASCII writes them, and as source code shows them
_CODES = r"when c = '\' then '\\' when c = chr(10) then '\n' when c = chr(13) then '\r' when c = chr(9) then '\t'"
_CHARS = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: case "
_DUMP = (
    "(chr(34) || " + _CHARS + r"when c = chr(34) then '\' || chr(34) " + _CODES + r" when c = chr(8) then '\b' when c = chr(12) then '\f' when unicode(c) between 32 and 126 then c when unicode(c) < 65536 then printf('\u%04x', unicode(c))"
    r" else printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) end), '') || chr(34))"
)
_BODY = _CHARS + _CODES + r" when unicode(c) < 32 or unicode(c) between 127 and 160 or unicode(c) = 173 then printf('\x%02x', unicode(c)) else c end), '')"
_SHOWN = "(case when contains({0}, chr(39)) and not contains({0}, chr(34)) then chr(34) || " + _BODY + " || chr(34) else chr(39) || replace(" + _BODY + r", chr(39), '\' || chr(39)) || chr(39) end)"


def _listed(items: str, one: str) -> str:
    return f"'[' || array_to_string(list_transform({items}, lambda x: {one.replace('{0}', 'x')}), ', ') || ']'"


def packed_sql(limit: int, files: str = "select null::varchar as task_id, null::int as rank, null::varchar as path where false", known: str = "") -> str:
    """CTEs up to packed(task_id, project_id, task, contents, decisions, constraints, paths, context_text, ...) of tasks and memories."""
    kind = "case when kind = '' then 'general' else kind end"
    return f"""{scored_sql(_ASKED, limit)},
  known as (select query_id as task_id, list(content order by rank) as contents, coalesce(list(content order by rank) filter (kind = 'decision'), []) as decisions, list({{'content': content, 'type': {kind}, 'importance': importance_score, 'relevance': score}} order by rank) as items from ranked group by 1),
  state_rows as (select * from (select *, row_number() over (partition by project_id order by importance_score desc, updated_at desc, id) as r, case when json_valid(metadata) then metadata ->> '$.knowledge_type' end as kind from memories where memory_type in ('task', 'state') and importance_score >= 0.5) where r <= 5),
  states as (select project_id, coalesce(list(content order by r) filter (kind = 'issue'), []) as active_issues, coalesce(list(content order by r) filter (kind = 'decision'), []) as recent_decisions from state_rows group by 1),
  file_rows as ({files}), paths as (select task_id, list(path order by rank) as paths from file_rows group by 1),
  packed0 as (select tasks.task_id, tasks.project_id, task, coalesce(contents, []) as contents, coalesce(decisions, []) as decisions, coalesce(items, []) as items, coalesce(paths, []) as paths,
    coalesce(active_issues, []) as active_issues, coalesce(recent_decisions, []) as recent_decisions, left(sha256(tasks.project_id || '_' || task || '_{AS_OF}'), 16) as context_id
    from (select * from tasks{known}) tasks left join known using (task_id) left join states using (project_id) left join paths using (task_id)),
  packed01 as (select *, '{{"last_updated": "{AS_OF}", "active_issues": ' || {_listed('active_issues', _DUMP)} || ', "recent_decisions": ' || {_listed('recent_decisions', _DUMP)} || ', "current_focus": ""}}' as state from packed0),
  packed1 as (select *, {_constraints("task || ' ' || array_to_string(contents, ' ')")} as said from packed01),
  packed2 as (select *, (list_filter(said, lambda x, i: list_position(said, x) = i))[1:5] as constraints from packed1),
  packed as (select *, 'task: ' || task || chr(10) || 'knowledge: ' || array_to_string(contents, ', ') || chr(10) || 'files: ' || array_to_string(paths, ', ') || chr(10) || 'decisions: ' || array_to_string(decisions, ', ') || chr(10) || 'state: ' || state || chr(10) || 'constraints: ' || array_to_string(constraints, ', ') as context_text from packed2)"""


def _second_sql(tasks_: str, known: str) -> str:
    """CTEs up to extra(task_id, extra_rank, id)."""
    return f"""words_ as (select task_id, project_id, ({_UNIQUE.format('w')})[1:10] as w from (select *, {_PLAIN.format('task')} as w from ({tasks_}))),
  long_ as (select task_id, project_id, (list_filter(w, lambda x: length(x) > 4))[1:3] as w from words_),
  terms as (select task_id, project_id, unnest(w) as query, (generate_subscripts(w, 1) - 1)::int as term from long_),
  {_tagged(scored_sql("select task_id || '/' || term as query_id, project_id, query from terms", 3), "_b")},
  fresh as (select t.task_id, term, rank, id, row_number() over (partition by t.task_id, id order by term, rank) as n from ranked_b join terms t on query_id = t.task_id || '/' || term where (t.task_id, id) not in ({known})),
  extra as (select * from (select task_id, row_number() over (partition by task_id order by term, rank)::int as extra_rank, id from fresh where n = 1) where extra_rank <= 3)"""


_FILES = INDEX_SQL["relevant_files"].split("kw as", 1)[1]
_LACK = "lacks as (" + " union all ".join(f"select task_id, {n} as n, {quoted(m)} as gap from packed where not list_contains(list_transform(items, lambda i: i.type), '{k}')" + (f" and len(contents) < {few}" if few else "") for n, (k, m, few) in enumerate(GAPS)) + "), gap_lists as (select task_id, list(gap order by n) as gaps from lacks group by 1)"
_KNOWN = " where project_id in (select id from projects)"
_FULL = (
    _I.replace("with files", ctes("memories", "tasks", "projects") + ", files", 1) + ", "
    + packed_sql(10, "select * from (" + "with k as (select task_id, " + _PLAIN.format("task") + " as w from tasks), e as (select task_id, unnest(w) as word, generate_subscripts(w, 1) as pos from k), c as (select task_id, word, count(*) as n, min(pos) as f from e group by 1, 2), kw as" + _FILES + ")", _KNOWN)
)
_LEARNS = f"({_TYPE} in ('troubleshooting', 'development'))"
_RUNS = _FULL + ", " + _LACK + ", " + _second_sql("select * from tasks where task_id in (select task_id from lacks)", "select query_id, id from ranked") + f""", x as (select task_id, count(*) as n_extra from extra group by 1),
  runs as (select t.task_id, t.project_id, t.task, {_TYPE.replace('lower(task)', 'lower(t.task)')} as task_type, context_id, coalesce(len(contents), 0)::int as n_knowledge, case when context_id is null then 0 else {TOKENS.format('context_text')} end::int as estimated_tokens,
    case when context_id is null then ['project not found'] else coalesce(gaps, []) end as gaps, coalesce(n_extra, 0) as n_extra from tasks t left join packed p on p.task_id = t.task_id left join gap_lists g on g.task_id = t.task_id left join x on x.task_id = t.task_id)"""
_SECTION = "case when len({0}) > 0 then chr(10) || '{1}:' || chr(10) || array_to_string(list_transform({0}, lambda x: '- ' || x), chr(10)) else '' end"
_SCENARIOS = FOUND_SQL + f""", stored as (select * from kept where category <> 'irrelevant'),
  memories as (select * from (select left(sha256(conversation_id || ':' || content), 16) as id, conversation_id as project_id, content, importance as importance_score, {NOW_SQL} as updated_at,
    case category when 'stale_info' then 'stale' when 'decision' then 'permanent' when 'permanent_knowledge' then 'permanent' when 'resolved_issue' then 'resolved' else 'task' end as memory_type,
    to_json({{'knowledge_type': category, 'status': status}})::varchar as metadata, row_number() over (partition by conversation_id, content order by msg_index desc, class_order desc) as n from stored) where n = 1),
  scenarios as (select distinct conversation_id from messages), tasks as (select conversation_id as task_id, conversation_id as project_id, {_SCENARIO_TASK} as task from scenarios),
  {packed_sql(12)},
  e(kind, needle) as (values {', '.join(f"('{k}', '{n}')" for k, n in NEEDLES)}),
  hay as (select task_id as scenario_id, coalesce(lower(string_agg(content, chr(10))), '') as stored_text, lower(array_to_string(list_concat(list_concat(any_value(contents), any_value(decisions)), any_value(constraints)), chr(10))) as shown from packed left join stored on conversation_id = task_id group by 1),
  met as (select scenario_id, kind, count(*) as n, count_if(contains(stored_text, needle) or (kind = 'important' and contains(shown, needle)))::bigint as found from hay cross join e group by 1, 2)"""
_METRICS = _SCENARIOS + f""", o as (select conversation_id as scenario_id, sum({TOKENS.format('content')})::bigint as original from messages group by 1), st as (select conversation_id as scenario_id, sum({TOKENS.format('content')})::bigint as s from stored group by 1),
  sizes as (select o.scenario_id, original, coalesce(s, 0)::bigint as structured, {TOKENS.format('context_text')}::int as prepared from o left join st using (scenario_id) join packed on task_id = o.scenario_id),
  kinds as (select scenario_id, {', '.join(f"coalesce(sum({c}) filter (kind = '{x}'), 0) as {x}_{c}" for x in ('important', 'irrelevant', 'decision', 'open_issue') for c in ('n', 'found'))} from met group by 1),
  metrics as (select scenario_id, original, structured, prepared, prepared < original as is_smaller, case when original > 0 then round((original - structured) / original * 100, 1) else 0.0 end as structured_reduction_pct, case when original > 0 then round((original - prepared) / original * 100, 1) else 0.0 end as reduction_pct,
    case when important_n > 0 then round(important_found / important_n * 100, 1) else 100.0 end as retention_pct, case when irrelevant_n > 0 then round((irrelevant_n - irrelevant_found) / irrelevant_n * 100, 1) else 100.0 end as removal_pct, irrelevant_n > 0 as has_irrelevant,
    important_found < important_n or irrelevant_found > 0 or decision_found < decision_n or open_issue_found < open_issue_n as failed from sizes join kinds using (scenario_id))"""
_HITS = _I + f""", cards as ({INDEX_SQL['file_cards'].removeprefix(_I)}),
  memories as (select left(sha256(project_id || ':' || content), 16) as id, project_id, content, 'permanent' as memory_type, 0.6::double as importance_score, {NOW_SQL} as updated_at, to_json({{'knowledge_type': 'permanent_knowledge', 'status': 'active', 'file_path': path}})::varchar as metadata, path from cards),
  questions(k, query, needle) as (values {', '.join(f"({k}, '{q}', '{n}')" for k, (q, n) in enumerate(QUESTIONS))}), given as (select project_id || '-' || k as query_id, project_id, query, needle from (select distinct project_id from cards) cross join questions),
  {scored_sql('select query_id, project_id, query from given', 5, 500)},
  hits as (select g.query_id, count(r.id) as n_results, count_if(coalesce(contains(lower(r.path), lower(needle)), false))::bigint as n_relevant, coalesce(sum({TOKENS.format('r.content')}) filter (r.id is not null), 0)::bigint as tokens from given g left join ranked r on r.query_id = g.query_id group by 1)"""
SQL = {
    "second_pass": _MT + ", " + scored_sql(_ASKED, 3) + ", " + _second_sql("select * from tasks", "select query_id, id from ranked") + " select * from extra",
    "context_package": _FULL + f" select task_id, project_id, context_id, len(contents)::int as n_knowledge, array_to_string(paths, '|') as files, array_to_string(constraints, '|') as constraints, sha256(context_text) as text_sha256, {TOKENS.format('context_text')}::int as estimated_tokens from packed",
    "context_sections": ctes("memories", "tasks", "projects") + ", " + packed_sql(10, known=_KNOWN) + f""", f as (select *, list_transform(items, lambda i: '[' || i.type || '] ' || i.content) as lines from packed),
  g as (select task_id, 'TASK: ' || task || {_SECTION.format('lines', 'RELEVANT KNOWLEDGE')} || {_SECTION.format('decisions', 'RELEVANT DECISIONS')} || chr(10) || 'CURRENT STATE:' || chr(10) || '- last_updated: {AS_OF}' || chr(10) || '- active_issues: ' || {_listed('active_issues', _SHOWN)}
    || chr(10) || '- recent_decisions: ' || {_listed('recent_decisions', _SHOWN)} || chr(10) || '- current_focus: ' || {_SECTION.format('constraints', 'CONSTRAINTS')} as text from f)
  select task_id, sha256(text) as text_sha256, {TOKENS.format('text')}::int as estimated_tokens from g""",
    "context_export": _FULL + f" select task_id, to_json({{'estimated_tokens': {TOKENS.format('context_text')}::int, 'knowledge': items, 'decisions': decisions, 'constraints': constraints}})::varchar as result from packed",
    "search_export": _MT + ", " + scored_sql(_ASKED, 10) + f" select query_id, rank, to_json({{'memory_id': id, 'content': content, 'score': score, 'reasons': {_REASONS_LIST}, 'memory_type': memory_type, 'importance': importance_score}})::varchar as result from ranked",
    "context_run_summary": _RUNS + f""" select task_id, task_type, case when {_any('lower(task)', HARD)} then 'high' when {_any('lower(task)', EASY)} then 'low' when length(task) > 150 then 'medium' else 'low' end as complexity, n_knowledge as n_candidates, n_knowledge, estimated_tokens,
  array_to_string(gaps, '|') as gaps, n_extra, case when context_id is not null and {_LEARNS} then 'Current focus: ' || task end as learned from runs""",
    "context_action_log": _RUNS + f""", words4 as (select *, ({_UNIQUE.format('w')})[1:4] as top4 from (select *, {_PLAIN.format('task')} as w from runs)),
  steps as (select task_id, list_concat([{{'a': 'Analyzing task', 'd': 'type=' || task_type || ', keywords=' || {_listed('top4', _SHOWN)}}}], case when context_id is null then [{{'a': 'Project lookup', 'd': 'project ' || project_id || ' not found — aborting'}}]
    else list_filter(list_concat(list_concat([{{'a': 'Inspecting project', 'd': 'Project ' || project_id}}, {{'a': 'Searching project knowledge', 'd': n_knowledge || ' candidates scored'}}, {{'a': 'Built optimized context', 'd': n_knowledge || ' knowledge items, ~' || estimated_tokens || ' tokens (estimated)'}}],
      list_transform(gaps, lambda g: {{'a': 'Gap detected', 'd': g}})), [case when len(gaps) = 0 then null when n_extra > 0 then {{'a': 'Retrieved additional information', 'd': n_extra || ' extra memories'}} else {{'a': 'Additional retrieval', 'd': 'nothing more found locally'}} end,
      case when {_LEARNS} then {{'a': 'Updated memory', 'd': 'recorded current task focus'}} end, {{'a': 'Context ready', 'd': 'context_id=' || context_id}}]), lambda s: s is not null) end) as s from words4)
  select task_id, step::int as step, s[step].a as action, s[step].d as detail from (select task_id, s, unnest(generate_series(1, len(s))) as step from steps)""",
    "learned_focus": ctes("tasks") + f" select distinct left(sha256(project_id || ':Current focus: ' || task), 16) as id, project_id, 'Current focus: ' || task as content, 'task' as memory_type, 0.7::double as importance_score, 'current_task' as knowledge_type from tasks where {_TYPE} in ('troubleshooting', 'development')",
    "expectations_met": _SCENARIOS + " select * from met",
    "scenario_metrics": _METRICS + " select * from metrics",
    "evaluation_summary": _METRICS + """ select count(*) as scenario_count, count_if(not is_smaller)::bigint as compact_inputs, count_if(is_smaller)::bigint as reduced_inputs, round(avg(reduction_pct) filter (is_smaller), 1) as avg_reduction, round(median(reduction_pct) filter (is_smaller), 1) as median_reduction,
  max(reduction_pct) filter (is_smaller) as best_reduction, min(reduction_pct) filter (is_smaller) as worst_reduction, round(avg(retention_pct), 1) as avg_retention, round(avg(removal_pct) filter (has_irrelevant), 1) as avg_removal, count_if(failed)::bigint as total_failures from metrics""",
    "retrieval_hits": _HITS + " select query_id, n_results, n_relevant, n_relevant > 0 as hit, tokens from hits",
    "retrieval_hit_rate": _HITS + " select count(*) as queries, round(avg((n_relevant > 0)::int) * 100, 1) as hit_rate_pct, round(avg(tokens), 2) as mean_tokens from hits",
    "document_lookup": _MT + ", m as (select *, 'document:docs/' || string_split(id, '-')[1] || '.md ' || content as said from memories), a as (select distinct project_id, 'docs/m' || task_id[2:] || '.md' as path from tasks), f as (select a.project_id, path, said as content, row_number() over (partition by a.project_id, path order by importance_score desc, updated_at desc, id) as r from a join m on a.project_id = m.project_id and said ilike '%document:' || path || '%') select project_id, path, content from f where r = 1",
    "timestamp_parse": "select event_id, case event_id % 4 when 1 then ts::timestamp when 3 then null else date_trunc('second', ts::timestamp) end as parsed from events",
}
