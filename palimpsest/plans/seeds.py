"""Inputs of the registered queries, made from the given tables by plain SQL that Spark and DuckDB both run.

The given chats hold none of the phrases that the rules look for, so each seed adds some by a rule on
the row's numbers; its size follows the table's. A seed is a SELECT over ``{conversations}`` and the
like; ``spark_seed`` runs it over DataFrames, ``ctes`` puts it into the SQL of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PHRASES = [
    "We decided to keep the nightly export in plain files.",
    "Architecture: a queue in front of two workers and a table.",
    "There is a bug in the import of empty rows.",
    "Fixed: the import now skips rows without a key.",
    "We no longer use the old scheduler for this.",
    "I need to rewrite the loader before Friday comes.",
    "We rejected the idea of a second cache layer.",
    "thanks!",
    "The constraint is a budget of two machines.",
    "ok",
    "The login page is broken on small screens.",
    "Right now working on the report for the board.",
    "We used to have one table for each customer.",
    "The project is a small library for reports.",
    "The report must not hold personal data. Requirement: no names in logs.",
]
_CASES = " ".join(f"when {k} then '{p}'" for k, p in enumerate(PHRASES))
#: The phrase alone in every third row of those that have one, else the phrase before the text.
_SAID = f"case (conv_id * 7 + turn) % 19 {_CASES} else '' end"

SEEDS = {
    # a repeat of the first turn in other spacing ends every second conversation
    "messages": f"""select 'c' || cast(conv_id as string) as conversation_id, cast(turn as int) as msg_index, role,
  case when (conv_id * 7 + turn) % 19 < 15 and conv_id % 3 = 0 then {_SAID} else {_SAID} || ' ' || text end as content from {{conversations}}
  union all select 'c' || cast(conv_id as string), 1000, 'user', '  ' || replace({_SAID} || ' ' || text, ' ', '  ') || ' ' from {{conversations}} where turn = 0 and conv_id % 2 = 1""",
    # project 0 holds most
    "memories": f"""select 'm' || cast(conv_id as string) || '-' || cast(turn as string) as id,
  'p' || cast(case when conv_id % 4 = 0 then conv_id % 10 else 0 end as string) as project_id,
  {_SAID} || ' ' || text as content,
  case (conv_id + turn) % 5 when 0 then 'permanent' when 1 then 'task' when 2 then 'resolved' when 3 then 'stale' else 'temporary' end as memory_type,
  cast((conv_id * 3 + turn * 5) % 20 as double) / 20 as importance_score,
  timestamp '2025-01-01 00:00:00' as created_at, timestamp '2025-06-01 00:00:00' - cast((conv_id * 5 + turn) % 90 as int) * interval '1' day as updated_at,
  timestamp '2025-01-01 00:00:00' as accessed_at, 0 as access_count,
  case when (conv_id + turn) % 11 = 0 then 'not json' else '{{{{"knowledge_type":"' || (case (conv_id * 7 + turn) % 19 when 0 then 'decision' when 1 then 'permanent_knowledge' when 2 then 'open_issue' when 3 then 'resolved_issue'
    when 4 then 'stale_info' when 5 then 'current_task' when 6 then 'decision' when 10 then 'open_issue' else 'general' end) || '","status":"' || (case (conv_id * 7 + turn) % 19 when 3 then 'resolved' when 4 then 'stale' when 6 then 'rejected' else 'active' end)
    || '","source_id":"c' || cast(conv_id as string) || '"}}}}' end as metadata,
  'h' || cast(turn as string) as source_hash from {{conversations}}""",
    "projects": "select distinct 'p' || cast(case when conv_id % 4 = 0 then conv_id % 10 else 0 end as string) as id, cast(conv_id % 2 as int) as parity from {conversations} where conv_id % 10 <> 8",
    # a task for every second conversation, each with a word of its own
    "tasks": """select 't' || cast(conv_id as string) as task_id, 'p' || cast(case when conv_id % 4 = 0 then conv_id % 10 else 0 end as string) as project_id,
  't' || cast(conv_id as string) || ' ' || case cast(floor(conv_id / 2) as int) % 8 when 0 then 'fix the import bug in the loader' when 1 then 'Why was the second cache rejected?' when 2 then 'explain the architecture of the queue and workers'
  when 3 then 'implement the report export of each part' when 4 then 'review the old scheduler, which must be simple' when 5 then 'broken login page on small screens' when 6 then 'budget of two machines' else 'what is the complex decision about reports' end as task
  from {conversations} where turn = 0 and conv_id % 2 = 0""",
    "files": """select 'p' || cast(doc_id % 3 as string) as project_id,
  source || case doc_id % 9 when 0 then '/node_modules/' when 1 then '/.hidden/' else '/' end || 'doc_' || cast(doc_id as string) || case doc_id % 6 when 0 then '.py' when 1 then '.ts' when 2 then '.json' when 3 then '.md' when 4 then '.exe' else '.go' end as path,
  case doc_id % 6 when 0 then 'import os' || chr(10) || 'from lib' || cast(doc_id % 7 as string) || '.core import x' || chr(10) || 'def load_' || cast(doc_id as string) || '(a):' || chr(10) || '    class Part' || cast(doc_id % 5 as string) || ':' || chr(10)
    when 1 then 'import x from "./mod' || cast(doc_id % 4 as string) || '"' || chr(10) || 'export function run' || cast(doc_id as string) || '(a) ' || chr(123) || chr(10) || 'export interface Shape ' || chr(123) || chr(10) || 'enum Kind ' || chr(123) || chr(10) || 'export ' || chr(123) || ' Kind as Sort, other ' || chr(125) || chr(10)
    when 5 then 'func (s *Set) Add' || cast(doc_id % 3 as string) || '(x int) ' || chr(123) || chr(10) || 'struct Row ' || chr(123) || chr(10) else '' end || text as content from {documents}""",
}
# the index before: some files were missing, changed or in another place
SEEDS["files_before"] = f"""select project_id, case when n % 17 = 0 then 'moved/' || path else path end as path, case when n % 13 = 0 then content || ' old' else content end as content
  from (select project_id, path, content, length(content) as n from ({SEEDS["files"]}) f) g where n % 11 <> 0"""


def spark_seed(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(SEEDS[name], **tables)


def seed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The seed over the tables of sf_dir."""
    used = [t for t in ("conversations", "documents", "events") if "{" + t + "}" in SEEDS[name]]
    return spark_seed(spark, name, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """The seeds as common table expressions of DuckDB."""
    return "with " + ", ".join(f"{n} as ({SEEDS[n].format(conversations='conversations', documents='documents', events='events')})" for n in names)
