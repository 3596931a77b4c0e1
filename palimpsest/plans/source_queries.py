"""Registered queries of parsing, knowledge extraction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import KNOWLEDGE, WEIGHTY
from ..operators import knowledge
from ..sources import tables, transcripts
from .ingest_queries import STRIP, _messages, quoted
from .retrieval_queries import _any
from .seeds import ctes


def _raw_json(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", "text")
    item = F.struct("turn", F.upper("role").alias("role"), F.col("text").alias("content"))
    return rows.groupBy("conversation_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda i: F.struct(i["role"].alias("role"), i["content"].alias("content"))).alias("turns"))).alias("raw"))


def _raw_text(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", "text")
    said = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# Part\n## "), "role", F.lit("\n"))).when(F.col("turn") % 3 == 1, F.concat("role", F.lit(": "))).otherwise(F.concat(F.lit("**"), "role", F.lit("**\n"))), "text")
    parts = F.array_sort(F.collect_list(F.struct("turn", said.alias("said"))))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(parts, lambda p: p["said"]), "\n").alias("raw"))


def transcript_parse(spark, d):
    return transcripts.parse_text(_raw_text(spark, d))


def json_export_parse(spark, d):
    return transcripts.parse_json(_raw_json(spark, d))


def _sources(spark, d):
    return _messages(spark, d).select(F.lit("p").alias("project_id"), F.concat_ws("/", "conversation_id", F.col("msg_index").cast("string")).alias("source_title"), F.col("content").alias("text"))


def knowledge_extraction(spark, d):
    return knowledge.statements(_sources(spark, d))


def text_chunks(spark, d):
    return knowledge.chunks(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def _raw_tree(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", "text")
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.col("turn").cast("double").alias("create_time"), message.alias("message"))
    # keyed so that the order of keys is not that of time
    return rows.groupBy("conversation_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.sha2(F.concat_ws("-", "conversation_id", F.col("turn").cast("string")), 256), node))).alias("mapping"))).alias("raw"))


def tree_export_parse(spark, d):
    return transcripts.parse_tree(_raw_tree(spark, d))


def _raw_any(spark, d):
    part = F.col("conversation_id").cast("int") % 3
    forms = (_raw_text, _raw_json, _raw_tree)
    rows = [f(spark, d).filter(part == k) for k, f in enumerate(forms)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def raw_input_parse(spark, d):
    return transcripts.parse(_raw_any(spark, d))


def lateral_turns(spark, d):
    tables.register(spark)
    return spark.sql("select r.conversation_id, t.* from {raw} r, lateral chat_turns(r.raw) t", raw=_raw_any(spark, d))


def lateral_chunks(spark, d):
    tables.register(spark)
    return spark.sql("select d.doc_id, c.* from {docs} d, lateral text_chunks(d.text, 1000) c", docs=spark.read.parquet(f"{d}/documents.parquet"))


#: Statements before and after a document's text, by its id.
SAID = ["Architecture: a queue in front of two workers", "We decided to keep one critical table", "nothing of note here", "Problem: the loader stops at empty rows"]


def document_knowledge(spark, d):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit("p").alias("project_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source_title"), F.concat_ws("\n", said, "text", said).alias("text"))
    return knowledge.document_statements(docs).drop("importance")


QUERIES = {f.__name__: f for f in (transcript_parse, json_export_parse, tree_export_parse, raw_input_parse, lateral_turns, knowledge_extraction, document_knowledge, text_chunks, lateral_chunks)}
_BASE = "case kind " + " ".join(f"when '{k}' then {w}::double" for k, w, _ in KNOWLEDGE) + " end"
_K = " union all ".join(f"select source_title, '{k}' as kind, {STRIP.format('unnest(regexp_extract_all(text, ' + quoted(p) + ', 1))')} as content from src" for k, _, ps in KNOWLEDGE for p in ps)
_PARSED = f"select cast(conv_id as string) as conversation_id, (row_number() over (partition by conv_id order by turn) - 1)::int as msg_index, role, {STRIP.format('text')} as content from conversations where {STRIP.format('text')} <> ''"


def chunks_sql(docs: str) -> str:
    """CTEs up to chunks_(doc_id, chunk, start, text) of docs(doc_id, text): a chunk ends after the last of . ! ? and line feeds among its last hundred characters."""
    cut = r"length(regexp_extract(substring(text, greatest(start + 900, start) + 2, 100), '^(?s:.*)[.!?\n]', 0))"
    end = f"case when length(text) <= 1000 then length(text) when start + 1000 >= length(text) then start + 1000 when {cut} > 0 then start + 901 + {cut} else start + 1000 end"
    return f"""recursive docs_ as ({docs}), cuts as (select doc_id, text, 0 as chunk, start, {end} as end_ from (select doc_id, text, 0::bigint as start from docs_)
    union all select doc_id, text, chunk, start, {end} from (select doc_id, text, chunk + 1 as chunk, (end_ - 100)::bigint as start from cuts where length(text) > 1000 and end_ - 100 < length(text))),
  chunks_ as (select doc_id, chunk, start, substring(text, start + 1, least(end_, length(text)) - start) as text from cuts)"""


_SAID = "(" + repr(SAID) + ")[(doc_id % 4 + 1)::int]"
_STATED = " union all ".join(f"select doc_id, chunk, text, '{k}' as knowledge_type, '{k.title()}' as named, {STRIP.format('unnest(regexp_extract_all(text, ' + quoted(p) + ', 1))')} as content from chunks_" for k, _, ps in KNOWLEDGE for p in ps)
SQL = {
    **dict.fromkeys(("json_export_parse", "transcript_parse", "tree_export_parse", "raw_input_parse", "lateral_turns"), _PARSED),
    "knowledge_extraction": ctes("messages") + f""", src as (select conversation_id || '/' || msg_index as source_title, content as text from messages), k as ({_K}), b as (select *, {_BASE} as w from k where length(content) > 10), c as (select *, case when {_any('lower(content)', WEIGHTY)} then least(1.0, w + 0.1) else w end as w2 from b)
  select 'p' as project_id, source_title, kind as knowledge_type, content, greatest(0.1, least(1.0, case when length(content) < 20 then w2 * 0.8 else w2 end))::double as importance, left(sha256('p_' || source_title || '_' || content), 16) as id, """ + "case kind " + " ".join(f"when '{k}' then '{k.title()}'" for k, _, _ in KNOWLEDGE) + " end || ' from ' || source_title as title from c",
    "text_chunks": "with " + chunks_sql("select doc_id, coalesce(text, '') as text from documents") + " select doc_id, chunk::int as chunk, start::int as start, text from chunks_",
    "document_knowledge": "with " + chunks_sql(f"select doc_id, concat_ws(chr(10), {_SAID}, text, {_SAID}) as text from documents") + f""", k as ({_STATED}), t as (select *, 'doc ' || doc_id || ' - Chunk ' || (chunk + 1) as source_title from k where length(content) > 10)
  select doc_id, 'p' as project_id, chunk::int as chunk, source_title, sha256(text) as source_hash, case when length(text) > 200 then left(text, 200) || '...' else text end as source_chunk, knowledge_type, content, left(sha256('p_' || source_title || '_' || content), 16) as id, named || ' from ' || source_title as title from t""",
}
SQL["lateral_chunks"] = SQL["text_chunks"]
