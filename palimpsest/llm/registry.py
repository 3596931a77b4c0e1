"""Queries opN_<name> of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, fim, licenses, media, near_dup, packing, quality, repair, secrets, toxicity, url_filter
from .common import table, written


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; PALIMPSEST_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("PALIMPSEST_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: F.Column) -> F.Column:
    """Every fifth id by its checksum; no model learns from these rows."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).withColumn("spans", F.to_json("spans"))


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels")
    return quality.fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = quality.score(docs.select("doc_id", "text"), quality_model(docs, spark, sf_dir))
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", quality.kept().alias("kept"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item whose id is divisible by 20, against all documents."""
    index = bm25.build_index(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return bm25.search(index, asked, 10).withColumn("score", F.round("score", 4))


OP6_SQL = """
with d as (select row_number() over () as row_id, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words from documents),
s as (select count(*) as n, sum(len(words)) / count(*) as mean from d),
tf as (select row_id, doc_id, len_, term, count(*) as tf from (select row_id, doc_id, len(words) as len_, unnest(words) as term from d) group by all),
q as (select distinct item_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as term from benchmark where item_id % 20 = 0),
df as (select term, count(*) as df from tf group by term),
scored as (select item_id, row_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / mean))) as score
  from q join tf using (term) join df using (term), s group by all),
ranked as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as r from scored)
select item_id as query_id, r::int as rank, doc_id, round(score, 4) as score from ranked where r <= 10
"""


def op6_topk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, against all documents. Rows of one id are one query."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 20 = 0").groupBy(F.col("doc_id").alias("query_id")).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return bm25.search(bm25.build_index(docs), asked, 10, block=2000, skip=False).withColumn("score", F.round("score", 4))


OP6_DOCUMENTS_SQL = """
with d as (select row_number() over () as row_id, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words from documents),
s as (select count(*) as n, sum(len(words)) / count(*) as mean from d),
tf as (select row_id, doc_id, len_, term, count(*) as tf from (select row_id, doc_id, len(words) as len_, unnest(words) as term from d) group by all),
q as (select distinct doc_id as query_id, term from tf where doc_id % 20 = 0),
df as (select term, count(*) as df from tf group by term),
scored as (select query_id, row_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / mean))) as score
  from q join tf using (term) join df using (term), s group by all),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as r from scored)
select query_id, r::int as rank, doc_id, round(score, 4) as score from ranked where r <= 10
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(rank: int) -> F.Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{secrets.KINDS[rank]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.written_out(F.col("base")), 256).alias("base_sha256"), secrets.written_out(F.col("spans")).alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    messages = given.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.read_back(chat.format_turns(messages))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    turns = repair.ordered(repair.damaged(given))
    found = written(repair.reports(turns), "reports")
    digests = repair.repaired_digests(turns, found)
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    known = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = known.join(found, repair.same(known, found, ["conv_id"]), "left").join(digests, repair.same(known, digests, ["conv_id"]), "left")
    return rows.select(known["conv_id"], *[F.coalesce(n, F.lit(0)).alias(n) for n in sums], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.with_fim(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = made.withColumn("back", fim.restored_text(F.col("output"), F.col("form")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


OP12_SQL = r"""
with h as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
c as (select *, len(t) as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from h),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from c),
p as (select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle, array_to_string(t[b + 1:], '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

#: The query's rules, verdict and host with path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_license_scan": op3_license_scan,
        "op4_quality": op4_quality,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_topk_search": op6_topk_search,
        "op6_topk_documents": op6_topk_documents,
        "op7_bpe": op7_bpe,
        "op8_secrets": op8_secrets,
        "op9_chat_format": op9_chat_format,
        "op10_media_columns": op10_media_columns,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk_search": OP6_SQL, "op6_topk_documents": OP6_DOCUMENTS_SQL, "op12_fill_in_middle": OP12_SQL}
