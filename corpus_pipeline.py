"""The corpus pipeline: five stages over ``documents``, each one reading all that the one before kept.

quality     rejects documents whose grade is likely below the wanted one
toxicity    rejects toxic documents
near_dedup  keeps one row of each group of near-duplicates, the one of the least doc_id (null ids last)
secrets     replaces secrets in the texts and brings n_chars up to date
packing     packs what is left into sequences of 2048 tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Classifiers learn from the labelled rows among the stage's own input. Null and empty
texts pass the quality stage only if the model keeps them; a null doc_id is a row like any other.
Of repeated rows near_dedup keeps one; texts without shingles have no copies and all stay. Very long texts are
read in blocks by every stage. Of an empty table every stage makes an empty one. Further columns of docs pass through
all stages but the last, whatever their names: the stages' own columns have names that are made anew each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import near_dup, packing, quality, registry, secrets, toxicity
from palimpsest.llm.common import drop_written, table, written

#: SQL cannot express the stages (trained models, sketches, a tokenizer): tests hold them against brute force.
ORACLE_SQL = None


def own_name() -> str:
    """A column name that no table has."""
    return f"_stage_{uuid.uuid4().hex}"


def named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grade, tail = own_name(), own_name()
    graded = quality.score(docs, registry.quality_model(docs, spark, sf_dir), (grade, tail))
    return graded.filter(quality.kept(tail)).select(*named(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = own_name()
    scored = toxicity.scored(docs, registry.toxicity_model(docs, spark, sf_dir), score)
    return scored.filter(F.col(score) < 0.5).select(*named(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of one id, or without one, are told apart by a written number
    row = own_name()
    docs_ = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_dup.near_duplicates(docs_.select(F.col(row).alias("doc_id"), "text"))
    rows = docs_.select(F.col(row).alias("row"), "doc_id").join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(groups, "component_id").filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(row))
    return docs_.join(gone, row, "left_anti").select(*named(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*named(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, registry.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written and read again, and deleted once its successor is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = written(made, f"stage-{name}")
            if before is not None:
                drop_written(before)
            before = made
        docs = made
    return docs
