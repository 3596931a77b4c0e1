"""Knowledge from documents: overlapping chunks, five kinds of statements, their importance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import KNOWLEDGE, WEIGHTY
from ..functions.text import holds_any, stripped


def chunk_bounds(text: str, size: int = 1000, back: int = 100) -> list[tuple[int, int]]:
    """Starts and ends of chunks: each ends after the last sentence end within `back` characters of its full size, the next one starts `back` before that."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            window = text[max(end - back, start) + 1 : end + 1]
            cut = max(window.rfind(c) for c in ".!?\n")
            end = end if cut < 0 else max(end - back, start) + 1 + cut + 1
        out.append((start, min(end, len(text))))
        start = end - back
    return out


def chunks(docs: DataFrame, size: int = 1000, also: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) as rows (doc_id, chunk, start, text) and the columns `also`; each cut depends on the one before, so a helper in Python makes them."""

    @F.pandas_udf("array<struct<chunk:int,start:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk": k, "start": a, "text": t[a:b]} for k, (a, b) in enumerate(chunk_bounds(t or "", size))] if t else [{"chunk": 0, "start": 0, "text": ""}])

    kept = ["doc_id", *(also or [])]
    return docs.select(*kept, F.explode(cut("text")).alias("c")).select(*kept, "c.*")


def importance(kind: Column, text: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for k, w, _ in KNOWLEDGE for x in (k, w)])
    base = F.coalesce(F.try_element_at(weight, kind), F.lit(0.5))
    more = F.when(holds_any(F.lower(text), WEIGHTY), F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.when(F.length(text) < 20, more * 0.8).otherwise(more)))


def statements(rows: DataFrame) -> DataFrame:
    """rows(project_id, source_title, text) with each statement longer than ten characters: knowledge_type, content, importance, id, title."""
    found = [_kind(kind, p) for kind, _, patterns in KNOWLEDGE for p in patterns]
    kept = [c for c in rows.columns if c != "text"]
    out = rows.select(*kept, F.explode(F.filter(F.flatten(F.array(*found)), lambda s: F.length(s["content"]) > 10)).alias("s")).select(*kept, "s.*")
    names = F.create_map(*[F.lit(x) for k, _, _ in KNOWLEDGE for x in (k, k.title())])
    return out.withColumns({
        "importance": importance(F.col("knowledge_type"), F.col("content")),
        "id": F.substring(F.sha2(F.concat_ws("_", "project_id", "source_title", "content"), 256), 1, 16),
        "title": F.concat(names[F.col("knowledge_type")], F.lit(" from "), "source_title"),
    })


def document_statements(docs: DataFrame, size: int = 1000) -> DataFrame:
    """statements of docs(doc_id, project_id, source_title, text) chunk by chunk, with the chunk's number in the source title, its hash and its first 200 characters.

    Chunks overlap, so what lies in two of them is there twice, under two ids.
    """
    parts = chunks(docs, size, ["project_id", "source_title"])
    excerpt = F.when(F.length("text") > 200, F.concat(F.left("text", F.lit(200)), F.lit("..."))).otherwise(F.col("text"))
    title = F.concat("source_title", F.lit(" - Chunk "), (F.col("chunk") + 1).cast("string"))
    return statements(parts.select("doc_id", "project_id", "chunk", title.alias("source_title"), F.sha2("text", 256).alias("source_hash"), excerpt.alias("source_chunk"), "text"))


def _kind(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit("(?d)" + pattern), F.lit(1)), lambda g: F.struct(F.lit(kind).alias("knowledge_type"), stripped(g).alias("content")))
