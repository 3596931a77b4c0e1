"""Raw transcripts and JSON exports as messages(conversation_id, msg_index, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import ROLES
from ..functions.text import stripped

#: How roles are written in transcripts.
_MARKER = r"(?i)^(?:#{1,4}\s*)?(?:\*\*)?(user|human|assistant|ai|system|chatgpt|claude|gpt|cursor|copilot)(?:\*\*)?\s*[:：]?\s*$"
_INLINE = r"(?i)^(?:\*\*)?(user|human|assistant|ai|system)(?:\*\*)?[:：]\s*(.*)$"
_TITLE, _ROLE_TITLE = r"(?i)^#{1,4}\s+", r"(?i)^#{1,4}\s(?:user|human|assistant|ai|system)"
_KEYS = ["messages", "conversation", "turns", "history", "chat"]


def canonical_role(word: Column, default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(word)), F.lit(default))


def numbered(rows: DataFrame) -> DataFrame:
    """rows(conversation_id, pos, role, content): blank contents go, the others are counted from 0 in order of pos."""
    kept = rows.withColumn("content", stripped(F.col("content"))).filter("content <> ''")
    order = Window.partitionBy("conversation_id").orderBy("pos")
    return kept.select("conversation_id", (F.row_number().over(order) - 1).alias("msg_index"), "role", "content")


def parse_text(raw: DataFrame) -> DataFrame:
    """Messages of raw(conversation_id, raw): a line can be a title (dropped), a role, a role with text, or text."""
    lines = raw.select("conversation_id", F.posexplode(F.split(stripped(F.col("raw")), r"\R")).alias("line", "text"))
    bare = stripped(F.col("text"))
    title = bare.rlike(_TITLE) & ~bare.rlike(_ROLE_TITLE)
    marker, inline = F.regexp_extract(bare, _MARKER, 1), F.regexp_extract(bare, _INLINE, 1)
    rows = lines.select(
        "conversation_id", "line",
        F.when(title, "title").when(marker != "", "marker").when(inline != "", "inline").otherwise("text").alias("kind"),
        F.when(title, None).when(marker != "", canonical_role(marker)).when(inline != "", canonical_role(inline)).alias("role"),
        F.when(inline != "", F.regexp_extract(bare, _INLINE, 2)).otherwise(F.col("text")).alias("text"))
    so_far = Window.partitionBy("conversation_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"segment": F.sum((F.col("kind") != "text").cast("int")).over(so_far), "role": F.coalesce(F.last("role", ignorenulls=True).over(so_far), F.lit("user"))})
    said = rows.filter(F.col("kind").isin("text", "inline"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))  # the lines of one message
    messages = said.groupBy("conversation_id", "segment").agg(F.first("role").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("content"))
    return numbered(messages.withColumnRenamed("segment", "pos"))


def json_messages(raw: Column) -> Column:
    """array<struct<role,content>> of a JSON export: an array, or an object with one under a known key; blank contents are null. Null for anything else."""
    data = F.try_parse_json(raw)
    lists = F.coalesce(F.try_variant_get(data, "$", "array<variant>"), *[F.try_variant_get(data, f"$.{k}", "array<variant>") for k in _KEYS])

    def message(item: Column) -> Column:
        def text(*paths: str) -> Column:
            return F.coalesce(*[F.try_variant_get(item, p, "string") for p in paths])

        parts = F.array_join(F.try_variant_get(item, "$.content.parts", "array<string>"), " ")
        content = stripped(F.coalesce(parts, text("$.content", "$.text", "$.message")))
        return F.struct(canonical_role(text("$.role", "$.author")).alias("role"), F.when(content != "", content).alias("content"))

    return F.transform(lists, message)


def parse_json(raw: DataFrame) -> DataFrame:
    """Messages of JSON exports. Other rows give none. A null content counts as absent."""
    items = raw.select("conversation_id", F.posexplode(json_messages(F.col("raw"))).alias("pos", "m"))
    return numbered(items.select("conversation_id", "pos", "m.role", "m.content"))


def parse(raw: DataFrame) -> DataFrame:
    """Messages of raw(conversation_id, raw) whatever each row is: a JSON export, one with a mapping of nodes, else a transcript.

    A JSON export without a usable message is read as a transcript too; an empty mapping gives no messages.
    """
    usable = F.exists(json_messages(F.col("raw")), lambda m: m["content"].isNotNull())
    tree = F.try_variant_get(F.try_parse_json("raw"), "$.mapping", "map<string,variant>").isNotNull() & json_messages(F.col("raw")).isNull()
    form = F.when(F.coalesce(usable, F.lit(False)), "json").when(F.coalesce(tree, F.lit(False)), "tree").otherwise("text")
    rows = raw.withColumn("_form", form)
    parsers = {"json": parse_json, "tree": parse_tree, "text": parse_text}
    found = [parser(rows.filter(F.col("_form") == k).drop("_form")) for k, parser in parsers.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def parse_tree(raw: DataFrame) -> DataFrame:
    """Messages of exports with a mapping of nodes, by creation time; nodes of unknown roles are dropped."""
    node = "struct<create_time:double,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
    nodes = raw.select("conversation_id", F.posexplode(F.map_values(F.from_json(F.get_json_object("raw", "$.mapping"), f"map<string,{node}>"))).alias("pos", "n"))
    rows = nodes.filter(F.col("n.message.author.role").isin(list(ROLES)))
    order = F.struct(F.coalesce("n.create_time", F.lit(0.0)), "pos")
    return numbered(rows.select("conversation_id", order.alias("pos"), canonical_role(F.col("n.message.author.role")).alias("role"), F.array_join("n.message.content.parts", " ").alias("content")))


def read_text(spark, path: str) -> DataFrame:
    """raw(conversation_id, raw): a transcript a file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conversation_id"), F.col("value").alias("raw"))
