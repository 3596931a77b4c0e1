"""Index of source files: admission, facts, symbols, imports, diff, refresh, retrieval.

files(project_id, path, content) in, one row a file out. Only changed files are read again.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import CONFIG_NAMES, CONFIG_SUFFIXES, EXPORT_LIST, EXPORTED, EXTENSIONS, IMPORTS, MOST_BYTES, MOST_FILES, SKIPPED_FOLDERS, SYMBOLS
from ..functions.text import TokenCounter, estimated_tokens, let
from ..sources.scratch import written
from .grams import candidates, postings
from .tasks import top_keywords


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """The last dotted part of the file's name in lower case; none for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_config(path: Column) -> Column:
    return name_of(path).isin(CONFIG_NAMES) | extension_of(path).isin(CONFIG_SUFFIXES)


def admitted(files: DataFrame) -> DataFrame:
    """Files worth an index: known kinds outside skipped and hidden folders, not too large, the first ones of each project by path.

    Where a project's files end is found over paths alone, of which parts of a project give their first ones, so no task holds
    a project's texts. Only projects of MOST_FILES files or more have such an end: it is one row for so many files, and joined as a
    broadcast. What is left is spread by path; of rows with the last path those of least content come first.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    outside = ~F.exists(folders, lambda f: f.isin(SKIPPED_FOLDERS) | f.startswith("."))
    known = extension_of(F.col("path")).isin(EXTENSIONS) | name_of(F.col("path")).isin(CONFIG_NAMES)
    kept = files.filter(outside & known & ~name_of(F.col("path")).startswith(".") & (F.octet_length("content") <= MOST_BYTES))
    paths = kept.select(F.col("project_id").alias("_project"), F.col("path").alias("_last"), F.pmod(F.xxhash64("path"), F.lit(32)).alias("_part"))
    in_part, in_all = Window.partitionBy("_project", "_part").orderBy("_last"), Window.partitionBy("_project").orderBy("_last")
    first = paths.withColumn("_n", F.row_number().over(in_part)).filter(F.col("_n") <= MOST_FILES)
    placed = first.withColumns({"_n": F.row_number().over(in_all), "_room": MOST_FILES + 1 - F.rank().over(in_all)})
    ends = placed.filter(F.col("_n") == MOST_FILES).select("_project", "_last", "_room")
    within = kept.join(F.broadcast(ends), F.col("project_id").eqNullSafe(F.col("_project")), "left").filter(F.col("_last").isNull() | (F.col("path") <= F.col("_last")))
    numbered = within.withColumn("_n", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("content"))).filter(F.col("_n") <= MOST_FILES)
    return numbered.filter(F.col("_last").isNull() | (F.col("path") < F.col("_last")) | (F.col("_n") <= F.col("_room"))).select(*files.columns)


def all_of(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?md)" + p), F.lit(1)) for p in patterns]))


def export_names(text: Column) -> Column:
    """Declared exports, and the last names in export lists."""
    listed = F.flatten(F.transform(all_of(text, [EXPORT_LIST]), lambda x: F.split(x, ",")))
    last = F.transform(listed, lambda x: F.trim(F.element_at(F.split(F.trim(x), " as "), -1)))
    return F.filter(F.concat(all_of(text, [EXPORTED]), last), lambda x: x != "")


def symbols(text: Column) -> Column:
    """array<struct<name,kind,exported>>, each name of a kind once, in the order of the patterns."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit("(?md)" + p), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(k).alias("kind"))) for k, p in SYMBOLS]))
    exports = F.coalesce(export_names(text), F.array().cast("array<string>"))
    return let(exports, lambda names: F.transform(F.array_distinct(found), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), F.array_contains(names, s["name"]).alias("exported"))))


def imports(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_of(text, IMPORTS), lambda x: F.trim(x)), lambda x: x != "")))


def indexed(files: DataFrame, count_tokens: TokenCounter = estimated_tokens) -> DataFrame:
    """Admitted files with their facts; configuration files have no symbols."""
    text = F.col("content")
    config = is_config(F.col("path"))
    none = F.array().cast("array<struct<name:string,kind:string,exported:boolean>>")
    rows = files.select(
        "project_id", "path", extension_of(F.col("path")).alias("extension"), F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"), count_tokens(text).alias("token_count"),
        F.when(config, none).otherwise(symbols(text)).alias("symbols"), imports(text).alias("imports"), config.alias("is_config"), (F.regexp_count(text, F.lit("\n")) + 1).alias("line_count"))
    return rows.withColumn("exports", F.array_sort(F.array_distinct(F.transform(F.filter("symbols", lambda s: s["exported"]), lambda s: s["name"]))))



def symbol_lines(files: DataFrame) -> DataFrame:
    """(project_id, path, name, kind, line): where each symbol's name stands; offsets need a helper in Python."""

    @F.pandas_udf("array<struct<name:string,kind:string,line:int>>")
    def found(texts: pd.Series) -> pd.Series:
        compiled = [(k, regex.compile(p, regex.M)) for k, p in SYMBOLS]

        def of(text: str) -> list[dict]:
            seen: dict[tuple, dict] = {}
            for kind, pattern in compiled:
                for m in pattern.finditer(text or ""):
                    seen.setdefault((m[1], kind), {"name": m[1], "kind": kind, "line": text.count("\n", 0, m.start(1)) + 1})
            return list(seen.values())

        return texts.map(of)

    rows = files.filter(~is_config(F.col("path"))).select("project_id", "path", F.explode(found("content")).alias("s"))
    return rows.select("project_id", "path", "s.*")


def index_stats(index: DataFrame) -> DataFrame:
    """For each project in all (extension null) and for each extension: files, tokens, symbols, configuration files."""
    rows = index.select("project_id", "extension", "token_count", F.size("symbols").alias("n"), F.col("is_config").cast("int").alias("c"))
    return rows.rollup("project_id", "extension").agg(F.count("*").alias("files"), F.sum("token_count").alias("tokens"), F.sum("n").alias("symbols"), F.sum("c").alias("config_files"), F.grouping_id().alias("_g")).filter("_g < 3").drop("_g")


def dependencies(index: DataFrame) -> DataFrame:
    return index.select("project_id", "path", F.explode("imports").alias("module"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, change, old_path, new_path): added, modified, deleted and renamed files of two (project_id, path, sha256).

    Only paths and hashes are compared. The k-th deleted file of a content, by path, is paired with the k-th added one.
    """
    a = before.select("project_id", F.col("path").alias("old_path"), F.col("sha256").alias("old_sha"))
    b = after.select("project_id", F.col("path").alias("new_path"), F.col("sha256").alias("new_sha"))
    both = a.join(b, (a["project_id"] == b["project_id"]) & (F.col("old_path") == F.col("new_path")), "full_outer").select(F.coalesce(a["project_id"], b["project_id"]).alias("project_id"), "old_path", "new_path", "old_sha", "new_sha")
    modified = both.filter("old_sha <> new_sha").select("project_id", F.lit("modified").alias("change"), "old_path", "new_path")

    def numbered(rows: DataFrame, path: str, sha: str) -> DataFrame:
        order = Window.partitionBy("project_id", sha).orderBy(path)
        return rows.select("project_id", path, F.col(sha).alias("sha"), F.row_number().over(order).alias("k"))

    gone, new = numbered(both.filter("new_path is null"), "old_path", "old_sha"), numbered(both.filter("old_path is null"), "new_path", "new_sha")
    moved = gone.join(new, ["project_id", "sha", "k"], "full_outer")
    change = F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    return modified.unionByName(moved.select("project_id", change.alias("change"), "old_path", "new_path"))


def applied(index: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """The index after changes: rows that stay, and the touched ones of files indexed anew."""
    touched = changes.filter(F.col("new_path").isNotNull()).select("project_id", F.col("new_path").alias("path")).distinct()
    left = changes.filter(F.col("old_path").isNotNull()).select("project_id", F.col("old_path").alias("path")).unionByName(touched).distinct()
    kept = index.join(left, ["project_id", "path"], "left_anti")
    return kept.unionByName(indexed(files.join(touched, ["project_id", "path"], "left_semi")).select(*kept.columns))


def refresh(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index brought up to admitted files: paths and hashes are compared first, and only touched files are indexed.

    index is read twice: give a table. Hashes and changes are written, so files are gone through once for their hashes and once
    for the touched ones.
    """
    hashes = files.select("project_id", "path", F.sha2("content", 256).alias("sha256"))
    changes = written(diff(index.select("project_id", "path", "sha256"), written(hashes, "hashes")), "changes")
    return applied(index, changes, files)


def file_cards(index: DataFrame) -> DataFrame:
    """(project_id, path, content): a memory's text for each file."""
    names = F.transform(F.slice("symbols", 1, 8), lambda s: s["name"])
    card = F.concat(F.lit("File "), "path", F.when(F.size(names) > 0, F.concat(F.lit(" defines "), F.array_join(names, ", "))).otherwise(""),
                    F.when(F.size("imports") > 0, F.concat(F.lit("; imports "), F.array_join(F.slice("imports", 1, 6), ", "))).otherwise(""))
    return index.select("project_id", "path", card.alias("content"))


def relevant_files(tasks: DataFrame, index: DataFrame, limit: int = 5, sets_a_part: int = 64) -> DataFrame:
    """(task_id, rank, path, score): files of a task's project by how often its keywords occur in path, symbols and imports.

    A project's keywords, each once whatever the tasks, meet the files by four letters of them (keywords have four at
    least); a file and a keyword that it holds are counted once, and tasks with the same keywords in a project are scored once. The work
    follows the files and the hits, not files times tasks. A word that many sets of keywords share is dealt in parts of
    sets_a_part sets, so no task sums all of its hits; the window keeps each set's best files before it shuffles.
    """
    distinct = tasks.select("project_id", "task").distinct().withColumn("task_id", F.to_json(F.struct("project_id", "task")))
    each = top_keywords(distinct).groupBy("task_id").agg(F.array_sort(F.collect_list("word")).alias("words")).join(distinct.select("task_id", "project_id"), "task_id")  # ten words a task at most
    keyed = written(each.select("task_id", "project_id", "words", F.to_json(F.struct("project_id", "words")).alias("set_id")), "task-words")
    asked = keyed.select("project_id", "set_id", "words").distinct().select("project_id", "set_id", F.explode("words").alias("word"))
    text = F.lower(F.concat_ws(" ", "path", F.array_join(F.transform("symbols", lambda s: s["name"]), " "), F.array_join("imports", " ")))
    files = written(index.select("project_id", F.col("path").alias("key"), text.alias("text")), "file-words")  # names only, read twice
    words = asked.groupBy("project_id", "word").agg(F.ceil(F.count("*") / sets_a_part).cast("int").alias("parts"))
    met = candidates(words.select("project_id", F.col("word").alias("needle"), F.array("word").alias("parts")), postings(files, 4), 4)
    count = 2.0 * (F.length("text") - F.length(F.replace(F.col("text"), F.col("needle"), F.lit("")))) / F.length("needle")
    points = files.join(met, ["project_id", "key"]).select("project_id", F.col("key").alias("path"), F.col("needle").alias("word"), (count + F.when(F.contains(F.lower("key"), "needle"), 2.0).otherwise(0.0)).alias("points"))
    dealt = asked.join(words, ["project_id", "word"]).select("project_id", "word", F.pmod(F.xxhash64("set_id"), "parts").cast("int").alias("part"), "set_id")
    copies = points.filter("points > 0").join(words, ["project_id", "word"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    scores = copies.join(dealt, ["project_id", "word", "part"]).groupBy("set_id", "path").agg(F.round(F.sum("points"), 3).alias("score"))
    order = Window.partitionBy("set_id").orderBy(F.desc("score"), "path")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    given = tasks.select("task_id", F.to_json(F.struct("project_id", "task")).alias("_key"))
    return best.join(keyed.select(F.col("task_id").alias("_key"), "set_id"), "set_id").join(given, "_key").select("task_id", "rank", "path", "score")
