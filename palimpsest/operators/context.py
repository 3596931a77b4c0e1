"""Context packages: what of a project's memory matters for a task, as one row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CONSTRAINTS, GAPS
from ..functions.text import TokenCounter, estimated_tokens, json_string, json_strings, quoted_strings, stripped
from ..sources.scratch import written
from . import tasks as task_ops
from .index import relevant_files
from .relevance import Scorer, ranked, search_pool
from .store import metadata_map, of_known_projects, project_memories, search


def knowledge(rows: DataFrame) -> DataFrame:
    """Ranked memories as knowledge items, with defaults for what their metadata lacks."""
    meta = F.col("meta")
    return rows.withColumns({
        "source_type": F.coalesce(meta["source_type"], F.lit("memory")), "source_title": F.coalesce(meta["provenance"], meta["source_id"], F.lit("Memory")),
        "title": F.coalesce(meta["title"], F.concat(F.lit("Knowledge from "), "id")), "knowledge_type": F.coalesce(meta["knowledge_type"], F.lit("general")),
    })


def current_state(memories: DataFrame, issue_types: tuple[str, ...] = ("issue",), limit: int = 5) -> DataFrame:
    """(project_id, active_issues, recent_decisions) from each project's most important tasks."""
    rows = project_memories(memories, ["task", "state"], 0.5, limit).withColumn("kind", metadata_map(F.col("metadata"))["knowledge_type"])
    items = F.array_sort(F.collect_list(F.struct("rank", "kind", "content")))  # `limit` of them at most
    by = rows.groupBy("project_id").agg(items.alias("items"))

    def contents(kinds: tuple[str, ...]) -> Column:
        return F.transform(F.filter("items", lambda i: i["kind"].isin(*kinds)), lambda i: i["content"])

    return by.select("project_id", contents(issue_types).alias("active_issues"), contents(("decision",)).alias("recent_decisions"))


def constraints(text: Column, most: int = 5) -> Column:
    """What must or must not be, each to the end of its line; distinct, in the order of the patterns."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CONSTRAINTS]))
    said = F.filter(F.transform(found, stripped), lambda c: F.length(c) > 10)
    return F.slice(F.array_distinct(said), 1, most)


def packages(tasks: DataFrame, memories: DataFrame, scorer: Scorer, as_of: str, index: DataFrame | None = None, limit: int = 10, count_tokens: TokenCounter = estimated_tokens,
             projects: DataFrame | None = None, prepared: DataFrame | None = None) -> DataFrame:
    """One row for each of tasks(task_id, project_id, task): its knowledge, decisions, state, memory, files, constraints, text and tokens.

    index: the projects' files, of which the most relevant ones go into a package. projects(id): the known ones; a task of
    another gets no package. prepared: relevance.search_pool of the memories, if there is one already. A task's parts are bounded by limit, and equal tasks of a project are worked out once.
    """
    if projects is not None:
        tasks = of_known_projects(tasks, projects)
    asked = tasks.select("project_id", "task").distinct().withColumn("task_id", F.to_json(F.struct("project_id", "task")))
    queries = asked.select(F.col("task_id").alias("query_id"), "project_id", F.col("task").alias("query"))
    items = knowledge(ranked(memories, queries, scorer, limit, prepared=prepared))
    item = F.struct("rank", "id", "knowledge_type", "content", "score", "reasons", F.col("importance_score").alias("importance"))
    known = items.groupBy(F.col("query_id").alias("task_id")).agg(F.array_sort(F.collect_list(item)).alias("knowledge"))
    general = search(memories, queries, 5).groupBy(F.col("query_id").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "content"))).alias("memory"))
    rows = asked.join(known, "task_id", "left").join(general, "task_id", "left").join(current_state(memories), "project_id", "left")
    none = F.array().cast("array<string>")
    if index is None:
        rows = rows.withColumn("files", none)
    else:
        found = relevant_files(asked, index, 5)
        paths = found.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("ranked_files"))
        rows = rows.join(paths, "task_id", "left").withColumn("files", F.coalesce(F.transform("ranked_files", lambda f: f["path"]), none)).drop("ranked_files")
    contents = F.coalesce(F.transform("knowledge", lambda k: k["content"]), none)
    decided = F.coalesce(F.transform(F.filter("knowledge", lambda k: k["knowledge_type"] == "decision"), lambda k: k["content"]), none)
    rows = rows.withColumns({"contents": contents, "decisions": decided, "active_issues": F.coalesce("active_issues", none), "recent_decisions": F.coalesce("recent_decisions", none)})
    rows = rows.withColumn("constraints", constraints(F.concat("task", F.lit(" "), F.array_join("contents", " "))))
    said = [("last_updated", json_string(F.lit(as_of))), ("active_issues", json_strings(F.col("active_issues"))), ("recent_decisions", json_strings(F.col("recent_decisions"))), ("current_focus", F.lit('""'))]
    state = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in said]), F.lit("}"))
    rows = rows.withColumns({"state": state, "last_updated": F.lit(as_of), "context_id": F.left(F.sha2(F.concat_ws("_", "project_id", "task", F.lit(as_of)), 256), F.lit(16))})
    lines = [("task", F.col("task")), ("knowledge", F.array_join("contents", ", ")), ("files", F.array_join("files", ", ")), ("decisions", F.array_join("decisions", ", ")), ("state", F.col("state")), ("constraints", F.array_join("constraints", ", "))]
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])
    rows = rows.withColumn("context_text", text)
    rows = rows.withColumns({"n_knowledge": F.size("contents"), "estimated_tokens": count_tokens(F.col("context_text"))}).drop("task_id")
    return tasks.select("task_id", "project_id", "task").join(rows, ["project_id", "task"])


def sectioned_text(rows: DataFrame) -> Column:
    """The second form of a package's text: headed sections, left out where empty; the state has a line a key."""
    def section(head: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")))

    known = F.transform(F.coalesce("knowledge", F.filter("knowledge", lambda k: F.lit(False))), lambda k: F.concat(F.lit("["), k["knowledge_type"], F.lit("] "), k["content"]))
    state = F.array(F.concat(F.lit("last_updated: "), "last_updated"), *[F.concat(F.lit(f"{c}: "), quoted_strings(F.col(c))) for c in ("active_issues", "recent_decisions")], F.lit("current_focus: "))
    return F.concat_ws("\n", F.concat(F.lit("TASK: "), "task"), section("RELEVANT KNOWLEDGE:", known), section("RELEVANT DECISIONS:", F.col("decisions")), section("CURRENT STATE:", state), section("CONSTRAINTS:", F.col("constraints")))


def exported(packed: DataFrame) -> DataFrame:
    """(task_id, result) of packages: one JSON object each for tools that read contexts."""
    items = F.coalesce(F.transform("knowledge", lambda k: F.struct(k["content"].alias("content"), k["knowledge_type"].alias("type"), k["importance"].alias("importance"), k["score"].alias("relevance"))), F.array())
    return packed.select("task_id", F.to_json(F.struct("estimated_tokens", items.alias("knowledge"), "decisions", "constraints")).alias("result"))


def learned_rows(tasks: DataFrame) -> DataFrame:
    """Rows to add to the memory for tasks(task_id, project_id, task) that fix or build something: what the project works on."""
    metadata = F.to_json(F.struct(F.lit("current_task").alias("knowledge_type"), F.lit("active").alias("status"), F.lit("agent").alias("learned_by")))
    kept = task_ops.analysed(tasks).filter(F.col("task_type").isin("troubleshooting", "development"))
    return kept.select("project_id", F.concat(F.lit("Current focus: "), "task").alias("content"), F.lit("task").alias("memory_type"), F.lit(0.7).alias("importance_score"), metadata.alias("metadata"), F.col("task_id").alias("write_seq"))


def extra_memories(tasks: DataFrame, memories: DataFrame, scorer: Scorer, known: DataFrame, limit: int = 3, prepared: DataFrame | None = None) -> DataFrame:
    """(task_id, extra_rank, id): what a second pass by the tasks' keywords finds beside known(task_id, id)."""
    terms = task_ops.second_terms(tasks)
    hits = ranked(memories, terms.select("query_id", "project_id", "query"), scorer, limit, prepared=prepared)
    return task_ops.second_pass(hits.select("query_id", "rank", "id").join(terms.select("query_id", "task_id", "term"), "query_id"), known, limit)


def runs(tasks: DataFrame, memories: DataFrame, scorer: Scorer, as_of: str, projects: DataFrame, index: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """One row a task: analysis, context, gaps in their order, and the number of memories of a second pass where there are gaps.

    projects(id, name): a task of another project has neither name nor context, and one gap: project not found.
    """
    pool = search_pool(memories)
    packed = written(packages(tasks, memories, scorer, as_of, index, limit, projects=projects, prepared=pool).select("task_id", "context_id", "knowledge", "n_knowledge", "estimated_tokens"), "packages")
    items = packed.select("task_id", F.explode("knowledge").alias("k")).select("task_id", "k.id", "k.knowledge_type")
    known = of_known_projects(tasks, projects)
    place = F.array_position(F.array(*[F.lit(m) for _, m, _ in GAPS]), F.col("gap"))
    missing = task_ops.gaps(known, items.select("task_id", "knowledge_type")).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "gap"))).alias("g"))
    lacking = known.join(missing.select("task_id"), "task_id", "left_semi")
    extra = extra_memories(lacking, memories, scorer, items.select("task_id", "id"), prepared=pool).groupBy("task_id").agg(F.count("*").alias("n_extra"))
    rows = task_ops.analysed(tasks).join(packed.select("task_id", "context_id", "n_knowledge", "estimated_tokens"), "task_id", "left").join(missing, "task_id", "left").join(extra, "task_id", "left")
    rows = rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    found = F.coalesce(F.transform("g", lambda g: g["gap"]), F.array().cast("array<string>"))
    gaps = F.when(F.col("context_id").isNull(), F.array(F.lit("project not found"))).otherwise(found)
    zero = F.lit(0)
    return rows.select("task_id", "project_id", "project_name", "task", "keywords", "task_type", "complexity", "context_id", F.coalesce("n_knowledge", zero).alias("n_knowledge"), F.coalesce("estimated_tokens", zero).alias("estimated_tokens"),
                       gaps.alias("gaps"), F.coalesce("n_extra", zero).alias("n_extra"), (F.col("context_id").isNotNull() & F.col("task_type").isin("troubleshooting", "development")).alias("learns"))


def run_summary(tasks: DataFrame, memories: DataFrame, scorer: Scorer, as_of: str, projects: DataFrame, index: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """One row a task: its analysis, candidates, the context's size, gaps, memories of a second pass, and what it would teach the memory."""
    focus = F.when(F.col("learns"), F.concat(F.lit("Current focus: "), "task"))
    rows = runs(tasks, memories, scorer, as_of, projects, index, limit)
    return rows.select("task_id", "task_type", "complexity", F.col("n_knowledge").alias("n_candidates"), "n_knowledge", "estimated_tokens", F.array_join("gaps", "|").alias("gaps"), F.col("n_extra").cast("long").alias("n_extra"), focus.alias("learned"))


def action_log(done: DataFrame) -> DataFrame:
    """(task_id, step, action, detail): what a run did, step by step, from runs(). A run on an unknown project ends after the lookup."""
    def step(action: str, *detail: Column | str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.concat(*[F.lit(d) if isinstance(d, str) else d.cast("string") for d in detail]).alias("detail"))

    start = step("Analyzing task", "type=", F.col("task_type"), ", keywords=", quoted_strings(F.slice("keywords", 1, 4)))
    lost = step("Project lookup", "project ", F.col("project_id"), " not found — aborting")
    again = F.when(F.col("n_extra") > 0, step("Retrieved additional information", F.col("n_extra"), " extra memories")).otherwise(step("Additional retrieval", "nothing more found locally"))
    whole = F.concat(
        F.array(step("Inspecting project", F.coalesce("project_name", "project_id")), step("Searching project knowledge", F.col("n_knowledge"), " candidates scored"),
                step("Built optimized context", F.col("n_knowledge"), " knowledge items, ~", F.col("estimated_tokens"), " tokens (estimated)")),
        F.transform("gaps", lambda g: step("Gap detected", g)),
        F.array_compact(F.array(F.when(F.size("gaps") > 0, again), F.when(F.col("learns"), step("Updated memory", "recorded current task focus")), step("Context ready", "context_id=", F.col("context_id")))))
    steps = F.concat(F.array(start), F.when(F.col("context_id").isNull(), F.array(lost)).otherwise(whole))
    return done.select("task_id", F.posexplode(steps).alias("at", "s")).select("task_id", (F.col("at") + 1).alias("step"), "s.action", "s.detail")
