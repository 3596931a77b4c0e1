import json
import os
import random
import time

import pytest
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import LessThanOrEqual

from palimpsest.functions import tokens
from palimpsest.functions.classify import findings, is_chatter
from palimpsest.functions.patterns import CATEGORIES, REJECTED, STEMS, SYMBOLS
from palimpsest.functions.text import json_strings, quoted_strings
from palimpsest.operators import context, evaluate, grams, index, ingest, knowledge, relevance, store, tasks
from palimpsest.sources import tables, transcripts, tree
from palimpsest.streaming import accesses
from palimpsest.streaming import ingest as stream


def test_transcript_rules(spark):
    raw = """# My chat
## User
hello there
second line

# A section
**Assistant**: sure
AI: inline text
more

system:
## ChatGPT
kept by role"""
    got = [(r.msg_index, r.role, r.content) for r in transcripts.parse_text(spark.createDataFrame([("a", raw), ("b", "  \n")], "conversation_id string, raw string")).orderBy("msg_index").collect()]
    assert got == [(0, "user", "hello there\nsecond line"), (1, "assistant", "sure"), (2, "assistant", "inline text\nmore"), (3, "system", "kept by role")]


def test_json_and_tree_exports(spark):
    plain = json.dumps({"turns": [{"author": "Human", "text": " hi "}, 5, {"role": "robot", "content": {"parts": ["a", "b"]}}, {"role": "ai", "message": ""}]})
    df = spark.createDataFrame([("a", plain), ("b", "not json"), ("c", json.dumps([{"role": "user", "content": "x"}]))], "conversation_id string, raw string")
    got = {(r.conversation_id, r.msg_index, r.role, r.content) for r in transcripts.parse_json(df).collect()}
    assert got == {("a", 0, "user", "hi"), ("a", 1, "unknown", "a b"), ("c", 0, "user", "x")}
    nodes = {"x": {"create_time": 2, "message": {"author": {"role": "assistant"}, "content": {"parts": ["late"]}}}, "y": {"create_time": 1, "message": {"author": {"role": "user"}, "content": {"parts": ["early"]}}},
             "z": {"message": None}, "t": {"create_time": 0, "message": {"author": {"role": "tool"}, "content": {"parts": ["no"]}}}}
    df = spark.createDataFrame([("a", json.dumps({"mapping": nodes}))], "conversation_id string, raw string")
    assert [(r.role, r.content) for r in transcripts.parse_tree(df).orderBy("msg_index").collect()] == [("user", "early"), ("assistant", "late")]


def test_classifier(spark):
    rows = {"thanks!": ["irrelevant"], "We decided to use plain files.": ["decision"], "ok, the deploy must wait": [], "We rejected the second cache idea": ["decision"],
            "There is a bug in the importer": ["open_issue"], "We no longer use it. Fixed: the loader skips rows": ["stale_info", "resolved_issue"], "": []}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", findings(F.col("t")).alias("f"), is_chatter(F.col("t")).alias("c"))
    got = {r.t: r for r in df.collect()}
    assert {t: [f.category for f in got[t].f] for t in rows} == rows
    assert got["We rejected the second cache idea"].f[0].status == "rejected"


def test_stream_equals_batch(spark, tmp_path):
    messages = spark.createDataFrame([("c", i, "user", f"We decided to keep plan number {i % 3} for now.") for i in range(9)], "conversation_id string, msg_index int, role string, content string")
    for part in range(3):
        messages.filter(F.col("msg_index") % 3 == part).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream.stream_messages(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    key = lambda df: sorted((r.conversation_id, r.msg_index, r.category, r.content) for r in df.collect())
    assert key(stream.findings(spark, str(tmp_path / "out"))) == key(ingest.extract(messages))


def test_index_diff_and_refresh(spark, tmp_path):
    before = spark.createDataFrame([("p", "a.py", "def one():"), ("p", "b.py", "class B:"), ("p", "c.py", "x"), ("p", "d.py", "x")], "project_id string, path string, content string")
    after = spark.createDataFrame([("p", "a.py", "def two():"), ("p", "new/b.py", "class B:"), ("p", "c.py", "x"), ("p", "e.md", "hello")], "project_id string, path string, content string")
    sha = lambda df: df.select("project_id", "path", F.sha2("content", 256).alias("sha256"))
    changes = index.diff(sha(before), sha(after))
    got = {(r.change, r.old_path, r.new_path) for r in changes.collect()}
    assert got == {("modified", "a.py", "a.py"), ("renamed", "b.py", "new/b.py"), ("deleted", "d.py", None), ("added", None, "e.md")}
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(index.applied(index.indexed(before), changes, after)) == key(index.indexed(after))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_bytes(b"import os\ndef f():\n  pass \xff\n")
    read = tree.read_tree(spark, f"file://{tmp_path}", "p")
    row = index.indexed(index.admitted(read)).collect()[0]
    assert (row.path, [s.name for s in row.symbols], row.imports, row.line_count) == ("src/m.py", ["f"], ["os"], 4)
    assert [(r.name, r.line) for r in index.symbol_lines(read).collect()] == [("f", 2)]


def test_upsert_is_idempotent(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("p", "x", "task", 0.5, None, "1"), ("p", "x", "stale", 0.1, None, "2"), ("p", "y", "task", 0.5, None, "1")], "project_id string, content string, memory_type string, importance_score double, metadata string, write_seq string")
    once = store.new_memories(rows, now)
    assert {(r.content, r.memory_type) for r in once.collect()} == {("x", "stale"), ("y", "task")}
    assert sorted(once.collect()) == sorted(store.upsert(once, rows, now).collect())


def test_demotion_is_a_choice(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    made = "timestamp '2025-01-01 00:00:00'"
    m = spark.sql(f"select 'm' as id, 'p' as project_id, 'the loader import' as content, 'resolved' as memory_type, 0.5D as importance_score, {made} as created_at, {made} as updated_at, {made} as accessed_at, 0 as access_count, '{{\"knowledge_type\":\"resolved_issue\",\"status\":\"resolved\"}}' as metadata, '' as source_hash")
    q = spark.createDataFrame([("q", "p", "fix loader"), ("r", "p", "loader")], "query_id string, project_id string, query string")
    score = {d: {r.query_id: r.score for r in relevance.ranked(m, q, relevance.layered_score(now, d)).collect()} for d in (False, True)}
    assert score[False]["q"] > score[True]["q"] and score[False]["r"] == score[True]["r"]


def test_chunks_and_statements(spark):
    assert [knowledge.chunk_bounds("x" * n)[-1] for n in (999, 1000, 1001)] == [(0, 999), (0, 1000), (900, 1001)]
    text = "a" * 950 + "." + "b" * 500
    assert knowledge.chunk_bounds(text)[0] == (0, 951)
    rows = spark.createDataFrame([("p", "s", "Decision: use one critical queue\nbug: short")], "project_id string, source_title string, text string")
    got = knowledge.statements(rows).collect()
    assert [(r.knowledge_type, r.content, r.importance) for r in got] == [("decision", "use one critical queue", 1.0)]


def test_constraints_and_task_rules(spark):
    df = spark.createDataFrame([("You must keep it small\nshould x", "What is a hard bug?")], "a string, t string")
    row = df.select(context.constraints(F.col("a")).alias("c"), tasks.task_type(F.col("t")).alias("k"), tasks.complexity(F.col("t")).alias("x"), tasks.needed_knowledge(F.col("t")).alias("n")).first()
    assert row.c == ["must keep it small"] and (row.k, row.x, row.n) == ("troubleshooting", "high", ["issue", "project_identity"])


def test_any_raw_input(spark):
    nodes = {"mapping": {"x": {"create_time": 1, "message": {"author": {"role": "user"}, "content": {"parts": ["from a tree"]}}}}}
    rows = {"json": json.dumps([{"role": "user", "content": "from json"}]), "tree": json.dumps(nodes), "text": "## Assistant\nfrom text", "none": json.dumps({"messages": [{"role": "user", "content": " "}]}), "empty": json.dumps({"mapping": {}}), "broken": '{"messages": [', "blank": " ", "null": None}
    df = spark.createDataFrame(list(rows.items()), "conversation_id string, raw string")
    got = {r.conversation_id: (r.role, r.content) for r in transcripts.parse(df).collect()}
    assert got == {"json": ("user", "from json"), "tree": ("user", "from a tree"), "text": ("assistant", "from text"), "none": ("user", rows["none"]), "broken": ("user", rows["broken"])}
    assert transcripts.parse(df.limit(0)).count() == 0


def test_text_files_are_raw_input(spark, tmp_path):
    (tmp_path / "a.md").write_text("## User\nhello")
    got = transcripts.parse(transcripts.read_text(spark, str(tmp_path))).collect()
    assert [(r.role, r.content) for r in got] == [("user", "hello")] and got[0].conversation_id.endswith("a.md")


def test_access_stream_equals_batch(spark, tmp_path):
    made = "timestamp '2025-01-01 00:00:00'"
    memories = spark.sql(f"select concat('m', id) as id, 'p' as project_id, 'x' as content, 'task' as memory_type, 0.5D as importance_score, {made} as created_at, {made} as updated_at, {made} as accessed_at, 0 as access_count, '' as metadata, '' as source_hash from range(4)")
    log = spark.sql("select concat('m', id % 3) as id, timestamp_seconds(1750000000 + id * 7) as ts from range(10)")
    for part in range(3):
        log.filter(F.unix_timestamp("ts") % 3 == part).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    key = lambda df: sorted((r.id, r.access_count, r.accessed_at, r.updated_at) for r in df.collect())
    assert key(accesses.with_accesses(memories, out)) == key(memories)
    for _ in range(2):
        accesses.stream_accesses(source, out, str(tmp_path / "check")).awaitTermination()
    assert key(accesses.with_accesses(memories, out)) == key(store.tracked(memories, log))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "id string, n long, bucket int")
    add = lambda df: df.groupBy("id", "bucket").agg(F.sum("n").alias("n"))
    stream.rewrite(stream.merged(rows, out, 0, add), out, 0)
    for _ in range(2):
        stream.rewrite(stream.merged(rows.filter("id = 'a'"), out, 1, add), out, 1)
    assert {(r.id, r.n) for r in stream.latest(spark, out).collect()} == {("a", 2), ("b", 2)}


def test_symbols_after_many_blank_lines(spark):
    code = ["def one():", "public static int two(int x) {", "  async function three()", "class Four", "public\nFive six(a) {", "struct Seven", "let eight = (", "private nine(b) {", "enum Ten", "type Eleven = x", "export interface Twelve"]
    text = "\n\n  \n".join(code)
    # names are the same as if blank lines before a symbol counted
    wide = [(k, p.replace(r"^[^\S\n]*(?:(?:public|private|protected|static)[^\S\n]*)*", r"^\s*(?:public|private|protected|static|\s)*").replace(r"^[^\S\n]*", r"^\s*")) for k, p in SYMBOLS]
    want = {(m[1], k) for k, p in wide for m in regex.finditer(p, text, regex.M)}
    df = spark.createDataFrame([("p", "a.py", text), ("p", "b.py", "\n" * 20_000 + "def late():" + "\n" * 20_000)], "project_id string, path string, content string")
    start = time.perf_counter()
    got = {r.path: {(s.name, s.kind) for s in r.symbols} for r in index.indexed(df).collect()}
    assert got == {"a.py": want, "b.py": {("late", "function")}} and len(want) >= 11
    assert {(r.name, r.line) for r in index.symbol_lines(df).filter("path = 'b.py'").collect()} == {("late", 20_001)}
    assert time.perf_counter() - start < 30


def test_times_as_text(spark):
    said = ["2025-06-01 10:11:12", "2025-06-01T10:11:12.5", "2025-06-01T10:11:12.123456", "2025-06-01T10:11:12", "01/06/2025", "", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", store.timestamp_of(F.col("x")).cast("string").alias("t")).orderBy("i").collect()]
    assert got == ["2025-06-01 10:11:12", "2025-06-01 10:11:12.5", "2025-06-01 10:11:12.123456", "2025-06-01 10:11:12", None, None, None]


def test_hits_and_their_rate(spark):
    expected = spark.createDataFrame([("q", ".PY"), ("q", "src/"), ("r", "absent"), ("s", "x")], "query_id string, needle string")
    results = spark.createDataFrame([("q", "1", "src/a.py", "12345678"), ("q", "2", "b.md", "1234"), ("r", "3", None, "1234")], "query_id string, id string, file_path string, content string")
    hits = {r.query_id: (r.n_results, r.n_relevant, r.hit, r.tokens) for r in evaluate.retrieval_hits(results, expected).collect()}
    assert hits == {"q": (2, 1, True, 3), "r": (1, 0, False, 1), "s": (0, 0, False, 0)}
    row = evaluate.hit_rate(evaluate.retrieval_hits(results, expected)).first()
    assert (row.queries, row.hit_rate_pct) == (3, 33.3) and row.mean_tokens == pytest.approx(1.33)


def test_names_count_in_chats(spark):
    df = spark.createDataFrame([("c", "user", "x" * 8, "n" * 4), ("c", "user", "x" * 8, None)], "conversation_id string, role string, content string, name string")
    assert ingest.chat_tokens(df).first().chat_tokens == 3 + 2 * (3 + 1 + 2) + 2
    assert ingest.chat_tokens(df.drop("name")).first().chat_tokens == 3 + 2 * (3 + 1 + 2)


def test_equal_tasks_get_equal_packages(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    made = "'2024-12-01T00:00:00'"
    memories = spark.sql(f"select 'm' as id, 'p' as project_id, 'We decided on the loader. It must stay small and simple' as content, 'permanent' as memory_type, 0.5D as importance_score, {made} as created_at, {made} as updated_at, {made} as accessed_at, 0 as access_count, '{{\"knowledge_type\":\"decision\"}}' as metadata, '' as source_hash")
    asked = spark.createDataFrame([("a", "p", "fix the loader"), ("b", "p", "fix the loader"), ("c", "none", "fix the loader")], "task_id string, project_id string, task string")
    packed = context.packages(asked, memories, relevance.layered_score(now), "t")
    rows = {r.task_id: r for r in packed.withColumn("sections", context.sectioned_text(packed)).collect()}
    assert rows["a"].context_text == rows["b"].context_text and rows["a"].n_knowledge == 1 and rows["c"].n_knowledge == 0
    assert rows["a"].constraints == ["must stay small and simple"] and rows["a"].knowledge[0].score == rows["b"].knowledge[0].score
    assert rows["a"].sections.startswith("TASK: fix the loader\nRELEVANT KNOWLEDGE:\n- [decision] We decided") and rows["c"].sections.startswith("TASK: fix the loader\nCURRENT STATE:")
    learned = context.learned_rows(asked).collect()
    assert {(r.project_id, r.content) for r in learned} == {("p", "Current focus: fix the loader"), ("none", "Current focus: fix the loader")}


def test_patterns_need_their_stems():
    """No text made of the patterns' own words matches a category without holding one of its stems."""
    words = sorted({w for c in CATEGORIES for p in c[1] for w in regex.findall(r"[a-z']+", p.replace(r"\b", " ").replace("'?", "'"))} | {"an", "it", "x", "wont", "theres", "lets", "well", "havent", "were"})
    rnd = random.Random(6)
    rules = {c[0]: c[1] for c in CATEGORIES} | {"rejected": [REJECTED]}
    hits = dict.fromkeys(rules, 0)
    for _ in range(30_000):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ": ", "\n"]) for _ in range(rnd.randrange(2, 9)))
        for category, patterns in rules.items():
            if any(regex.search("(?i)" + p, text.upper()) for p in patterns):
                hits[category] += 1
                assert any(stem in text for stem in STEMS[category]), (category, text)
    assert min(hits.values()) > 5


def test_substring_search_by_index_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["cache", "layer", "Queue", "a_b", "100%", "ΟΔΟΣ", "import", "x\\y", "fix", "of"]
    made = "timestamp '2025-01-01 00:00:00'"
    contents = [(f"m{k}", f"p{k % 2}", " ".join(rng.choice(words) for _ in range(4)), rng.randint(0, 5) / 5) for k in range(300)]
    memories = spark.createDataFrame(contents, "id string, project_id string, content string, importance_score double").selectExpr("id", "project_id", "content", "'t' as memory_type", "importance_score", *[f"{made} as {c}" for c in ("created_at", "updated_at", "accessed_at")], "0 as access_count", "'' as metadata", "'' as source_hash")
    asked = ["cache", "CACHE lay", "a_b", "a\\_b", "100%", "100\\%", "l%r q", "οδος", "of", "", "x", "never there", "import fix", "x\\\\y", "%", "queue%queue"]
    queries = spark.createDataFrame([(f"q{k}-{p}", p, q) for k, q in enumerate(asked) for p in ("p0", "p1", "none")], "query_id string, project_id string, query string")

    def like(text, query):
        low, pattern, k = query.lower(), "", 0
        if not any(c in query for c in "%_\\"):
            return low in text.lower()
        while k < len(low):
            if low[k] == "\\":
                pattern, k = pattern + regex.escape(low[k + 1]), k + 2
                continue
            pattern, k = pattern + {"%": ".*", "_": "."}.get(low[k], regex.escape(low[k])), k + 1
        return regex.fullmatch(f".*{pattern}.*", text.lower(), regex.DOTALL) is not None

    want = set()
    for k, q in enumerate(asked):
        for p in ("p0", "p1"):
            hits = sorted((-s, i) for i, pp, c, s in contents if pp == p and like(c, q))[:7]
            want |= {(f"q{k}-{p}", n + 1, i) for n, (_, i) in enumerate(hits)}
    index_ = spark.createDataFrame(store.substring_index(memories).collect(), "project_id string, key string, gram string")
    for kept in (None, index_):
        assert {(r.query_id, r["rank"], r.id) for r in store.search(memories, queries, 7, kept).collect()} == want
    one = queries.filter("query = 'never there'").select("project_id", F.col("query").alias("needle"), F.array("query").alias("parts"))
    assert grams.candidates(one, index_, 3).count() == 0
    two = queries.filter("query = 'CACHE lay'").select("project_id", F.col("query").alias("needle"), F.array(F.lower("query")).alias("parts"))
    assert grams.candidates(two, index_, 3).count() < 150  # of 300 pairs


def test_file_relevance_by_index_equals_all_pairs(spark):
    rng = random.Random(6)
    names = ["load", "loader", "cache", "caches", "queue", "aaaa", "report", "part"]
    files = [(f"p{k % 2}", f"src/{rng.choice(names)}_{k}.py", [rng.choice(names) * rng.randint(1, 2) for _ in range(3)], [rng.choice(names)]) for k in range(60)]
    rows = spark.createDataFrame(files, "project_id string, path string, names array<string>, imports array<string>").select("project_id", "path", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("symbols"), "imports")
    said = [" ".join(rng.choice([*names, "why", "the", "odd"]) for _ in range(6)) for _ in range(20)]
    asked = spark.createDataFrame([(f"t{k}", f"p{k % 3}", s) for k, s in enumerate(said)] + [("again", "p0", said[0])], "task_id string, project_id string, task string")
    words = {}
    for r in tasks.top_keywords(asked).collect():
        words.setdefault(r.task_id, []).append(r.word)
    want = set()
    for r in asked.collect():
        scored = []
        for p, path, symbols, imports in files:
            text = " ".join([path, *symbols, *imports]).lower()
            if p == r.project_id and (score := sum(2.0 * text.count(w) + 2.0 * (w in path.lower()) for w in words.get(r.task_id, []))):
                scored.append((-score, path))
        want |= {(r.task_id, k + 1, path, -s) for k, (s, path) in enumerate(sorted(scored)[:5])}
    assert {(r.task_id, r["rank"], r.path, r.score) for r in index.relevant_files(asked, rows).collect()} == want


def test_texts_as_json_and_as_source(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "a\\b\n\r\t\b\f\x00\x1f\x7f\x80\xa0\xad", "\u00e9 \u3000 \u200b \ufeff \u2028", "\U0001f600", "", "a\U000e0001b"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_strings(F.array("t", "t")).alias("j"), quoted_strings(F.array("t", "t")).alias("q")).collect():
        assert r.j == json.dumps([r.t, r.t]) and r.q == repr([r.t, r.t])


def test_a_run_on_an_unknown_project_stops(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    made = "'2024-12-01T00:00:00'"
    memories = spark.sql(f"select 'm' as id, 'p' as project_id, 'We decided on the loader.' as content, 'task' as memory_type, 0.5D as importance_score, {made} as created_at, {made} as updated_at, {made} as accessed_at, 0 as access_count, '{{\"knowledge_type\":\"decision\"}}' as metadata, '' as source_hash")
    asked = spark.createDataFrame([("a", "p", "fix the loader"), ("c", "none", "fix the loader")], "task_id string, project_id string, task string")
    projects = spark.createDataFrame([("p", "Report tool")], "id string, name string")
    scorer = relevance.layered_score(now)
    packed = context.packages(asked, memories, scorer, "t", projects=projects)
    row = packed.withColumn("sections", context.sectioned_text(packed)).collect()
    assert [r.task_id for r in row] == ["a"]
    assert row[0].state == json.dumps({"last_updated": "t", "active_issues": [], "recent_decisions": ["We decided on the loader."], "current_focus": ""})
    assert "CURRENT STATE:\n- last_updated: t\n- active_issues: []\n- recent_decisions: ['We decided on the loader.']\n- current_focus: " in row[0].sections
    done = context.runs(asked, memories, scorer, "t", projects)
    log = {}
    for r in context.action_log(done).orderBy("task_id", "step").collect():
        log.setdefault(r.task_id, []).append((r.step, r.action, r.detail))
    assert log["c"] == [(1, "Analyzing task", "type=troubleshooting, keywords=['loader']"), (2, "Project lookup", "project none not found \u2014 aborting")]
    assert [a for _, a, _ in log["a"]] == ["Analyzing task", "Inspecting project", "Searching project knowledge", "Built optimized context", "Gap detected", "Gap detected", "Additional retrieval", "Updated memory", "Context ready"]
    assert log["a"][1][2] == "Report tool" and log["a"][-1][2] == "context_id=" + row[0].context_id
    summary = {r.task_id: r for r in context.run_summary(asked, memories, scorer, "t", projects).collect()}
    assert summary["c"].gaps == "project not found" and summary["c"].learned is None and summary["c"].estimated_tokens == 0 and summary["a"].n_knowledge == 1


def test_tree_source_does_not_enter_skipped_folders(spark, tmp_path):
    from palimpsest.functions.patterns import MOST_BYTES

    for path, text in {"a.py": b"def f(): pass", "src/b.ts": b"export const x = 1", "src/deep/c.md": b"# c", ".hidden/d.py": b"x", "node_modules/pkg/e.py": b"x", "src/node_modules/f.py": b"x", "g.exe": b"x", ".env.py": b"x", "big.py": b"x" * (MOST_BYTES + 1), "README.MD": b"hi \xff", "package.json": b"{}"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    os.mkfifo(tmp_path / "node_modules" / "pipe.py")  # opening it would never end
    (tmp_path / "src" / "link").symlink_to(tmp_path / "node_modules" / "pkg")
    want = {"a.py", "src/b.ts", "src/deep/c.md", "README.MD", "package.json"}
    reader = tree.TreeReader({"path": str(tmp_path), "project_id": "p", "batch_bytes": "15"})
    batches = reader.partitions()
    assert {f[1] for b in batches for f in b.files} == want and len(batches) > 2  # nothing else is ever opened
    rows = tree.read_tree(spark, f"file://{tmp_path}", "p").collect()
    assert {(r.project_id, r.path) for r in rows} == {("p", w) for w in want} and {r.content for r in rows if r.path == "README.MD"} == {"hi \ufffd"}
    assert {r.path for r in index.admitted(tree.read_tree(spark, str(tmp_path), "p")).collect()} == want
    narrowed = tree.PushedTreeReader({"path": str(tmp_path)})
    assert not list(narrowed.pushFilters([LessThanOrEqual(("size",), 5)])) and {f[1] for b in narrowed.partitions() for f in b.files} == {"src/deep/c.md", "README.MD", "package.json"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(tree.TreeSource)
        small = spark.read.format("source_tree").options(project_id="p", pushdown="true").load(str(tmp_path)).filter("size <= 5 and path like '%.md'")
        assert [r.path for r in small.collect()] == ["src/deep/c.md"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "none").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "none"), "p").count() == 0


def test_model_tokens_equal_the_vocabulary(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens._ranks(path), special_tokens={})
    rng = random.Random(8)
    texts = ["", "Hello   World's don't", "\n\n  x", "\u00e9\u3042\U0001f600 12345", "a" * 3000, "ab" * 700, *["".join(rng.choice("aeist nlr.\u00e9E") for _ in range(rng.randint(1, 80))) for _ in range(300)]]
    counter = tokens.model_tokens("a model of no renown", {"cl100k_base": tokens.Vocabulary(path, public_tokenizers.PATTERN)})
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", counter(F.col("t")).alias("n")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.n == (None if r.t is None else len(encoding.encode_ordinary(r.t)))
    with pytest.raises(KeyError):
        tokens.model_tokens("gpt-4", {})


def test_sketches_add_up(spark):
    rows = spark.sql("select concat('c', id % 40) as conversation_id, cast(id as int) as msg_index, 'user' as role, concat('text ', id % 5000) as content, date_add(date '2025-01-01', cast(id % 7 as int)) as day from range(20000)")
    days = ingest.message_sketches(rows, ["day"])
    one, all_ = ingest.sketched_stats(days).collect()[0], ingest.sketched_stats(ingest.message_sketches(rows, [])).collect()[0]
    assert one == all_ and one.message_count == 20000 and abs(one.distinct_messages - 5000) < 0.03 * 5000
    assert ingest.sketched_stats(days, ["day"]).count() == 7


def test_ranking_by_index_equals_all_pairs(spark):
    """Every pair scored, words compared one by one, against the pairs that the indexes give."""
    rng = random.Random(9)
    words = ["cache", "caches", "importer", "import", "class", "classes", "queue", "log", "logs", "ok", "report", "reporting", "box", "boxes", "decision", "issue"]
    kinds = ["decision", "open_issue", "resolved_issue", "stale_info", "", "permanent_knowledge"]
    made = "timestamp '2025-01-01 00:00:00'"
    contents = [(f"m{k}", f"p{k % 2}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), json.dumps({"knowledge_type": rng.choice(kinds)}), rng.randint(0, 10) / 10) for k in range(120)]
    memories = spark.createDataFrame(contents, "id string, project_id string, content string, metadata string, importance_score double").selectExpr("id", "project_id", "content", "'t' as memory_type", "importance_score", *[f"{made} as {c}" for c in ("created_at", "updated_at", "accessed_at")], "0 as access_count", "metadata", "'' as source_hash")
    said = ["fix the importers bug", "why reporting", "ok", "o", "og", "cache queue", "ache que", "decision about boxes", "", "the", "why was the class rejected", "xport", "reports of a log box"]
    said += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(20)]
    queries = spark.createDataFrame([(f"q{k}-{p}", p, s) for k, s in enumerate(said) for p in ("p0", "p1", "p9")], "query_id string, project_id string, query string")
    scorer = relevance.layered_score(F.lit("2025-02-01 00:00:00").cast("timestamp"))
    pool, asked = relevance.prepared_memories(memories, 40), relevance.prepared_queries(queries.select("project_id", "query").distinct())

    def same(q, w):
        one = {q, q[:-1]} | ({q[:-2]} if q.endswith("es") else set()) if q.endswith("s") and len(q) > 3 else {q, q + "s"}
        return w in one or (len(q) >= 5 and len(w) >= 4 and (q in w or w in q))

    every = pool.join(asked, "project_id")
    overlaps = [(r.project_id, r.query, r.id, sorted(q for q in r.q_words if any(same(q, w) for w in r.words))) for r in every.select("project_id", "query", "id", "q_words", "words").collect()]
    every = every.join(spark.createDataFrame(overlaps, "project_id string, query string, id string, overlap array<string>"), ["project_id", "query", "id"])
    want = {}
    for r in scorer(every).filter("score > 0.05").select("project_id", "query", "id", F.round("score", 4).alias("score"), "pool_rank", "reasons").collect():
        want.setdefault((r.project_id, r.query), []).append((-r.score, r.pool_rank, r.id, tuple(r.reasons)))
    want = {(p, q, k + 1, x[2], -x[0], x[3]) for (p, q), rows in want.items() for k, x in enumerate(sorted(rows)[:10])}
    got = {(r.project_id, r.query, r["rank"], r.id, r.score, tuple(r.reasons)) for r in relevance.ranked(memories, queries, scorer, 10, 40).collect()}
    assert got == want and any("exact phrase match" in x[5] for x in got)
    assert relevance.likely_pairs(pool, asked).count() < every.count()


RAW = [None, "", "  \n", "# T\n## User\nhello there\n\n# A section\n**Assistant**: sure\nAI: inline\nmore\n\nsystem:\n## ChatGPT\nkept", "no roles at all\nhere", "USER\n\nCursor:\r\nx\x0by\u2028z", "Human\uff1a hi\u3000", "not json {", "5", "[]", "{}", '"text"', "[1, null, {}]",
       json.dumps({"turns": [{"author": "Human", "text": " hi "}, 5, {"role": "robot", "content": {"parts": ["a", None, "b"]}}, {"role": "ai", "message": ""}]}), json.dumps([{"role": "user", "content": "x"}, {"role": None, "content": 7}, {"role": "AI", "content": None, "text": "t"}]),
       json.dumps({"messages": [], "chat": [{"role": "user", "content": "never"}]}), json.dumps({"messages": 3, "chat": [{"role": "user", "content": "said"}]}), json.dumps({"mapping": {}}),
       json.dumps({"mapping": {"x": {"create_time": 2, "message": {"author": {"role": "assistant"}, "content": {"parts": ["late"]}}}, "y": {"create_time": 1, "message": {"author": {"role": "user"}, "content": {"parts": ["early", "b"]}}}, "z": {"message": None}, "t": {"message": {"author": {"role": "tool"}, "content": {"parts": ["no"]}}}}})]


def test_table_functions_equal_the_parsers(spark):
    raw = spark.createDataFrame([(f"c{k}", r) for k, r in enumerate(RAW)], "conversation_id string, raw string")
    tables.register(spark)
    pairs = {"chat_turns": transcripts.parse, "transcript_turns": transcripts.parse_text, "json_turns": transcripts.parse_json, "tree_turns": transcripts.parse_tree}
    for name, parser in pairs.items():
        got = spark.sql(f"select r.conversation_id, t.* from {{raw}} r, lateral {name}(r.raw) t", raw=raw)
        want = {(r.conversation_id, r.msg_index, r.role, r.content) for r in parser(raw).collect()}
        assert {tuple(r) for r in got.collect()} == want and want, name
    texts = ["", "a" * 1000, "b. " * 650, "c" * 5000, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = spark.sql("select d.doc_id, c.* from {docs} d, lateral text_chunks(d.text, 300) c", docs=docs)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in knowledge.chunks(docs, 300).collect()}
    for wrong in ("chat_turns(5)", "text_chunks('x', 50)", "text_chunks('x', 'y')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"select * from {wrong}").collect()
