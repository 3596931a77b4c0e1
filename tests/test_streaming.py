"""Streams into the memory table and the access counts; the table itself."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ingest, store
from palimpsest.sources.memory_table import MemoryTable
from palimpsest.streaming import accesses
from palimpsest.streaming.memories import stream_memories



def now():
    return F.lit("2025-06-15 00:00:00").cast("timestamp")


SCHEMA = "conversation_id string, project_id string, msg_index int, role string, content string, ts timestamp"
SAID = ["We decided to keep plan {} for now.", "there is a bug in part {} of it", "  We   decided to keep plan {} for now. ", "thanks!", "Fixed: part {} works again now.", "I need to rewrite part {} before Friday."]


@pytest.fixture
def table(spark, tmp_path, request):
    made = MemoryTable(spark, f"memories_{abs(hash(request.node.name))}", str(tmp_path / "memories"), 2, 4)
    yield made
    spark.sql(f"drop table {made.name}")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*store.COLUMNS).collect())


def conversation_rows(spark, conversations=6, messages=30):
    rows = []
    for c in range(conversations):
        for m in range(messages):
            rows.append((f"c{c}", f"p{c % 2}", m, "user", SAID[(c + m) % len(SAID)].format((m * 7 + c) % 5), 1_750_000_000 + 600 * m + c))
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_memories_of_disordered_batches_equal_the_batch(spark, tmp_path, table):
    """Out of order within the delay, repeated in the same and in later batches: the table is store.upsert of all at once."""
    messages = conversation_rows(spark)
    local = messages.collect()
    rng = random.Random(4)
    order = sorted(local, key=lambda r: (r.ts.timestamp() // 3000 + rng.choice([0, 0, 1]), rng.random()))  # up to 100 minutes late
    batches = [order[k : k + 30] for k in range(0, len(order), 30)]
    batches = [b + rng.sample(batches[max(0, k - 1)], 6) for k, b in enumerate(batches)]
    folder = tmp_path / "in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(folder / f"b{k:03d}"))
    last = spark.createDataFrame([("end", "p0", 0, "user", "ok", 1_760_000_000)], SCHEMA.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    last.coalesce(1).write.parquet(str(folder / "z"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder))
    held = []
    for _ in range(2):  # a second run finds nothing new
        query = stream_memories(source, table, str(tmp_path / "check"), now(), "3 hours", 3600)
        query.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    want = store.upsert(table.read().limit(0), store.memory_rows(ingest.extract(messages).join(messages.select("conversation_id", "project_id").distinct(), "conversation_id")), now())
    assert len(rows_of(want)) > 10 and rows_of(table.read()) == rows_of(want)
    assert max(held) == 6 or max(held) == 7
    assert held[-1] <= 1  # only the last conversation is still open


def test_state_ends_with_the_conversations(spark, tmp_path, table):
    """Ten conversations one after another: the state never holds more than the few that are active."""
    rows = [(f"c{c}", "p", m, "user", f"We decided to keep plan {c} and {m} for now.", 1_750_000_000 + 100_000 * c + m) for c in range(10) for m in range(3)]
    for c in range(10):
        part = spark.createDataFrame(rows[3 * c : 3 * c + 3], SCHEMA.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{c}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream_memories(source, table, str(tmp_path / "check"), now(), "1 hour", 3600)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 and table.read().count() == 27  # the last one waits for the watermark


def test_table_changes_equal_the_batch_functions(spark, tmp_path, table):
    def made(ids, seq, kind="task"):
        return spark.createDataFrame([(f"p{k % 3}", f"text {k}", kind, k / 100, None, f"{seq:03d}") for k in ids], "project_id string, content string, memory_type string, importance_score double, metadata string, write_seq string")

    want = table.read().limit(0)
    for seq, ids in enumerate([range(40), range(30, 50), [3, 3, 41]]):
        rows = made(ids, seq, f"kind{seq}")
        want = store.upsert(want, rows, now())
        table.merge(rows, now())
    want = spark.createDataFrame(want.collect(), want.schema)
    assert rows_of(table.read()) == rows_of(want)
    ids = [r.id for r in want.orderBy("id").limit(7).collect()]
    changes = spark.createDataFrame([(i, "new " + i if k % 2 else None, 0.9 if k % 3 else None, None) for k, i in enumerate(ids)], "id string, content string, importance_score double, metadata string")
    later = F.lit("2025-07-01 00:00:00").cast("timestamp")
    want = store.update(want, changes, later)
    table.update(changes, later)
    assert rows_of(table.read()) == rows_of(want)
    gone = want.filter("project_id = 'p1' or importance_score > 0.4").select("id")
    want = store.delete(want, gone)
    table.delete(spark.createDataFrame(gone.collect(), gone.schema))
    assert rows_of(table.read()) == rows_of(want) and not list((tmp_path / "memories").glob("project_id=p1"))


def test_ordered_merge_takes_any_order(spark, table):
    rows = [("p", "same", "a", 0.1, None, "c:000000001:1"), ("p", "same", "b", 0.2, None, "c:000000009:1"), ("p", "same", "c", 0.3, None, "c:000000005:1")]
    for row in (rows[1], rows[0], rows[2], rows[1]):
        table.merge(spark.createDataFrame([row], "project_id string, content string, memory_type string, importance_score double, metadata string, write_seq string"), now(), ordered=True)
    assert [(r.memory_type, r.importance_score) for r in table.read().collect()] == [("b", 0.2)]


def test_upsert_shuffles_the_change_only(spark, tmp_path, table, monkeypatch):
    """The table's side of the join has no exchange, its scan names the projects, and other projects' files stay."""
    def rows(projects):
        return spark.createDataFrame([(p, f"text {k}", "task", 0.5, None, "1") for p in projects for k in range(50)], "project_id string, content string, memory_type string, importance_score double, metadata string, write_seq string")

    table.merge(rows(["a", "b", "c"]), now())
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "memories").rglob("*.parquet")}
    plans = []
    keep = table._replace
    monkeypatch.setattr(table, "_replace", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.merge(rows(["b"]).limit(3), now())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plans[0].splitlines() if "FileScan" in line and "memories" in line)
    above = plans[0].splitlines()[: plans[0].splitlines().index(scan)]
    indent = len(scan) - len(scan.lstrip(" :+-*()0123456789"))
    path = [line for k, line in enumerate(above) if len(line) - len(line.lstrip(" :+-*()0123456789")) < indent and all(len(x) - len(x.lstrip(" :+-*()0123456789")) > len(line) - len(line.lstrip(" :+-*()0123456789")) for x in above[k + 1 :])]
    assert len(path) > 2 and any("SortMergeJoin" in line for line in path) and not any("Exchange" in line for line in path), plans[0]
    assert "PartitionFilters: [" in scan and "b" in scan.split("PartitionFilters: [")[1].split("]")[0] and "Bucketed: true" in scan
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "memories").rglob("*.parquet")}
    for name in "ac":
        assert {p: t for p, t in files.items() if f"project_id={name}" in str(p)} == {p: t for p, t in after.items() if f"project_id={name}" in str(p)}
    assert table.read().count() == 150
    before, one = after, rows(["a"]).limit(1)
    table.merge(one, now())
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "memories").rglob("*.parquet")}
    swapped = {p.parent for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
    assert {p.parent.name for p in swapped} == {"project_id=a"} and len(swapped) == 1  # one of the project's four parts


def test_access_deltas_are_bounded(spark, tmp_path):
    """Many micro-batches over several days: the files that a read opens stay few, and the counts equal the batch's."""
    log = spark.sql("select concat('m', id % 5) as id, timestamp_seconds(1750000000 + id * 9000) as ts from range(60)")
    for k, row in enumerate(log.orderBy("ts").collect()):
        spark.createDataFrame([row, row] if k % 4 == 0 else [row], log.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:03d}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = accesses.stream_accesses(source, out, str(tmp_path / "check"), "1 day", 5)
    query.awaitTermination()
    assert len(query.recentProgress) > 20 and len(accesses.delta_numbers(spark, out)) < 5
    seen = spark.read.option("recursiveFileLookup", True).schema(log.schema).parquet(str(tmp_path / "in"))
    want = {(r.id, r.n, r.last) for r in seen.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).collect()}
    assert {(r.id, r.n, r.last) for r in accesses.counts(spark, out).collect()} == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 5 * 4  # the days that the delay leaves open
    accesses.compact(spark, out)
    assert not accesses.delta_numbers(spark, out) and {(r.id, r.n, r.last) for r in accesses.counts(spark, out).collect()} == want
    assert len(list((tmp_path / "out" / "base").rglob("*.parquet"))) <= 7 * 4
