"""A project's files and tasks must not meet in one task, and the results stay those of the definition."""

from pyspark.sql import functions as F

from palimpsest.operators import index


def test_admission_spreads_a_project(spark, monkeypatch):
    monkeypatch.setattr(index, "MOST_FILES", 40)
    rows = [(p, f"src/f{k:03}.py", f"{p}{k}") for p, n in (("large", 90), ("exact", 40), ("small", 5), (None, 60)) for k in range(n)]
    files = spark.createDataFrame(rows + [("large", "src/f039.py", x) for x in ("a", "b")] + [("large", "src/f000.exe", ""), ("small", "src/.x.py", "")], "project_id string, path string, content string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = index.admitted(files).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    kept = {p: sorted((r.path, r.content) for r in got if r.project_id == p) for p in ("large", "exact", "small", None)}
    for p, n in (("large", 39), ("exact", 40), ("small", 5), (None, 40)):
        assert [x for x in kept[p] if p != "large" or x[0] < "src/f039.py"] == [(f"src/f{k:03}.py", f"{p}{k}") for k in range(n)]
    assert kept["large"][39:] == [("src/f039.py", "a")]  # one place is left for three rows of the last path
    assert len({r["at"] for r in got if r.project_id == "large"}) > 1


def test_tasks_of_equal_keywords_are_scored_once(spark):
    kinds = [("import the loader part", 30), ("loader of reports", 30), ("report export part loader", 30), ("none at all", 1)]
    tasks = spark.createDataFrame([(f"t{n}-{k}", f"p{k % 2}", f"t{n}x{k} {said}") for n, (said, m) in enumerate(kinds) for k in range(m)], "task_id string, project_id string, task string")
    symbol = "array<struct<name:string,kind:string,exported:boolean>>"
    names = ["Loader", "importPart", "report", "Other"]
    rows = [(f"p{k % 2}", f"src/{'loader' if k % 3 == 0 else 'x'}{k:03}.py", [(names[k % 4], "class", False)], [f"lib.part{k % 5}"]) for k in range(200)]
    files = spark.createDataFrame(rows, f"project_id string, path string, symbols {symbol}, imports array<string>")
    words = {n: [w for w in said.split() if len(w) > 3] for n, (said, _) in enumerate(kinds)}
    want = set()
    for n, (_, m) in enumerate(kinds):
        for k in range(m):
            scores = []
            for project, path, symbols, imports in rows:
                text = " ".join([path, *[s[0] for s in symbols], *imports]).lower()
                score = sum(2.0 * text.count(w) + 2.0 * (w in path) for w in words[n])
                if project == f"p{k % 2}" and score > 0:
                    scores.append((-score, path))
            want |= {(f"t{n}-{k}", r + 1, path, -s) for r, (s, path) in enumerate(sorted(scores)[:5])}

    def shuffled():
        sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    assert {(r.task_id, r["rank"], r.path, r.score) for r in index.relevant_files(tasks, files).collect()} == want
    most = max(n for stage, n in shuffled().items() if stage not in before)
    assert most < 5000  # 200 files hold some 4,000 groups of four letters; tasks times hits would be some 7,000
    few = {(r.task_id, r["rank"], r.path, r.score) for r in index.relevant_files(tasks, files, sets_a_part=1).collect()}
    assert few == want
