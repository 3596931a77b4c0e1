import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bm25, registry


def brute(docs, queries, k):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for _, t in docs]
    n, mean = len(docs), max(1.0, sum(map(len, split)) / max(1, len(docs)))
    df = Counter(w for ws in split for w in set(ws))
    out = {}
    for q, text in queries:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
        rows = []
        for (d, _), ws in zip(docs, split):
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in terms if tf[t])
            if s:
                rows.append((-round(s, 9), d if d is not None else 10**9))
        out[q] = sorted(rows)[:k]
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "w5 " * 30000), (1003, docs[7][1]), (1003, docs[7][1]), (None, docs[7][1])]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 30])))) for i in range(20)] + [(50, None), (51, "absent"), (52, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", bm25.F.lit(1)).repartition(5)
    index = bm25.build_index(df, shard_words=3000)
    assert index.count() > 5
    got = {}
    for r in bm25.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 9), r.doc_id if r.doc_id is not None else 10**9))
    for q, want in brute(docs, queries, 5).items():
        rows = sorted(got.get(q, []))
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        assert [r[2] for r in rows] == [d for _, d in want]
        assert [r[1] for r in rows] == pytest.approx([s for s, _ in want])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = bm25.build_index(none)
    assert bm25.search(index, spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0
    assert bm25.search(index, none.withColumnRenamed("doc_id", "query_id")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(1, 6))
def test_wand_equals_full_scoring(seed, n_lists, k):
    rng = np.random.default_rng(seed)
    lists, total = [], Counter()
    for _ in range(n_lists):
        docs = np.unique(rng.integers(0, 400, rng.integers(1, 300)))
        scores = rng.integers(1, 40, len(docs)) / 8
        lists.append(bm25.Postings(docs, scores))
        for d, s in zip(docs.tolist(), scores.tolist()):
            total[d] += s
    want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]
    assert bm25.block_max_wand(lists, k) == want


def test_documents_as_queries(spark, tmp_path):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 40, 400])))) for i in range(400)]
    docs += [(1000, None), (1020, ""), (1040, docs[20][1]), (1060, "absent"), (1060, "w7 w8"), (None, docs[40][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in registry.op6_topk_documents(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.doc_id if r.doc_id is not None else 10**9))
    asked = [d for d in docs if d[0] is not None and d[0] % 20 == 0 and d[0] != 1060] + [(1060, "absent w7 w8")]
    assert len(asked) == 24
    for q, want in brute(docs, asked, 10).items():
        rows = sorted(got.get(q, []))
        assert [r[2] for r in rows] == [d for _, d in want]
        assert [r[1] for r in rows] == pytest.approx([s for s, _ in want], abs=1e-4)
    index = bm25.build_index(df.repartition(3), shard_words=3000)
    given = df.filter("doc_id % 20 = 0 and doc_id < 1000").withColumnRenamed("doc_id", "query_id")
    assert sorted(bm25.search(index, given, 10, block=7).collect()) == sorted(bm25.search(index, given, 10, block=7, skip=False).collect())


def test_documents_as_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op6_topk_documents"]).fetchall()
    got = [tuple(r) for r in registry.op6_topk_documents(spark, "/root/testdata/sf0.01").collect()]
    assert len(want) == 500 and sorted(got) == sorted(want)
