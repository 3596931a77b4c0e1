import os
import re

import numpy as np
import pytest

from palimpsest.llm import common, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    rows = registry.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_toxicity_misspelled_and_edge_cases(spark):
    rows = [(i, f"the weather of day {i} is {w} and we walk") for i, w in enumerate(["fine", "grey", "cold", "warm"] * 10)]
    rows += [(100 + i, f"you are all {w} people here {i}") for i, w in enumerate(["stupid", "worthless", "stupid", "worthless"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(b"so stupidd a thing") > 0.5 > model.score(b"the cold and grey weather")
    probe = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0), (2, "stupid " * 60000, 9.0), (2, "stupid " * 60000, 9.0), (3, "qwxz " * 20 + "worthless", 9.0)], "doc_id long, text string, score double")
    got = toxicity.score(probe, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(got) == 5 and by[1] == by[None] and by[1][0] < 0.5 and by[2][0] == by[2][1] > 0.5 and by[3][0] > model.score(b"qwxz " * 20)
    assert toxicity.score(probe.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert none.score(b"stupid") < 0.5


def brute_toxicity(text, table, bias, bits):
    """The score by plain loops: every word's subwords, their means, the weighted average."""
    def row(gram):
        h = (ord(gram[0]) * 16777619 + ord(gram[1])) % 2**32
        for c in gram[2:]:
            h = (h * 16777619 + ord(c)) % 2**32
        return (h ^ h >> 15) * 2654435761 % 2**32 >> (32 - bits)

    top = weight = 0.0
    for word in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()):
        marked = f" {word} "
        rows = [row(marked[k : k + n]) for n in range(3, 7) for k in range(len(marked) - n + 1)]
        logit, pull = (float(np.mean(table[k, rows])) if rows else 0.0 for k in (0, 1))
        top, weight = top + np.exp(pull) * logit, weight + np.exp(pull)
    return 1 / (1 + np.exp(-(top / weight if weight else 0) - bias))


def test_score_equals_brute_force_in_any_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, (2, 1 << 12)).astype("float32")
    model = toxicity.Model(table, 0.3, 12)
    text = " ".join("".join(rng.choice(list("abcdeé-"), rng.integers(1, 9))) for _ in range(3000))
    want = brute_toxicity(text, table, 0.3, 12)
    assert model.score(text.encode()) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(toxicity, "text_blocks", lambda t: common.text_blocks(t, 500))
    assert model.score(text.encode()) == pytest.approx(want, abs=1e-4)
    assert model.score(b"") == pytest.approx(brute_toxicity("", table, 0.3, 12)) and model.score(b"!") == model.score(b"")


def test_few_toxic_words_in_a_long_text_count():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(120):
        words = list(rng.choice(plain, 200))
        if i % 2:
            words[int(rng.integers(200))] = ("stupid", "worthless")[i // 2 % 2]
        texts.append(" ".join(words))
        toxic.append(i % 2)
    bags = [toxicity.word_counts(t.encode()) for t in texts]
    spelled = sorted(set().union(*bags))
    number = {w: k for k, w in enumerate(spelled)}
    of_text, words, counts = zip(*[(d, number[w], n) for d, bag in enumerate(bags) for w, n in bag.items()])
    model = toxicity.train(np.array(of_text), np.array(words), np.array(counts, float), spelled, np.array(toxic), 14)
    rest = " ".join(rng.choice(plain, 600))
    assert model.score(f"{rest} stupid {rest}".encode()) > 0.5 > model.score(rest.encode())


def test_samples_are_bounded_when_an_id_repeats(spark):
    once = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    again = spark.range(100_000).selectExpr("7L as doc_id", "concat('other ', id % 50) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = common.labelled_sample(once.unionByName(again), labels.unionByName(labels), "toxic", 20, 1 << 20).collect()
    assert len(sample) == 40 and len({r.doc_id for r in sample}) == 40
    few = common.labelled_sample(once, labels, "toxic", 20, 30).collect()
    assert 0 < len(few) <= 10 and sum(len(r.text) for r in few) <= 60
    assert common.labelled_sample(once.limit(0), labels, "toxic", 20, 30).count() == 0
    many = spark.range(70).selectExpr("id as doc_id", "cast(id as int) as toxic")
    with pytest.raises(ValueError):
        common.labelled_sample(once, many, "toxic", 20, 30)


def test_grade_equals_the_formula():
    """P(grade > k) = 1 / (1 + exp(threshold_k - score)), written out over a plain count of the features."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Good", "bad!", "12", "é-x"], rng.integers(1, 30))) for _ in range(60)]
    x = np.stack([quality.features(t.encode(), 10) for t in texts])
    grades = np.array([1 + min(2, t.count("bad!")) for t in texts])
    model = quality.train(x, grades, 10, 2)
    for text, row in zip(texts, x):
        score = sum(w * max(-3.0, min(3.0, (v - c) / s)) for w, v, c, s in zip(model.weights, row, model.centre, model.spread))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert model.score(text.encode()) == pytest.approx((1 + sum(above), above[0]), abs=1e-6)
        assert row[512:].sum() == pytest.approx(1) and row[1:512].sum() <= 1
    at_cut = ("word " * 300_000).encode()
    assert quality.features(at_cut, 10)[512:].max() == 1.0  # no word is cut in two


def test_ordinal_thresholds_and_grades():
    rng = np.random.default_rng(0)
    kinds = ["!!! ### ", "OK!! well ", "plain words here "]
    texts = [(kinds[g] * int(rng.integers(3, 9))).encode() for g in rng.integers(0, 3, 300)]
    grades = np.array([next(g + 1 for g, k in enumerate(kinds) if t.startswith(k.encode())) for t in texts])
    model = quality.train(np.stack([quality.features(t, 10) for t in texts]), grades, 10, 2)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for k, kind in enumerate(kinds):
        expected, tail = model.score((kind * 5).encode())
        assert abs(expected - (k + 1)) < 0.5
        assert (tail >= 0.5) == (k + 1 >= 2)


def test_quality_held_out_and_edges(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op4_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in rows if r.quality]
    bad = [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, labels)
    probe = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "x" * 2_500_000, "a"), (3, "tie", "a"), (3, "tie", "a")], "doc_id long, text string, expected_grade string")
    got = quality.score(probe, model).collect()
    assert len(got) == 5 and all(0 <= r.expected_grade <= 1 and 0 <= r.tail_probability <= 1 for r in got)
    assert quality.score(probe.limit(0), model).count() == 0
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(probe, empty).count() == 5


def test_one_long_text_does_not_cost_its_class(spark):
    """A text beyond the bound, of the class's first id by hash, leaves the others in the sample; alone it stays."""
    words = ["stupid", "worthless"]
    rows = [(k, f"the day {k} was fine and we walk home {k % 7}", 0) for k in range(200)]
    rows += [(1000 + k, f"you are all {words[k % 2]} people here {k % 7}", 1) for k in range(200)]
    ids = spark.createDataFrame([(r[0],) for r in rows if r[2]], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()
    first = ids[0].doc_id
    rows = [(d, "stupid people " * 400_000 if d == first else t, y) for d, t, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y, 1 - y) for d, _, y in rows], "doc_id long, toxic int, quality int")
    counts = {r["label"]: r["count"] for r in common.labelled_sample(docs, labels, "toxic", 750, 4 << 20).groupBy("label").count().collect()}
    assert counts == {0: 200, 1: 199}
    assert toxicity.fit(docs, labels).score(b"stupid people") > 0.9
    model = quality.fit(docs, labels, most_bytes=4 << 20)
    assert model.score(b"you are all stupid people here 3")[1] < 0.35 < model.score(b"the day 5 was fine and we walk home 1")[1]
    alone = docs.filter(f"doc_id < 1000 or doc_id = {first}")
    assert {r.label for r in common.labelled_sample(alone, labels, "toxic", 750, 4 << 20).select("label").distinct().collect()} == {0, 1}


def test_models_are_trained_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text of {'stupid' if i % 2 else 'good'} people {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    for kind in (toxicity, quality):
        monkeypatch.setattr(kind, "train", lambda *given: os.getpid())
        assert kind.fit(docs, labels) != os.getpid()
