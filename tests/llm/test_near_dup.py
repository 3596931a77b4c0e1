import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import near_dup


def brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def made(seed, n=25):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé", k=4)) for _ in range(300)]
    rows = []
    for g in range(n):
        base = rnd.choices(vocabulary, k=rnd.choice([1, 3, 5, 7, 20, 60, 150, 400]))
        rows.append(base)
        for _ in range(rnd.randrange(0, 7)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 50) + 1)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(copy)
            if rnd.random() < 0.3:
                base = copy  # chains
    rnd.shuffle(rows)
    return [(i, rnd.choice([" ", "\n", "\t "]).join(r)) for i, r in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = made(1) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "w " * 40000 + "end"), (906, "W " * 40000 + "end")]
    rows += [(1000 + i, "the same long opening of a text " + "shared words here " * 6 + f"v{i % 3} " * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", near_dup.F.lit("x")).withColumn("n", near_dup.F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    assert {k for k, v in got.items() if k == v[1]} == {r.doc_id for r in near_dup.near_duplicates(df).collect() if r.kept}


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text), (None, "x y"), (8, "lonely")], "doc_id long, text string")
    got = sorted([(r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (-1, 5, False), (7, 5, False), (-1, None, True), (8, 8, True)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(300, 3000), st.floats(0.5, 1.0))
def test_estimate_is_near_jaccard(seed, n, j):
    rng = np.random.default_rng(seed)
    common = int(n * 2 * j / (1 + j))
    pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2))
    a, b = np.sort(pool[rng.permutation(len(pool))[:n]]), None
    keep = rng.permutation(n)[:common]
    fresh = np.unique(rng.integers(0, 2**63, n - common, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    b = np.unique(np.concatenate([a[keep], fresh]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = near_dup.estimate(near_dup.registers(a).tobytes(), near_dup.registers(b).tobytes(), len(a), len(b))
    assert abs(got - true) < 0.2


def test_band_recall_at_threshold():
    rng = np.random.default_rng(4)
    missed = 0
    for n in [4, 7, 12, 40, 150, 500] * 60:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(len(a) * 0.15)
        b = a[np.sort(rng.permutation(len(a))[: len(a) - drop])] if drop else a
        missed += not (near_dup.band_keys(near_dup.registers(a)) == near_dup.band_keys(near_dup.registers(b))).any()
    assert missed == 0


def test_blocks_hash_alike():
    text = b" ".join(b"w%d" % (i % 977) for i in range(3000))
    want = near_dup.word_hashes(text)
    size, near_dup.BLOCK = near_dup.BLOCK, 400
    try:
        assert (near_dup.word_hashes(text) == want).all()
    finally:
        near_dup.BLOCK = size


def test_large_group_of_near_copies_makes_few_pairs(spark):
    """Copies of one text, each with its own edits or one of a few shared ones: components as by brute force."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    variants = []
    for _ in range(4):
        v = list(base)
        for k in rnd.sample(range(160), 3):
            v[k] = f"s{rnd.randrange(10**6)}"
        variants.append(v)
    rows = []
    for i in range(260):
        t = list(rnd.choice([base, *variants]))
        for k in rnd.sample(range(len(t)), rnd.choice([0, 1, 2, 2, 3, 4])):
            t[k] = f"e{rnd.randrange(10**6)}"
        if rnd.random() < 0.2:
            del t[rnd.randrange(len(t))]
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert 1 < len({c for _, c in got.values()}) < 260


def test_estimate_keeps_links_of_all_sizes():
    """Pairs just at the threshold, from seven shingles to thousands: the estimate loses none of them."""
    rng = np.random.default_rng(5)
    kept = tried = 0
    for n in [7, 8, 14, 20, 40, 80, 150, 256, 400, 900, 3000] * 60:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        swapped = rng.random() < 0.5  # some pairs have shingles of their own on both sides, the others on one
        lost = int(n * 15 / 185) if swapped else int(n * 0.15)
        own = rng.integers(0, 2**64, lost if swapped else 0, dtype=np.uint64)
        b = np.unique(np.concatenate([a[np.sort(rng.permutation(n)[: n - lost])], own]))
        tried += 1
        kept += near_dup.estimate(near_dup.registers(a).tobytes(), near_dup.registers(b).tobytes(), len(a), len(b)) >= near_dup.LEAST_ESTIMATE
    assert tried == 660 and kept == tried


def test_words_of_one_structure_have_their_own_hashes():
    """Sums over powers of one number modulo 2 ** 64 are equal for these two, whatever the number."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == 1024 and near_dup.word_hashes(a.encode()) != near_dup.word_hashes(b.encode())
    assert len(set(near_dup.word_hashes(b"ab ba aab aba baa a b").tolist())) == 7


def test_split_keys_give_the_same_links(spark):
    rows = made(5, 12)
    base = [f"w{i}" for i in range(60)]
    rnd = random.Random(9)
    for i in range(60):  # copies about the threshold, so that components meet under the hubs' entries
        copy = list(base)
        for k in rnd.sample(range(60), rnd.randrange(0, 3)):
            copy[k] = f"v{rnd.randrange(6)}"
        rows.append((5000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, part=3).collect()}
    assert got == brute(rows)
