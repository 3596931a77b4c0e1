import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import bpe, common, packing
from palimpsest.llm.registry import vocabulary

TEXTS = [None, "", "  \n", "Hello   World's don't <|endoftext|> x", "a" * 9000, "tie tie", "tie tie", "é́ \x1cq\x1d İ Σας ΟΔΟΣ 12½ 　​", "the end\t\t\nof " * 900, "\U0001f600 ok̀"]


def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, "tie tie", "y")], "doc_id long, text string, length string")


def test_bpe_equals_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs(spark), path), path).collect()
    assert len(got) == len(TEXTS) + 1
    want = {i if i != 3 else None: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for row in got:
        assert row.ids == want[row.doc_id]
        assert row.text == library.decode(row.ids, skip_special_tokens=False)


def test_bpe_empty_table(spark):
    path = vocabulary("byte_bpe_50k.json")
    assert bpe.decode(bpe.encode(docs(spark).limit(0), path), path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    path = vocabulary("byte_bpe_50k.json")
    library = bpe.loaded(path)
    if not hasattr(library, "reference"):
        library.reference = Tokenizer.from_file(path)
    ids = library.reference.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(library.encode(text), "<i4").tolist()
    assert mine == ids
    assert library.decode(mine) == library.reference.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.characters(max_codepoint=0x250), max_size=60) | st.lists(st.sampled_from(["'s", "'", "don't", "It'LL", "é", "É", "İ", "ſ", "<|endoftext|>", "<|", "9", "12", "!?", " ", "\n", "word", "WORD"])).map("".join))
def test_runs_equal_whole_text(text):
    path = vocabulary("word_bpe_49k.json")
    encode = packing.chunk_encoder(path)
    if not hasattr(encode, "reference"):
        encode.reference = Tokenizer.from_file(path)
    mine = np.frombuffer(b"".join(encode[c] for c in text.encode().split()), "<u4").tolist()
    assert mine == encode.reference.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.packed_documents(docs(spark), path, 256).collect()
    by = {}
    for row in got:
        by.setdefault(row.sequence_id, []).append(row)
    for rows in by.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= 256
    want = []
    for i, t in [*enumerate(TEXTS), (5, "tie tie")]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want.append((-1 if i == 3 else i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert packing.packed_documents(docs(spark).limit(0), path).count() == 0


def test_assemble(spark):
    path = vocabulary("word_bpe_49k.json")
    some = docs(spark).filter("doc_id in (1, 8)")
    pieces = packing.token_pieces(some, path, 64, keep_ids=True)
    rows = packing.assemble(pieces, packing.packed_documents(some, path, 64)).collect()
    library = Tokenizer.from_file(path)
    assert sum(len(r.ids) for r in rows) == len(library.encode(TEXTS[8], add_special_tokens=False).ids) + 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_swap_search_keeps_items(lengths):
    start = packing.best_fit(lengths, 100)
    bins = packing.swap_search([list(b) for b in start], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(start)


def test_swap_search_empties_bins():
    # first-come bins that exchanges can bring to the bound of two
    lengths = [60, 30, 50, 40, 10, 10]
    assert len(packing.swap_search([[0, 1], [2, 5], [3, 4]], lengths, 100)) == 2


def least_bins(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[k]:
                i = rooms.index(r)
                place(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=7))
def test_packing_is_near_the_least_number_of_bins(lengths):
    bins = packing.swap_search(packing.best_fit(lengths, 50), lengths, 50)
    assert len(bins) <= least_bins(sorted(lengths, reverse=True), 50) + (len(lengths) > 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_steps_raise_the_squared_fill(lengths):
    start = [[i] for i in range(len(lengths))]
    bins = packing.swap_search(start, lengths, 40)
    squared = lambda bs: sum(sum(lengths[i] for i in b) ** 2 for b in bs)
    assert squared(bins) >= squared(start)


def test_equal_pieces_take_no_quadratic_time():
    import time

    start = time.perf_counter()
    lengths = [1025] * 20_000
    assert len(packing.swap_search(packing.best_fit(lengths, 2048), lengths, 2048)) == 20_000
    assert time.perf_counter() - start < 20


def test_groups_are_bounded_for_repeated_rows(spark):
    pieces = packing.written(spark.range(60_000).selectExpr("1L as doc_id", "0 as piece", "0L as start", "100L as length", "9L as ids_crc32").repartition(7), "test")
    rows = packing.pack(pieces, 2048)
    sizes = [r.n for r in rows.groupBy(packing.F.shiftright("sequence_id", 32).alias("g")).agg(packing.F.count("*").alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) < 21_000 and sum(sizes) == 60_000
    assert rows.groupBy("sequence_id").agg(packing.F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_blocks_give_the_same_pieces(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    encode = packing.chunk_encoder(path).__getitem__
    text = ("Some words, don't é " * 400 + "a" * 3000 + " end").encode()
    end = bytes(4)
    whole = b"".join(packing.cut(packing.block_ids(text, encode, end), 64))
    monkeypatch.setattr(packing, "text_blocks", lambda t, anywhere: common.text_blocks(t, 100, anywhere))
    pieces = list(packing.cut(packing.block_ids(text, encode, end), 64))
    assert b"".join(pieces) == whole and all(len(p) == 64 for p in pieces[:-1])
    assert np.frombuffer(whole, "<u4").tolist()[:-1] == Tokenizer.from_file(path).encode(text.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize(("low", "high", "most"), [(600, 760, 1010), (400, 620, 760), (500, 1100, 1262)])
def test_search_saves_bins_on_hard_lengths(low, high, most):
    lengths = np.random.default_rng(3).integers(low, high + 1, 3000).tolist()
    fitted, other = packing.best_fit(lengths, 2048), packing.room_for_smallest(lengths, 2048)
    for start in (fitted, other):
        bins = packing.swap_search(start, lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(lengths[i] for i in b) for b in bins) <= 2048
        assert len(bins) <= len(start)
    assert len(packing.swap_search(fitted, lengths, 2048)) < len(fitted)
    assert len(packing.swap_search(min(fitted, other, key=len), lengths, 2048)) <= most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_other_start_keeps_items(lengths):
    bins = packing.room_for_smallest(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
