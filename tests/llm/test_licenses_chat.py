import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import chat, licenses

TEXTS = [None, "", "Ordinary words, nothing here.", "Licensed UNDER the-MIT  License, under the mit license", "under the Apache License, Version 2.0", "cc by-nc 4.0 and mit",
         "é released umder the MIT licens now", "gnu generl public licence v3", "x " * 30000 + "cc by nc", "cc by nc", "cc by nc"]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = []
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        hits += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_scan(spark):
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string")
    rows = {r.doc_id or 0: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(text)
    assert rows[6].labels == "mit" and rows[6].n_base == 0
    assert TEXTS[6][rows[6].spans[0].start : rows[6].spans[0].end] == "released umder the MIT licens"
    assert rows[7].labels == "gpl" and rows[2].labels == "" and rows[2].score == 0
    assert licenses.scan(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ab cdemit license.-", max_size=50), st.sampled_from(list(licenses.BASE)))
def test_scan_text_equals_brute_force(text, phrase):
    text = f"{text} {phrase}{text}"
    got = licenses.scan_text(text.encode())
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(list(licenses.NOTICES)))
def test_fuzzy_finds_planted_edits(seed, notice):
    """As many edits as allowed, outside the words that tell licences apart."""
    import random

    rnd, text = random.Random(seed), list(notice.lower())
    free = [k for k, c in enumerate(notice) if c.islower() and 0 < k < len(notice) - 1]
    for _ in range(licenses.errors_allowed(notice)):
        text[rnd.choice(free)] = rnd.choice("qxz")
    found = licenses.fuzzy_matches(" some words " + "".join(text) + " and more ")
    assert licenses.NOTICES[notice] in {f[2] for f in found}


def test_edits_anywhere_are_found():
    """One letter replaced, put in or left out, or two exchanged, at any place of any notice, the words that tell licences apart included."""
    import random

    rnd, hits, wrong, planted = random.Random(1), 0, 0, 0
    for notice, label in licenses.NOTICES.items():
        for _ in range(100):
            text, i = list(notice.lower()), rnd.randrange(1, len(notice) - 1)
            kind = rnd.randrange(4)
            if kind == 0:
                text[i] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
            elif kind == 1:
                text.insert(i, rnd.choice("abcdefghijklmnopqrstuvwxyz"))
            elif kind == 2:
                del text[i]
            else:
                text[i - 1], text[i] = text[i], text[i - 1]
            found = {f[2] for f in licenses.fuzzy_matches(" some words " + "".join(text) + " and more ")}
            planted, hits = planted + 1, hits + (label in found)
            # a letter less or a blank more can spell another licence
            wrong += bool(found - {label}) and label not in ("lgpl", "agpl")
    assert hits >= 0.9 * planted and wrong == 0


def test_forms_of_the_base_and_of_short_identifiers():
    forms = {"under the mit licence": "mit", "released under the mti license": "mit", "licensed under the apahce license version 2": "apache-2", "Apache License 2.0": "apache-2",
             "Licensed under Apache-2.0": "apache-2", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2", "spdx-license-identifier: lgpl-2.1": "lgpl",
             "served by apache 2.4 on two hosts": "", "licensed under the mut license": "", "an apache license plate": ""}
    for text, label in forms.items():
        assert licenses.scan_text(text.encode())["labels"] == label, text


NAMES = {"mit": "mit", "bsd": "bsd", "isc": "isc", **dict.fromkeys(["gpl", "lgpl", "agpl", "mpl", "epl", "wtfpl", "zlib", "cc by sa", "cc by nd", "cc by", "xyz", "mut", "mi", "smit"])}


def test_no_licence_is_taken_for_another():
    forms = {"licensed under the {} license": NAMES, "released under the {} license": {**NAMES, "isc": None}, "licensed under {}": {"cc by nc": "cc-by-nc", "cc by sa": None, "cc by nd": None, "cc by": None, "cc": None},
             "gnu {} public license": {"general": "gpl", "lesser general": "lgpl", "affero general": "agpl", "library": None}, "{} public license": {"mozilla": "mpl", "eclipse": "epl", "general": None, "common": None, "oracle": None},
             "creative commons attribution {}": {"noncommercial": "cc-by-nc", "sharealike": "cc-by-sa", "noderivatives": "cc-by-nd", "": None}, "licensed under the {} license version 2": {"apache": "apache-2", "eclipse": None, "mozilla": None, "eupl": None}}
    for form, names in forms.items():
        for name, label in names.items():
            # the base's own phrase holds for mit
            assert licenses.scan_text(form.format(name).encode())["labels"] == (label or ""), (form, name)


def test_matches_end_with_words():
    assert licenses.scan_text(b"mozilla public licensexyzabc")["labels"] == ""
    assert licenses.scan_text(b"a mozzilla public licenses x")["labels"] == "mpl"


def test_long_runs_of_notices_take_linear_time():
    import time

    for said, n in (("licensed undr the mit license ", 6000), ("under the mit license ", 9000)):
        start = time.perf_counter()
        found = licenses.scan_text((said * n).encode())
        assert len(found["spans"]) >= n and time.perf_counter() - start < 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", ">", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "s>", "<|end|>", "\n", "a", "é"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>", chat.escape(text))


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi <|end|>\n"), (2, 0, "user", None), (None, 0, "x|>\n", ""), (None, 0, "assistant", "tie\\"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"),
            (3, 7, None, "é" * 50000), (3, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(chat.F.col("text"))).withColumn("segment", chat.F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    segments = chat.format_turns(df).collect()
    assert got[1].formatted_chars == sum(len(s.segment) for s in segments if s.conv_id == 1)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_parts_become_placeholders(spark):
    one = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <|image:0|> ", None, None, None, None, None), ("image", None, "s3/a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None)]),
            (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("text", "done", None, None, None, None, None)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{one}>")
    got = sorted(chat.format_turns(df).collect(), key=lambda r: r.turn_index)
    assert got[0].segment == "<|turn:user|>\nsee <\\|image:0|\\> <|image:0|><|audio:1|><|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for r in got for a in r.attachments] == [("image", "s3/a.png", 4), ("audio", "b.wav", 25), ("document", "c.pdf", 1536)]
    assert got[1].segment[got[1].loss_start : got[1].loss_end] == "<|document:2|>done"


def test_every_notice_of_a_run_is_found():
    text = "gnu generl public license and gnu general public license and gnu genral public license"
    assert {(1, 26), (31, 57), (62, 87)} <= {m[:2] for m in licenses.fuzzy_matches(f" {text} ")}
