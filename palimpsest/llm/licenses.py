"""Licence scan: exact phrases, and short notices found despite a few typing errors.

A text is brought to lower-case words with one space between. Exact phrases give the base counts.
For the fuzzy search each notice is split into one part more than the errors it may hold: by the
pigeonhole principle one part is then intact. One automaton finds all parts of all notices, the
regex library checks the place for the notice with at most its errors, and the match is reported
as a span of the given text in code points. The words that tell a licence from others are set in
capitals in the table: a match must hold each of them, without an error in up to four letters and with
one at most in longer ones; two neighbours exchanged are allowed in both, unless that makes another licence's
word. Matches start and end with words.

Null and empty texts have no words, null places, empty label lists and score 0. Repeated rows are
scanned one by one and give equal rows. Where matches of a notice overlap, the one with the fewest edits
stays, the first of those. Every place is checked by itself, so the work follows the text's length also where
notices repeat; memory is a few copies of the text. An empty table gives an empty one. Columns besides
doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_columns, text_blocks

#: The phrases of the base and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices, in words, and the label each one gives, which may stand for a family of licences; capitals
#: mark the words that tell licences apart.
NOTICES = {
    "under the MIT license": "mit",
    "APACHE license version 2": "apache-2",
    "APACHE license 2": "apache-2",
    "licensed under APACHE 2": "apache-2",
    "spdx license identifier MIT": "mit",
    "spdx license identifier APACHE 2": "apache-2",
    "spdx license identifier BSD": "bsd",
    "spdx license identifier GPL": "gpl",
    "spdx license identifier LGPL": "lgpl",
    "spdx license identifier AGPL": "agpl",
    "spdx license identifier MPL": "mpl",
    "spdx license identifier ISC": "isc",
    "licensed under the MIT license": "mit",
    "released under the MIT license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the APACHE license version 2": "apache-2",
    "licensed under APACHE license version 2": "apache-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the BSD license": "bsd",
    "released under the BSD license": "bsd",
    "gnu GENERAL public license": "gpl",
    "gnu LESSER general public license": "lgpl",
    "gnu AFFERO general public license": "agpl",
    "MOZILLA public license": "mpl",
    "ECLIPSE public license": "epl",
    "BOOST SOFTWARE license": "bsl",
    "ISC license permission to use copy modify": "isc",
    "licensed under the ISC license": "isc",
    "this is free and UNENCUMBERED software released into the public domain": "unlicense",
    "CREATIVE commons attribution NONCOMMERCIAL": "cc-by-nc",
    "licensed under CC BY NC": "cc-by-nc",
    "CREATIVE commons attribution SHAREALIKE": "cc-by-sa",
    "CREATIVE commons attribution NODERIVATIVES": "cc-by-nd",
    "CREATIVE commons ZERO public domain dedication": "cc0",
    "all RIGHTS RESERVED no part of this": "all-rights-reserved",
}

_TO_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def errors_allowed(notice: str) -> int:
    """One edit for every ten letters, two at least: as many as two exchanged letters count for."""
    return max(2, len(notice) // 10)


def parts(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of near equal size, each with its place."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Notice:
    """A notice as it is searched: its letters, label, errors, pattern, short words with their exchanged forms, and long ones that may have one error."""

    text: str
    label: str
    errors: int
    pattern: regex.Pattern
    intact: list[list[str]]
    near: list[regex.Pattern]


#: Words that name licences; none of them is another one with letters exchanged.
NAMES = {w.lower() for notice in NOTICES for w in notice.split() if w.isupper()}


def exchanged(word: str) -> list[str]:
    """The word with two neighbouring letters exchanged, but for what names a licence itself."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - NAMES)


def notice_of(marked: str, label: str) -> Notice:
    text, keys = marked.lower(), [w.lower() for w in marked.split() if w.isupper()] + [w for w in marked.split() if w.isdigit()]
    errors = errors_allowed(text)
    pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={errors}}}(?= )")
    short = [[f" {form} " for form in (k, *exchanged(k))] for k in keys if len(k) <= 4]
    return Notice(text, label, errors, pattern, short, [regex.compile(rf"(?<= )(?:(?:{k}){{e<=1}}|{'|'.join(exchanged(k))})(?= )") for k in keys if len(k) > 4])


def holds(words: str, forms: list[str], low: int = 0, high: int | None = None) -> bool:
    return any(words.find(form, low, high) >= 0 for form in forms)


@functools.cache
def searcher():
    """The automaton of all notices' parts, and the notices."""
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    notices = [notice_of(marked, label) for marked, label in NOTICES.items()]
    for n, notice in enumerate(notices):
        for at, part in parts(notice.text, notice.errors):
            found.setdefault(part, []).append((n, at))
    automaton = ahocorasick.Automaton()
    for part, places in found.items():
        automaton.add_word(part, (len(part), places))
    automaton.make_automaton()
    return automaton, notices


def fuzzy_matches(padded: str) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, score) of notices in words with a space before and after each, by start."""
    automaton, notices = searcher()
    windows: set[tuple[int, int]] = set()
    best: dict[int, list[tuple[int, int, int]]] = {}
    for end, (length, places) in automaton.iter(padded):
        for n, at in places:
            start = end + 1 - length - at  # where the notice would start
            if (n, start) in windows:
                continue
            windows.add((n, start))
            notice = notices[n]
            low, high = max(1, start - notice.errors), min(len(padded), start + len(notice.text) + notice.errors + 1)
            if all(holds(padded, k, low - 1, high) for k in notice.intact) and (m := notice.pattern.search(padded, low, high)):
                words = padded[m.start() - 1 : m.end() + 1]
                if all(holds(words, k) for k in notice.intact) and all(k.search(words) for k in notice.near):
                    best.setdefault(n, []).append((sum(m.fuzzy_counts), m.start(), m.end()))
        if len(windows) > 10_000:  # places come by their ends, so those far behind are not met again
            windows = {(n, s) for n, s in windows if s > end - 200}
    out = []
    for n, found in best.items():
        kept: list[tuple[int, int]] = []
        for edits, start, end in sorted(set(found)):
            k = bisect_left(kept, (start, end))
            if not (k < len(kept) and kept[k][0] < end or k and kept[k - 1][1] > start):
                kept.insert(k, (start, end))
                out.append((start, end, notices[n].label, edits, 1 - edits / (len(notices[n].text) + 1)))
    return sorted(out)


def word_places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which phrase's words stand in words with a space before and after each."""
    needle, out, word, last = b" " + phrase + b" ", [], 0, 0
    at = padded.find(needle)
    while at >= 0:
        word += padded.count(b" ", last, at)
        out.append(word)
        last, at = at, padded.find(needle, at + 1)
    return out


def scan_text(text: bytes) -> dict:
    """All that is found in one text."""
    split = [b" ".join(words) for block in text_blocks(text, anywhere=False) if (words := block.lower().translate(_TO_SPACE).split())]
    padded = b"".join([b" ", *(s + b" " for s in split)])
    base = {label: places for phrase, label in BASE.items() if (places := word_places(padded, phrase.encode()))}
    letters = padded.decode()
    found = []  # first word, last word, label, edits, score
    word = last = 0
    for start, end, label, edits, score in fuzzy_matches(letters):
        word, last = word + letters.count(" ", last, start - 1), start - 1
        found.append((word, word + letters.count(" ", start, end), label, edits, score))
    for phrase, label in BASE.items():
        found += [(w, w + phrase.count(" "), label, 0, 1.0) for w in base.get(label, [])]
    spans = []
    if found:
        wanted = {w for f in found for w in f[:2]}
        at = {n: m.span() for n, m in enumerate(_WORD.finditer(text.decode().translate(_LOWER))) if n in wanted}
        spans = [{"label": label, "start": at[a][0], "end": at[b][1], "edits": edits, "score": score} for a, b, label, edits, score in found]
    places = [w for ws in base.values() for w in ws]
    return {
        "n_words": padded.count(b" ") - 1,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
        "score": max((s["score"] for s in spans), default=0.0),
        "spans": sorted(spans, key=lambda s: (s["start"], s["end"], s["label"], s["edits"])),
    }


def scan(docs: DataFrame) -> DataFrame:
    """One row for each of docs(doc_id, text): base counts, labels, score and spans."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [scan_text(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"]} | {f.name: [x[f.name] for x in found] for f in fields[1:]}

    fields = [field("doc_id", "long"), field("n_words", "long"), field("n_base", "long"), field("first_word", "long"), field("last_word", "long"),
              field("base_labels", "string"), field("labels", "string"), field("score", "double"),
              field("spans", [{"label": "string", "start": "long", "end": "long", "edits": "long", "score": "double"}])]
    inputs = {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}
    return map_columns(docs, inputs, fields, run)
