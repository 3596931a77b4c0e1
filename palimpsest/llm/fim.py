"""Fill-in-middle: a text's prefix, middle and suffix in another order, by rotations in place, and the way back.

A text is cut between tokens (a word with the white space before it; white space at the end is one more). Both cuts,
whether a text changes and how follow from a digest of the seed and the row's id, so a row meets the same fate wherever it
is. The text is one bytearray: the scan for the cuts reads it once, sentinels are inserted into it, and two neighbouring
segments change places by three reversals, block by block, so a text of any length needs its own size and no more. The
same rotation the other way round, and the sentinels taken out, give the text back.

Texts that are empty or hold a sentinel stay plain, so a form and an output are one text and no other. A null text is
empty; a null id is written as nothing behind the seed, so all such rows have one fate; repeated rows are transformed
alike, one by one. An empty table gives an empty one. Other columns pass through; those that have the results' names give way.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, field, released

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RESULTS = [field("n", "long"), field("form", "string"), field("prefix_chars", "long"), field("middle_chars", "long"), field("output", "binary")]
BLOCK = 1 << 16


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Turns buffer[start:end] round in place, a block from both ends at a time."""
    while end - start > 1:
        k = min(BLOCK, (end - start) // 2)
        low = buffer[start : start + k].copy()
        buffer[start : start + k] = buffer[end - k : end][::-1]
        buffer[end - k : end] = low[::-1]
        start, end = start + k, end - k


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """data[start:middle] and data[middle:end] change places."""
    buffer = np.frombuffer(data, "u1")
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


def fate(name: str) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 of a name."""
    digest = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def cuts(text: bytes, wanted: tuple[int, int], n: int) -> tuple[int, int]:
    """The byte places behind the wanted numbers of tokens, of n; the scan stops at the later one."""
    low, high = sorted(w % (n + 1) for w in wanted)
    places, seen = {0: 0}, 0
    if high:
        for m in TOKEN.finditer(text):
            seen += 1
            if seen in (low, high):
                places[seen] = m.end()
            if seen == high:
                break
    return places[low], places[high]


def characters(text: bytes | bytearray, start: int, end: int) -> int:
    """Code points of text[start:end], which is cut between characters."""
    part = np.frombuffer(text, "u1", end - start, start) if end > start else np.zeros(0, "u1")
    return sum(int(np.count_nonzero((part[k : k + BLOCK] & 0xC0) != 0x80)) for k in range(0, len(part), BLOCK))


def transformed(text: bytes, name: str, rate: int = 50, spm_rate: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of a text; rates in per cent."""
    n = sum(1 for _ in TOKEN.finditer(text))
    h1, h2, h3, h4 = fate(name)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = cuts(text, (h1, h2), n)
    data = bytearray(text)
    data[high:high] = SUFFIX
    data[low:low] = MIDDLE
    data[0:0] = PREFIX
    # <P>prefix<M>middle<S>suffix
    middle, suffix = low + 3, high + 6
    form = "spm" if h4 % 100 < spm_rate else "psm"
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return n, form, characters(text, 0, low), characters(text, low, high), bytes(data)


def restored(output: bytes, form: str) -> bytes:
    """The text of an output of this form."""
    if form == "plain":
        return output
    data = bytearray(output)
    second = data.find(MIDDLE if form == "psm" else PREFIX)
    rotate(data, data.find(SUFFIX) if form == "psm" else 0, second, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = data.find(mark)
        del data[at : at + 3]
    return bytes(data)


def with_fim(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars (null if plain) and output (the text in its new order)."""
    kind = T.StructType([f if f.name != "output" else field("output", "string") for f in RESULTS])
    arrow = pa.struct([pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64()), pa.field("output", pa.string())])

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for names, texts in batches:
                rows = [transformed(t.as_py() or b"", f"{seed}:{k.as_py() or ''}", rate, spm_rate) for k, t in zip(names, as_bytes(texts))]
                columns = list(zip(*rows)) or [()] * 5
                arrays = [pa.array(list(c), pa.binary() if f.name == "output" else f.type) for c, f in zip(columns, arrow)]
                yield pa.StructArray.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], fields=list(arrow))
        finally:
            released()

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(of, kind)(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    out = docs.withColumn(taken := f"_fim_{uuid.uuid4().hex}", made)
    names = [f.name for f in RESULTS]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return out.select(*kept, *[F.col(f"`{taken}`.`{c}`").alias(c) for c in names])


def restored_text(output: F.Column, form: F.Column) -> F.Column:
    """The original text, from an output and its form alone."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for outputs, forms in batches:
                yield pa.array([restored(o.as_py() or b"", f.as_py() or "plain") for o, f in zip(as_bytes(outputs), forms)], pa.binary()).cast(pa.string())
        finally:
            released()

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, T.StringType())(output, form)
