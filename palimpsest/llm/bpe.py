"""Byte-level BPE encoding and decoding from a vocabulary file.

``encode`` gives rows (key, ids), ``decode`` turns such ids into text. A word's merges run by
a priority queue of ranks over a doubly linked list of symbols; entries whose symbols have changed
since are skipped. Words repeat, so each worker keeps a cache of them, bounded in bytes.

Null and empty texts give no ids, and no ids decode to an empty text. Repeated rows are encoded one by one, to equal
ids; a null key is a key like any other. Of merges of equal rank the leftmost goes first, as in the library. A text is
encoded whole, so memory is some times its length; an empty table gives an empty one. Other columns are neither read
nor returned, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache, field, map_columns

#: White space by Unicode's property; the regex library's \s also holds the separators U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern that the vocabulary was made with.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in such vocabularies: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(0x100 + n)
    return table


class Bpe:
    """The merges and strings of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        vocabulary = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.byte_ids = [vocabulary[symbols[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split_words = regex.compile(WORDS)
        self.words = BoundedCache(lambda word: np.array(self.merged(word.encode()), "<i4").tobytes(), 96 << 20)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.merges.get
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, made = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((made, ids[k])):
                    heappush(queue, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := get((ids[h], made))):
                heappush(queue, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes; special strings in it are their own ids."""
        word = self.words.__getitem__
        find = self.split_words.findall
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(word, find(text)))
        out = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [np.array([self.special[part]], "<i4").tobytes()] if k % 2 else map(word, find(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key as long, ids array<int>) of docs."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t.decode()) for t in batch["text"]]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield {key: batch["key"], "ids": pa.ListArray.from_arrays(pa.array(ends), values)}

    inputs = {"key": F.col(f"`{key}`").cast("long"), "text": F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))}
    return map_columns(docs, inputs, [field(key, "long"), field("ids", ["int"])], run)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, text) of rows (key, ids): the text is the vocabulary's strings put together."""
    fields = [field(key, "long"), field("ids", ["int"]), field("text", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = batch.column(1)
            texts = [bpe.decode([] if not row.is_valid else row.values.to_numpy(zero_copy_only=False).tolist()) for row in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=[key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(run, T.StructType(fields))
