"""Token counts by model: byte pairs merged by rank, over a vocabulary file of ranks.

A model names an encoding, an encoding a vocabulary (a file of base64 tokens with their ranks, and the pattern that cuts a
text into words). The files are the caller's; executors read them from the same path, once a worker. What comes out is a
TokenCounter, which every function that counts tokens takes in place of the estimate.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TokenCounter

#: The encoding of each known model, and that of all others.
MODEL_ENCODINGS = {"gpt-4": "cl100k_base", "gpt-4-turbo": "cl100k_base", "gpt-4o": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "gpt-3.5-turbo-16k": "cl100k_base"}
DEFAULT_ENCODING = "cl100k_base"
#: Words whose counts a worker keeps.
KEPT_WORDS = 100_000


@dataclass(frozen=True)
class Vocabulary:
    path: str
    pattern: str


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged_length(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens a word's bytes become when the neighbours of lowest rank are merged first, the leftmost of equals.

    Merges wait in a heap, parts know their neighbours; an entry whose parts have changed since is skipped.
    """
    if word in ranks:
        return 1
    end = len(word)
    after, ahead = list(range(1, end + 1)), list(range(-1, end))  # where a part ends, and where the one before it starts
    heap: list[tuple[int, int, int, int]] = []

    def offer(start: int) -> None:
        middle = after[start]
        if middle < end and (rank := ranks.get(word[start : after[middle]])) is not None:
            heapq.heappush(heap, (rank, start, middle, after[middle]))

    for start in range(end - 1):
        offer(start)
    parts = end
    gone = bytearray(end)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if gone[start] or after[start] != middle or after[middle] != stop:
            continue
        after[start], gone[middle] = stop, 1
        ahead[stop] = start
        parts -= 1
        offer(start)
        if ahead[start] >= 0:
            offer(ahead[start])
    return parts


def text_length(text: str, vocabulary: Vocabulary, known: dict[str, int]) -> int:
    """The tokens of a text. known: counts of words, kept up to KEPT_WORDS."""
    ranks, total = _ranks(vocabulary.path), 0
    for m in regex.finditer(vocabulary.pattern, text):
        word = m[0]
        n = known.get(word)
        if n is None:
            n = merged_length(word.encode(), ranks)
            if len(word) <= 40:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = n
        total += n
    return total


def model_tokens(model: str | None, vocabularies: dict[str, Vocabulary]) -> TokenCounter:
    """Counts tokens as a model does; a model that isn't known (or none) has the default encoding. Null texts have null tokens."""
    vocabulary = vocabularies[MODEL_ENCODINGS.get(model or "", DEFAULT_ENCODING)]

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            yield texts.map(lambda t: None if t is None else text_length(t, vocabulary, known)).astype("Int32")

    def counter(text: Column) -> Column:
        return count(text)

    return counter
