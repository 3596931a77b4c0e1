"""Quality grades by ordinal regression: one weight vector, ordered thresholds.

A text's features are hashed n-grams of its character shapes (upper case, lower case, digits; other
characters as they are) and of its words, each family a share of the text. A cumulative-link model
P(grade <= k) = sigmoid(threshold_k - weights . features) shares the weights among all grades and
keeps the thresholds in order; it gives the expected grade and the probability of a grade from a
wanted one on, by which documents are chosen.

Training sees a bounded sample of rated rows of each grade (see common.labelled_sample). Null and empty
texts have no features: the thresholds alone grade them. Repeated rows are graded alike, one by one. Texts
are read in blocks of about half a million bytes, cut at white space, so memory doesn't follow the longest
one. Of an empty table nothing is learned, and every text is of the wanted grade. Other columns pass
through; those that have the scores' names give way to them. More than 64 grades are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, field, labelled_sample, learned, map_columns, text_blocks, with_scores

#: Character shapes: letters by case, digits; anything else is itself. Beyond ASCII, case decides at training and scoring alike.
_SHAPE = np.arange(0x250, dtype="uint32")
for _c in range(0x250):
    _SHAPE[_c] = 65 if chr(_c).isupper() else 97 if chr(_c).isalpha() else 48 if chr(_c).isdigit() else _c


def features(text: bytes, bits: int) -> np.ndarray:
    """Shares of hashed shape n-grams (1 to 4 characters) and of hashed words, over the whole text; 2 ** bits numbers.

    The first number is the share of words that repeat the word before.
    """
    size, half = 1 << bits, 1 << (bits - 1)
    counts, words, letters = np.zeros(size), 0, 0
    for block in text_blocks(text):
        part = np.frombuffer(block.decode().encode("utf-32-le"), "<u4")
        letters += len(part)
        shape = np.where(part < 0x250, _SHAPE[np.minimum(part, 0x24F)], np.uint32(97))
        h = shape * np.uint32(2654435761)
        for n in range(1, 5):
            if n > 1:
                if len(shape) < n:
                    break
                h = h[: len(shape) - n + 1] * np.uint32(16777619) + shape[n - 1 :]
            counts[1:half] += np.bincount((h ^ h >> np.uint32(13)) * np.uint32(2246822519) >> np.uint32(33 - bits), minlength=half)[1:]
        blank = np.flatnonzero(np.concatenate([[True], part <= 32, [True]]))
        lengths = np.diff(blank) - 1
        kept = lengths > 0
        if kept.any():
            a, b = blank[:-1][kept], blank[1:][kept] - 1
            # a word's hash adds up a number for each letter and its place in the word
            place = np.arange(len(part)) - np.repeat(blank[:-1], np.diff(blank))[: len(part)]
            total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(_letter_mix(part, place), dtype="uint64")])
            word = (total[b] - total[a]) * np.uint64(0x9E3779B97F4A7C15) + lengths[kept].astype("uint64")
            counts[0] += 4 * len(part) * np.mean(word[1:] == word[:-1]) if len(word) > 1 else 0
            counts[half:] += np.bincount((word >> np.uint64(65 - bits)).astype("int64"), minlength=half)
            words += int(kept.sum())
    counts[:half] /= max(1, 4 * letters)
    counts[half:] /= max(1, words)
    return counts


def _letter_mix(part: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (part.astype("uint64") + (place.astype("uint64") << np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def deviations(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How far features are from the usual, three spreads at most: one word said over and over is no better for being a good word."""
    return np.clip((x - centre) / spread, -3, 3)


@dataclass
class Model:
    """weights over the features' deviations, thresholds in order, and the grades that they part."""

    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    bits: int
    wanted: int

    def score(self, text: bytes) -> tuple[float, float]:
        """The expected grade, and the probability of the wanted grade or a better one."""
        x = float(deviations(features(text, self.bits), self.centre, self.spread) @ self.weights)
        above = 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))  # P(grade > k)
        steps = np.diff(self.grades)
        tail = [above[k] for k, g in enumerate(self.grades[1:]) if g >= self.wanted and self.grades[k] < self.wanted]
        return self.grades[0] + float(above @ steps), float(tail[0]) if tail else float(self.wanted <= self.grades[0])


def train(x: np.ndarray, grades: np.ndarray, bits: int, wanted: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adam on the cumulative-link likelihood, all grades weighted alike. Features are scaled by their spread in the sample."""
    known = sorted(set(grades.tolist()))
    if len(known) < 2:
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), np.ones(1 << bits), np.zeros(0), known or [wanted], bits, wanted)
    rank = np.searchsorted(known, grades)
    centre = x.mean(0, dtype="float64")
    z = (x - centre.astype("float32")).astype("float32", copy=False)
    spread = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z)).astype("float64") + 1e-4
    z /= spread.astype("float32")
    np.clip(z, -3, 3, out=z)  # deviations(), in place
    share = 1 / np.sqrt(max(1, (np.einsum("ij,ij->j", z, z) / len(z) - z.mean(0) ** 2 > 0.01).sum()))
    weight = (1 / np.bincount(rank))[rank] / len(known)
    w, first, gaps = np.zeros(z.shape[1]), np.array(-0.5 * (len(known) - 2)), np.zeros(len(known) - 2)
    params, moments = [w, first, gaps], [[0.0, 0.0] for _ in range(3)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    for step in range(1, steps + 1):
        w, first, gaps = params
        theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        score = share * (z @ w.astype("float32"))
        upper = np.where(rank < len(known) - 1, sigmoid(theta[np.minimum(rank, len(theta) - 1)] - score), 1.0)
        lower = np.where(rank > 0, sigmoid(theta[np.maximum(rank - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        g_score = d_upper - d_lower
        g_theta = np.zeros(len(theta))
        np.add.at(g_theta, np.minimum(rank, len(theta) - 1), np.where(rank < len(known) - 1, -d_upper, 0))
        np.add.at(g_theta, np.maximum(rank - 1, 0), np.where(rank > 0, d_lower, 0))
        tails = np.cumsum(g_theta[::-1])[::-1]
        grads = [share * (z.T @ g_score.astype("float32")) + decay * w, tails[0], tails[1:] * np.exp(gaps)]
        for k, g in enumerate(grads):
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            params[k] = params[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    w, first, gaps = params
    theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    return Model(share * w, centre, spread, theta, known, bits, wanted)


def fit(docs: DataFrame, ratings: DataFrame, rating: str = "quality", wanted: int | None = None, most: int = 1500, most_bytes: int = 16 << 20, bits: int = 12) -> Model:
    """A model from docs(doc_id, text) and ratings(doc_id, rating): of each grade at most `most` rated rows and most_bytes of text.

    One task gets 2 ** bits numbers for each of them and trains; the driver gets the model. wanted: the lowest grade worth
    keeping, the second lowest grade there is if not given.
    """
    sample = labelled_sample(docs, ratings, rating, most, most_bytes)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "grade": batch["label"], "x": [features(t, bits).astype("float32") for t in batch["text"]]}

    def train_on(found: pa.Table) -> Model:
        order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
        x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, 1 << bits)[order]
        grades = found["grade"].to_numpy()[order]
        del found
        known = sorted(set(grades.tolist()))
        return train(x, grades, bits, wanted if wanted is not None else known[min(1, len(known) - 1)] if known else 0)

    rows = map_columns(sample, {c: F.col(c) for c in ("doc_id", "label", "text")}, [field("doc_id", "long"), field("grade", "int"), field("x", ["float"])], run)
    model = learned(rows, train_on)
    drop_written(sample)
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """docs with the expected grade and the tail probability under these names; other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, lambda text: sent.value.score(text), list(names))


def kept(tail: str = "tail_probability", least: float = 0.35) -> F.Column:
    """Whether a scored document stays: only those go that are likelier below the wanted grade by a margin."""
    return F.col(tail) >= least
