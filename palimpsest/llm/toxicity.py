"""Toxicity scores: subword-bag embeddings, averaged, into a linear softmax.

A word's subwords are its character n-grams with marks for its start and end, hashed into rows of one
embedding table; a word's vector is the mean of its subwords'. A text is one bag: the weighted average
of all its words' vectors, and that average goes into a softmax of two classes. A word's weight in it is
exp of the mean of its subwords' pulls, a further number in each row of the table, so a few words that
matter are not lost among thousands that don't. Table, pulls and softmax start from nothing but small
random numbers and are trained together in numpy; a misspelled or inflected word that training never
saw shares most n-grams with one that it did see.

Training sees a bounded sample of labelled rows (see common.labelled_sample). Scoring needs of each subword its vector's product with the softmax, and its pull:
2 * 2 ** bits floats, sent to the executors (a fixed size, 1 MB by default).

Null and empty texts, and texts without letters or digits, get the score of an empty bag. Repeated
rows get equal scores, one for each row. Texts are scored in blocks of about half a million bytes, so memory
doesn't follow the longest one; a word of more than a million bytes counts as several. Of empty tables
nothing is learned, and no text is toxic. Other columns pass through; one that has the score's name gives
way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, field, labelled_sample, learned, map_columns, text_blocks, with_scores


def word_codes(block: bytes) -> np.ndarray:
    """Code points of the lower-cased block; what is no letter or digit in ASCII is one space, at both ends too."""
    codes = np.frombuffer(f" {block.decode().lower()} ".encode("utf-32-le", "replace"), "<u4")
    low = codes < 128
    codes = np.where(low & ~_WORD_CODE[np.minimum(codes, 127)], np.uint32(32), codes)
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


_WORD_CODE = np.array([chr(c).isalnum() for c in range(128)])


def subword_rows(codes: np.ndarray, bits: int, shortest: int = 3, longest: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: the table row of the one at each place, and whether it lies in one word."""
    spaces = np.cumsum(codes == 32, dtype=np.int32)
    out, h = [], codes * np.uint32(1)
    for n in range(2, longest + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(16777619) + codes[n - 1 :]
        if n >= shortest:
            inside = spaces[n - 2 : len(codes) - 1] == spaces[: len(codes) - n + 1]
            out.append(((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(32 - bits), inside))
    return out


def word_means(codes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """For each word, the means of its subwords' rows of the table(2, 2 ** bits)."""
    word = np.cumsum(codes == 32, dtype=np.int32) - 1
    n = int(word[-1])
    total, count = np.zeros((len(table), len(codes)), "float32"), np.zeros(len(codes), "float32")
    for rows, inside in subword_rows(codes, bits):
        for k, values in enumerate(table):
            total[k, : len(rows)] += values[rows] * inside
        count[: len(rows)] += inside
    many = np.maximum(np.bincount(word, count, n + 1)[:n], 1)
    return np.stack([np.bincount(word, t, n + 1)[:n] / many for t in total])


@dataclass
class Model:
    """A text's score is sigmoid(average of its words' logits, weighted by exp of their pulls, + bias); table: logits and pulls of subwords."""

    table: np.ndarray
    bias: float
    bits: int

    def score(self, text: bytes) -> float:
        top = weight = 0.0
        for block in text_blocks(text):
            codes = word_codes(block)
            if len(codes) > 1:
                logits, pulls = word_means(codes, self.table, self.bits)
                each = np.exp(np.clip(pulls, -_MOST, _MOST))
                top, weight = top + float(each @ logits), weight + float(each.sum())
        return sigmoid((top / weight if weight else 0.0) + self.bias)


_MOST = 20.0  # of a pull


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def subwords_of(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, table row) of all subwords of these words, in no order; a row that a word has twice is there twice."""
    numbers, rows, at = [], [], 0
    while at < len(words):
        part = words[at : at + 20_000]
        codes = word_codes(" ".join(part).encode())
        word = np.cumsum(codes == 32) - 1 + at
        for found, inside in subword_rows(codes, bits):
            numbers.append(word[: len(found)][inside].astype("int32"))
            rows.append(found[inside].astype("int32"))
        at += len(part)
    return tuple(np.concatenate(x) if x else np.zeros(0, "int32") for x in (numbers, rows))


def carried(to: np.ndarray, share: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of share * values[of] by to, of n numbers; some entries at a time, to hold few of them twice."""
    total = np.zeros(n)
    for at in range(0, len(to), 1 << 18):
        part = slice(at, at + (1 << 18))
        total += np.bincount(to[part], share[part] * values[of[part]], n)
    return total


def train(texts: np.ndarray, words: np.ndarray, counts: np.ndarray, spelled: list[str], toxic: np.ndarray, bits: int,
          dim: int = 8, steps: int = 60, rate: float = 0.1, least: int = 3, clean: float = 8.0, seed: int = 7) -> Model:
    """Adam on the cross entropy of all texts; all clean ones together weigh `clean` times all toxic ones, so doubt counts for a text.

    Entry k says that text texts[k] (in order) holds word words[k], spelled[words[k]], counts[k] times. Subwords of
    fewer than `least` (text, word) entries stay as they start.
    """
    n_texts, n_words = len(toxic), len(spelled)
    number, row = subwords_of(spelled, bits)
    many = np.maximum(np.bincount(number, minlength=n_words), 1)
    frequent = np.bincount(row, np.bincount(words, minlength=n_words)[number], 1 << bits) >= least
    kept = frequent[row]
    used, row, number = np.flatnonzero(np.bincount(row[kept], minlength=1 << bits)), row[kept], number[kept]
    place = np.zeros(1 << bits, "int32")
    place[used] = np.arange(len(used), dtype="int32")
    row = place[row]
    share = (1 / many)[number].astype("float32")
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.01, (len(used), dim)), np.zeros(len(used)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(toxic == 1, 1 / max(1, (toxic == 1).sum()), clean / max(1, (toxic == 0).sum())) / (1 + clean)
    for step in range(1, steps + 1):
        table, pull, soft, bias = params
        apart = soft[:, 1] - soft[:, 0]
        logits = carried(number, share, (table @ apart), row, n_words)
        each = counts * np.exp(np.clip(carried(number, share, pull, row, n_words), -_MOST, _MOST))[words]
        each /= np.maximum(np.bincount(texts, each, n_texts), 1e-300)[texts]
        mean = np.bincount(texts, each * logits[words], n_texts)
        p = 1 / (1 + np.exp(-np.clip(mean + bias[1] - bias[0], -60, 60)))
        g = (p - toxic) * weight
        of_entry = g[texts] * each
        of_row = carried(row, share, np.bincount(words, of_entry, n_words), number, len(used))
        of_pull = carried(row, share, np.bincount(words, of_entry * (logits[words] - mean[texts]), n_words), number, len(used))
        of_soft = table.T @ of_row
        grads = [np.outer(of_row, apart), of_pull, np.stack([-of_soft, of_soft], 1), np.array([-g.sum(), g.sum()])]
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + (1e-5 if k < 2 else 1e-6))
    table, pull, soft, bias = params
    out = np.zeros((2, 1 << bits), "float32")
    out[0, used], out[1, used] = table @ (soft[:, 1] - soft[:, 0]), pull
    return Model(out, float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 750, most_bytes: int = 4 << 20, bits: int = 17) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, label): of each class at most `most` labelled rows and most_bytes of text.

    One task gets the sample's distinct words and how often each text has them, and trains; the driver gets the model.
    Without rows of both classes no text is called toxic.
    """
    sample = labelled_sample(docs, labels.filter(F.col(f"`{label}`").isin(0, 1)), label, most, most_bytes)

    def bags(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [word_counts(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"], "label": batch["label"], "words": [list(f) for f in found], "counts": [list(f.values()) for f in found]}

    fields = [field("doc_id", "long"), field("label", "int"), field("words", ["string"]), field("counts", ["int"])]
    def train_on(rows: pa.Table) -> Model:
        rows = rows.sort_by("doc_id")
        toxic = rows["label"].to_numpy().astype("int64")
        if len(set(toxic.tolist())) < 2:
            return Model(np.zeros((2, 1 << bits), "float32"), -2.0, bits)
        words = rows["words"].combine_chunks()
        texts = np.repeat(np.arange(len(toxic), dtype="int32"), words.value_lengths().to_numpy())
        coded = words.flatten().dictionary_encode()
        counts, of_words = rows["counts"].combine_chunks().flatten().to_numpy().astype("float32"), coded.indices.to_numpy()
        spelled = coded.dictionary.to_pylist()
        del rows, words, coded
        return train(texts, of_words, counts, spelled, toxic, bits)

    model = learned(map_columns(sample, {c: F.col(c) for c in ("doc_id", "label", "text")}, fields, bags), train_on)
    drop_written(sample)
    return model


def word_counts(text: bytes) -> dict[str, int]:
    """How often a text holds each of its words."""
    found: dict[str, int] = {}
    for block in text_blocks(text):
        for word in word_codes(block).tobytes().decode("utf-32-le").split(" "):
            if word:
                found[word] = found.get(word, 0) + 1
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text)."""
    return scored(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), "score")


def scored(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """docs with a column of model.score(text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, lambda text: sent.value.score(text), [name])
