"""Exact BM25 top-k: an inverted index in shards, block-max WAND in each, one exact merge.

``build_index`` cuts the documents as they lie into shards of a bounded number of words and writes a
row a shard: its terms (64-bit hashes, sorted), where each one's postings start, the postings
(documents in order of their ids, and term counts) and the documents' ids and lengths. Every row of
the table is indexed. ``search`` first sums the statistics that scores need over all shards (rows,
words, document frequencies of the query terms), so a score is the same in every shard. Each shard
then finds its own top k: postings are bounded in blocks, and a document is scored only if the
bounds of the blocks it lies in can pass the k-th best so far. The shards' winners are merged by
score, then id.

Queries go to the executors a block at a time, so what is broadcast has a bound; each block's hits are
written. Null and empty
texts are rows without words: they count in the averages, are never found, and find nothing as
queries. Equal scores are ordered by id, null ids last; repeated rows are found one by one.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import field, map_columns, shared_folder, written
from .near_dup import word_hashes

K1, B = 1.2, 0.75
POSTINGS = 64  # in a block
_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> np.ndarray:
    """The hash of each word (letters and digits, in lower case), in order."""
    return word_hashes(text.decode().lower().encode().translate(_SPACE))


def shard_row(ids: list, texts: list[np.ndarray]) -> dict:
    """The index of one shard."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(texts[i]) for i in order], "<u4")
    words = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, "uint64")
    terms, place = np.unique(words, return_inverse=True)
    docs = np.repeat(np.arange(len(order), dtype="int64"), lengths)
    pairs, counts = np.unique(place * max(1, len(order)) + docs, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(order)))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    return {
        "n_docs": len(order), "n_words": len(words), "terms": terms.astype("<u8").tobytes(), "starts": starts.astype("<u4").tobytes(), "docs": doc.astype("<u4").tobytes(),
        "counts": counts.astype("<u4").tobytes(), "lengths": lengths.tobytes(), "ids": [ids[i] for i in order],
    }


INDEX = [field("n_docs", "long"), field("n_words", "long"), field("terms", "binary"), field("starts", "binary"), field("docs", "binary"), field("counts", "binary"), field("lengths", "binary"), field("ids", ["long"])]


def build_index(docs: DataFrame, shard_words: int = 2_000_000) -> DataFrame:
    """The written index of docs(doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id)
                texts.append(terms_of(text))
                size += len(texts[-1])
                if size >= shard_words:
                    yield {k: [v] for k, v in shard_row(ids, texts).items()}
                    ids, texts, size = [], [], 0
        if ids:
            yield {k: [v] for k, v in shard_row(ids, texts).items()}

    inputs = {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}
    return written(map_columns(docs, inputs, INDEX, run), "index")


class Postings:
    """One term's postings in a shard, with the scores that they add and their bounds."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores = docs.tolist(), scores.tolist()
        cuts = np.arange(0, len(docs), POSTINGS)
        self.block_most = (np.maximum.reduceat(scores, cuts) * (1 + 1e-9)).tolist()
        self.block_last = docs[np.minimum(cuts + POSTINGS, len(docs)) - 1].tolist()
        self.most = max(self.block_most)
        self.at, self.block, self.doc = 0, 0, self.docs[0]

    def forward(self, doc: int) -> None:
        """To the first posting of doc or a later document."""
        self.at = bisect_left(self.docs, doc, self.at)
        self.doc = self.docs[self.at] if self.at < len(self.docs) else END

    def bound(self, doc: int) -> tuple[float, int]:
        """The bound of the block that doc lies in, and that block's last document."""
        self.block = bisect_left(self.block_last, doc, self.block)
        return (self.block_most[self.block], self.block_last[self.block]) if self.block < len(self.block_last) else (0.0, END)


END = 1 << 62


def block_max_wand(lists: list[Postings], k: int) -> list[tuple[float, int]]:
    """The k best (score, doc), best first; of equal scores the earlier document.

    Scores are summed in the order of lists, so they don't depend on what was skipped.
    """
    heap: list[tuple[float, int]] = []
    order = list(lists)
    while True:
        order.sort(key=lambda p: p.doc)
        least = heap[0][0] if len(heap) == k else 0.0
        total, pivot = 0.0, -1
        for i, p in enumerate(order):
            if p.doc == END:
                break
            total += p.most
            if total > least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = order[pivot].doc
        while pivot + 1 < len(order) and order[pivot + 1].doc == doc:
            pivot += 1
        bounds = [p.bound(doc) for p in order[: pivot + 1]]
        if sum(b for b, _ in bounds) > least:
            if order[0].doc == doc:
                score = 0.0
                for p in lists:
                    if p.doc == doc:
                        score += p.scores[p.at]
                if len(heap) < k:
                    heappush(heap, (score, -doc))
                elif score > heap[0][0]:
                    heapreplace(heap, (score, -doc))
                for p in order[: pivot + 1]:
                    p.forward(doc + 1)
            else:
                for p in order[: pivot + 1]:
                    if p.doc < doc:
                        p.forward(doc)
                        break
        else:
            # nothing passes before the first of these blocks ends or the next list joins in
            beyond = min(min(last for _, last in bounds) + 1, order[pivot + 1].doc if pivot + 1 < len(order) else END)
            beyond = max(beyond, doc + 1)
            for p in order[: pivot + 1]:
                if p.doc < beyond:
                    p.forward(beyond)
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def gains(counts: np.ndarray, lengths: np.ndarray, idf: float, mean_length: float) -> np.ndarray:
    """What a term adds to the scores of documents of these lengths."""
    counts = counts.astype("float64")
    return idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / mean_length))


def shard_search(row: dict, queries: list[tuple[object, list[int]]], idf: dict[int, float], mean_length: float, k: int) -> list[tuple]:
    """(query, doc_id, score) of the shard's top k for each query."""
    terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4")
    docs, counts, lengths = (np.frombuffer(row[c], "<u4") for c in ("docs", "counts", "lengths"))
    out = []
    for query, wanted in queries:
        lists = []
        for term, at in zip(wanted, np.searchsorted(terms, np.array(wanted, "uint64"))):
            if at < len(terms) and int(terms[at]) == term:
                own = slice(starts[at], starts[at + 1])
                lists.append(Postings(docs[own], gains(counts[own], lengths[docs[own]], idf[term], mean_length)))
        out += [(query, row["ids"][doc], score) for score, doc in block_max_wand(lists, k)] if lists else []
    return out


def shard_search_all(row: dict, queries: list[tuple[object, list[int]]], idf: dict[int, float], mean_length: float, k: int) -> list[tuple]:
    """What shard_search returns, by adding up every posting of the query's terms, in the same order.

    In a query of hundreds of terms the bounds skip next to nothing, and moving the lists costs more than adding them up.
    """
    terms, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype("int64")
    docs, counts, lengths = (np.frombuffer(row[c], "<u4") for c in ("docs", "counts", "lengths"))
    if not len(terms):
        return []
    known = np.array(sorted(idf), "uint64")
    at = np.searchsorted(terms, known)
    held = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == known)
    weight = np.zeros(len(terms))
    weight[at[held]] = [idf[int(t)] for t in known[held]]
    docs = docs.astype("int64")
    added = gains(counts, lengths[docs], np.repeat(weight, np.diff(starts)), mean_length)
    out = []
    for query, wanted in queries:
        wanted = np.array(wanted, "uint64")
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        at = at[terms[at] == wanted]
        if not len(at):
            continue
        sizes = starts[at + 1] - starts[at]
        own = np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        scores = np.bincount(docs[own], added[own], len(lengths))
        least = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        best = np.flatnonzero((scores >= least) & (scores > 0))
        best = best[np.argsort(-scores[best], kind="stable")][:k]
        out += [(query, row["ids"][doc], float(scores[doc])) for doc in best.tolist()]
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 10, block: int = 500, skip: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score) of queries(query_id, text): the k best rows for each, from rank 1.

    skip: pass over documents by the bounds of blocks; without it all postings are added up, with the same result.
    """
    in_shard = shard_search if skip else shard_search_all
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    n_docs, mean_length = totals["docs"] or 0, max(1.0, (totals["words"] or 0) / max(1, totals["docs"] or 0))
    inputs = {"query_id": F.col("query_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}

    def to_terms(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"query_id": batch["query_id"], "terms": [np.unique(terms_of(t)).view("int64").tolist() for t in batch["text"]]}

    asked = written(map_columns(queries, inputs, [field("query_id", "long"), field("terms", ["long"])], to_terms), "queries")
    blocks = -(-asked.count() // block)
    hits = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    fields = [field("query_id", "long"), field("doc_id", "long"), field("score", "double")]
    for n in range(max(1, blocks)):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == n).orderBy("query_id", "terms").collect()
        wanted = [(r["query_id"], [t % 2**64 for t in r["terms"]]) for r in part]
        idf = inverse_frequencies(index, sorted({t for _, ts in wanted for t in ts}), n_docs)
        sent = spark.sparkContext.broadcast((wanted, idf))

        def run(batches: Iterator[dict], sent=sent) -> Iterator[dict]:
            for batch in batches:
                rows = []
                for i in range(len(batch["ids"])):
                    rows += in_shard({c: batch[c][i] for c in batch}, *sent.value, mean_length, k)
                yield {"query_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]}

        found = map_columns(index, {c: F.col(c) for c in ("terms", "starts", "docs", "counts", "lengths", "ids")}, fields, run)
        if blocks > 1:  # a block's hits are written before the next one is sent, so neither plan nor driver grows with the blocks
            found.write.parquet(f"{hits}/block={n}")
            sent.unpersist()
    if blocks > 1:
        found = spark.read.schema(T.StructType(fields)).parquet(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def inverse_frequencies(index: DataFrame, terms: list[int], n_docs: int) -> dict[int, float]:
    """The idf of these terms over all shards. The postings themselves aren't read."""
    sent = index.sparkSession.sparkContext.broadcast(np.array(terms, "uint64"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            seen = np.zeros(len(sent.value), "int64")
            for terms_, starts in zip(batch["terms"], batch["starts"]):
                own, starts = np.frombuffer(terms_, "<u8"), np.frombuffer(starts, "<u4")
                at = np.minimum(np.searchsorted(own, sent.value), max(0, len(own) - 1))
                if len(own):
                    hit = own[at] == sent.value
                    seen[hit] += (starts[at + 1] - starts[at])[hit].astype("int64")
            used = np.flatnonzero(seen)
            yield {"term": sent.value[used].view("int64").tolist(), "n": seen[used].tolist()}

    counted = map_columns(index, {c: F.col(c) for c in ("terms", "starts")}, [field("term", "long"), field("n", "long")], run)
    found = {r["term"] % 2**64: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: float(np.log(1 + (n_docs - n + 0.5) / (n + 0.5))) for t in terms for n in [found.get(t, 0)]}
