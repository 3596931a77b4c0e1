"""Texts as stored media: content-defined chunks, each kept once, and verified reconstruction.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are its payload, kept
losslessly as the samples of an 8-bit mono WAV file. A rolling gear hash cuts the payload where its
content says so, so equal passages of different payloads give equal chunks. ``manifests`` makes an
ordered list of chunk digests for each text, ``chunk_store`` holds each digest's bytes once, and
``reconstruct`` joins the lists with the store, puts the media together, checks every chunk and
the whole against the digests, and computes features of the samples read back.

Equal texts share one medium, so copies are moved and rebuilt once however many there are. A medium
is rebuilt chunk by chunk in order; it is never held whole. Null and empty texts are 64 zero bytes and so one
medium; repeated rows are documents of their own. A text of gigabytes would need a 64-bit header: over 4 GB is an
error. An empty table gives an empty one. Columns besides doc_id and text are neither read nor returned. The last
join brings a medium's values to its documents; where one medium has many, Spark splits them among tasks (adaptive
skew joins).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, field, map_columns, released, to_arrow, written

LEAST, MEAN_BITS, MOST = 2048, 13, 32768  # chunk bytes: least, mean as a power of two beyond it, most
BLOCK, WINDOW, UNIT, RATE = 1 << 20, 32, 64, 8000
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
_CUT = np.uint32(((1 << MEAN_BITS) - 1) << (32 - MEAN_BITS))


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def wav_header(size: int) -> bytes:
    """The header of an 8-bit mono WAV file with so many samples."""
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size)


def cut_places(data: bytes) -> Iterator[np.ndarray]:
    """Ends of the windows at which the gear hash would cut, a block at a time."""
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data, "uint8", min(len(data), at + BLOCK) - begin, begin)]
        step = 1
        while step < WINDOW:  # twice the window each time: (hash << 1) + gear[byte] of its last bytes
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step) if len(h) > step else h[:0]
            h, step = longer, 2 * step
        yield np.flatnonzero((h[at - begin :] & _CUT) == 0) + at + 1


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end: the first cut place beyond LEAST bytes, or MOST bytes."""
    if len(data) <= LEAST:
        return [len(data)]
    places = np.concatenate(list(cut_places(data)))
    ends, at = [], 0
    while len(data) - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = min(int(places[k]) if k < len(places) else len(data), at + MOST, len(data))
        ends.append(end)
        at = end
    if at < len(data):
        ends.append(len(data))
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    ends = chunk_ends(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media_id, chunks) of docs(doc_id, text); media_id is the medium's SHA-256, chunks the ordered digests."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_bytes": [len(t) for t in batch["text"]], "payload_bytes": [], "media_id": [], "chunks": []}
            for text in batch["text"]:
                payload = payload_of(text)
                out["payload_bytes"].append(len(payload))
                out["media_id"].append(hashlib.sha256(wav_header(len(payload)) + payload).digest())
                out["chunks"].append([hashlib.sha256(c).digest() for c in chunks_of(payload)])
            yield out

    fields = [field("doc_id", "long"), field("n_bytes", "long"), field("payload_bytes", "long"), field("media_id", "binary"), field("chunks", ["binary"])]
    return map_columns(docs, _inputs(), fields, run)


def chunk_store(docs: DataFrame, level: int = 6) -> DataFrame:
    """(digest, data): each distinct chunk once, compressed before it is moved."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False).compress
        for batch in batches:
            digests, data = [], []
            for text in batch["text"]:
                found = chunks_of(payload_of(text))
                digests += [hashlib.sha256(c).digest() for c in found]
                data += map(pack, found)
            yield {"digest": digests, "data": data}

    return map_columns(docs, {"text": _inputs()["text"]}, [field("digest", "binary"), field("data", "binary")], run).dropDuplicates(["digest"])


def _inputs() -> dict:
    return {"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}


class Features:
    """Running features of 8-bit samples in exact integers: number, mean, root mean square, crossings of the middle."""

    def __init__(self):
        self.n = self.sum = self.squares = self.crossings = 0
        self.last: int | None = None

    def add(self, data: bytes) -> None:
        x = np.frombuffer(data, "uint8").astype("int64") - 128
        self.n += len(x)
        self.sum += int(x.sum())
        self.squares += int((x * x).sum())
        high = x >= 0
        self.crossings += int((high[1:] != high[:-1]).sum()) + int(self.last is not None and bool(high[0]) != bool(self.last))
        self.last = bool(high[-1])

    def text(self) -> str:
        return f"samples={self.n} mean={self.sum / self.n:.6f} rms={(self.squares / self.n) ** 0.5:.6f} crossings={self.crossings}"


MEDIA = [field("media_id", "binary"), field("payload_bytes", "long"), field("payload_sha256", "string"), field("tail_crc32", "long"), field("media_bytes", "long"), field("media_sha256", "string"), field("feature", "string")]


CHUNKS = [field("media_id", "binary"), field("payload_bytes", "long"), field("n_chunks", "long"), field("seq", "long"), field("digest", "binary"), field("data", "binary")]
#: Bits of a place in the bitmap of shared digests: some 16 places for each, within 4 kB to 32 MB.
FILTER_BITS = (15, 28)


@dataclass
class Bitmap:
    """Places of digests: the first `bits` bits of a digest are its place in the words of 32 bits."""

    words: np.ndarray
    bits: int

    def any(self, digests: list[bytes]) -> bool:
        return any(int(self.words[(p := int.from_bytes(d[:4], "big") >> (32 - self.bits)) >> 5]) >> (p & 31) & 1 for d in digests)


def shared_filter(lists: DataFrame) -> Bitmap:
    """A bitmap with the places of all digests that different media share, sized by their number up to a bound.

    Digests are uniform, so their first bits are their place. More digests than the largest bitmap is made for only
    make it call more chunks shared, which moves more bytes and changes no result.
    """
    media = lists.select("media_id", "chunks").dropDuplicates(["media_id"])
    each = media.select("media_id", F.explode(F.array_distinct("chunks")).alias("digest"))
    shared = each.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    first = written(shared.select(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").alias("first")), "shared")
    bits = min(max((16 * first.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    words = first.select(F.shiftright("first", 32 - bits).alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    found = words.toArrow()
    drop_written(first)
    out = np.zeros(1 << (bits - 5), "uint32")
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype("uint32")
    return Bitmap(out, bits)


def chunk_rows(docs: DataFrame, bitmap, shared: bool, level: int = 6) -> DataFrame:
    """The rows CHUNKS of the media that the bitmap says share chunks with others, or of those that share none; a task emits a medium once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False).compress
        seen: dict[bytes, None] = {}
        for batch in batches:
            out = {f.name: [] for f in CHUNKS}
            for text in batch["text"]:
                payload = payload_of(text)
                media_id = hashlib.sha256(wav_header(len(payload)) + payload).digest()
                if media_id in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen[media_id] = None
                found = chunks_of(payload)
                digests = [hashlib.sha256(c).digest() for c in found]
                if bitmap.value.any(digests) != shared:
                    continue
                n = len(found)
                out["media_id"] += [media_id] * n
                out["payload_bytes"] += [len(payload)] * n
                out["n_chunks"] += [n] * n
                out["seq"] += range(n)
                out["digest"] += digests
                out["data"] += map(pack, found)
            yield out

    return map_columns(docs, {"text": _inputs()["text"]}, CHUNKS, run)


def listed_chunks(lists: DataFrame, store: DataFrame) -> DataFrame:
    """The rows CHUNKS of lists(media_id, payload_bytes, chunks), their data from store(digest, data)."""
    places = lists.select("media_id", "payload_bytes", F.size("chunks").cast("long").alias("n_chunks"), F.posexplode("chunks").alias("seq", "digest"))
    return places.join(store, "digest").select("media_id", "payload_bytes", "n_chunks", F.col("seq").cast("long").alias("seq"), "digest", "data")


def reconstruct(rows: DataFrame) -> DataFrame:
    """The rows MEDIA of media put together from the rows CHUNKS, which may repeat; raises if a chunk is missing or a digest differs."""
    dealt = rows.repartition("media_id").sortWithinPartitions("media_id", "seq")
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in MEDIA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now = state = None
        for batch in batches:
            done = []
            for media_id, size, n_chunks, seq, digest, data in zip(*[c.to_pylist() for c in batch.columns]):
                if media_id != now:
                    if state:
                        done.append(finished(now, state))
                    now, state = media_id, {"payload": hashlib.sha256(), "media": hashlib.sha256(wav_header(size)), "tail": b"", "features": Features(), "seen": 0, "n": n_chunks, "size": size}
                if seq == state["seen"] - 1:
                    continue  # the same chunk from another task
                chunk = unpack(data)
                if seq != state["seen"] or hashlib.sha256(chunk).digest() != digest:
                    raise ValueError("a chunk is missing or differs from its digest")
                state["seen"] += 1
                state["payload"].update(chunk)
                state["media"].update(chunk)
                state["tail"] = (state["tail"] + chunk)[-UNIT:]
                state["features"].add(chunk)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state:
            yield pa.RecordBatch.from_pylist([finished(now, state)], schema=arrow)

    def finished(media_id: bytes, s: dict) -> dict:
        if s["seen"] != s["n"] or s["features"].n != s["size"] or s["media"].digest() != media_id:
            raise ValueError("a rebuilt medium differs from its digest")
        return {"media_id": media_id, "payload_bytes": s["size"], "payload_sha256": s["payload"].hexdigest(), "tail_crc32": zlib.crc32(s["tail"]),
                "media_bytes": s["size"] + len(wav_header(0)), "media_sha256": s["media"].hexdigest(), "feature": s["features"].text()}

    return dealt.mapInArrow(run, T.StructType(MEDIA))


def media_columns(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): sizes, digests and features of its medium as read back from the stored chunks.

    Chunks that different media share are stored once and joined to the lists of those media; media
    that share none go straight to where they are put together, so most bytes move once.
    """
    kept = written(manifests(docs), "manifests")
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_filter(kept))

    def flagged(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            at = [k for k, chunks in enumerate(batch["chunks"]) if bitmap.value.any(chunks)]
            yield {n: [batch[n][k] for k in at] for n in batch}

    lists = kept.select("media_id", "payload_bytes", "chunks").dropDuplicates(["media_id"])
    lists = map_columns(lists, {n: F.col(n) for n in lists.columns}, [field("media_id", "binary"), field("payload_bytes", "long"), field("chunks", ["binary"])], flagged)
    store = chunk_rows(docs, bitmap, True).select("digest", "data").dropDuplicates(["digest"])
    rebuilt = reconstruct(listed_chunks(lists, store).unionByName(chunk_rows(docs, bitmap, False)))
    return kept.select("doc_id", "n_bytes", "media_id").join(rebuilt, "media_id").drop("media_id")
