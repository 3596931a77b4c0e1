import hashlib
import io
import random
import wave
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import media


def test_media_round_trip(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choices("abcdef é\n", k=30000))
    texts = [None, "", "x" * 64, "é" * 33, passage, "intro " + passage, passage, "z" * 3_000_000, "".join(rnd.choices("gh ", k=2047))]
    df = spark.createDataFrame([(i if i != 8 else None, t, "c") for i, t in enumerate(texts)] + [(4, passage, "c")], "doc_id long, text string, chunks string")
    got = media.media_columns(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = (texts[8 if r.doc_id is None else r.doc_id] or "").encode()
        payload = text + bytes(64 if not text else -len(text) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(buffer.getvalue()), hashlib.sha256(buffer.getvalue()).hexdigest())
    assert {r.feature for r in got if r.doc_id in (4, 6)} == {next(r.feature for r in got if r.doc_id == 4)}
    assert media.media_columns(df.limit(0)).count() == 0
    chunks = sum(len(media.chunks_of(media.payload_of((t or "").encode()))) for t in texts)
    assert media.chunk_store(df).count() < chunks - 5


def test_wrong_chunk_is_noticed(spark):
    df = spark.createDataFrame([(1, "some text " * 900)], "doc_id long, text string")
    lists = media.manifests(df).select("media_id", (media.F.col("payload_bytes") + 64).alias("payload_bytes"), "chunks")
    with pytest.raises(Exception, match="differs from its digest|missing"):
        media.reconstruct(media.listed_chunks(lists, media.chunk_store(df))).collect()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 300), st.integers(0, 10**6))
def test_chunks_put_together(seed, times, salt):
    data = media.payload_of(b"".join(seed + str(salt * i).encode() for i in range(times)))
    found = media.chunks_of(data)
    assert b"".join(found) == data
    assert all(len(c) <= media.MOST for c in found) and all(len(c) >= media.LEAST for c in found[:-1])


def test_cuts_follow_content():
    rnd = random.Random(8)
    body = bytes(rnd.choices(range(256), k=200_000))
    a, b = media.chunks_of(body), media.chunks_of(b"shifted by some bytes" + body)
    assert len(set(a) & set(b)) >= len(a) - 3
    old, media.BLOCK = media.BLOCK, 5000
    try:
        assert media.chunks_of(body) == a
    finally:
        media.BLOCK = old
