import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.llm import media


def test_texts_come_back(spark, tmp_path):
    r = random.Random(1)
    shared = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    texts = [None, "", "a", "é" * 96, "x" * 192, shared, "new start " + shared, shared[:40_000] + "other end", shared, "z" * 400_000]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, "")]
    spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, seq int").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        w = media.wav(p)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest(), media.feature(np.frombuffer(p, np.uint8))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chunks_are_shared_and_stored_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = media.learn_dictionary(docs)
    m, lists, chunks = media.chunked(docs, d)
    assert m.count() == docs.count()
    assert chunks.count() == chunks.select("digest").distinct().count() == lists.select("digest").distinct().count()
    assert lists.select("key").distinct().count() == docs.select("text").distinct().count()


def test_cuts_follow_content():
    x = np.frombuffer(random.Random(2).randbytes(300_000), np.uint8)
    a, b = media.cuts(x), media.cuts(np.concatenate([np.zeros(777, np.uint8), x]))
    assert len({x[i:j].tobytes() for i, j in zip([0, *a], a)} & {np.concatenate([np.zeros(777, np.uint8), x])[i:j].tobytes() for i, j in zip([0, *b], b)}) > len(a) - 4
    assert a[-1] == len(x) and all(media.LEAST <= j - i <= media.MOST for i, j in zip([0, *a], a[:-1]))
    h = media.gear(x[:64])
    assert h[40] == sum(int(media.GEAR[x[40 - i]]) << i for i in range(32)) % 2**32


def test_wav_is_readable():
    with wave.open(io.BytesIO(media.wav(b"abcd"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes(), w.readframes(9)) == (1, 1, 4, b"abcd")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert media.op7(spark, str(tmp_path)).collect() == []


def test_lost_and_altered_chunks_raise(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text[:90_000])], "doc_id long, text string")
    _, lists, chunks = media.chunked(docs, b"")
    lists, chunks = spark.createDataFrame(lists.collect(), lists.schema), spark.createDataFrame(chunks.collect(), chunks.schema)
    assert media.rebuilt(lists, chunks, b"").count() == 3
    some = [x.digest for x in lists.where("n_chunks > 2").orderBy("key", "seq").collect()]
    one = lists.where("n_chunks = 1").first()
    other = chunks.where(F.col("digest") == some[3]).first().packed
    broken = [
        (lists, chunks.where(F.col("digest") != some[2])),
        (lists, chunks.where(F.col("digest") != one.digest)),
        (lists.where(F.col("digest") != some[2]), chunks),
        (lists, chunks.withColumn("packed", F.when(F.col("digest") == some[2], F.lit(other)).otherwise(F.col("packed")))),
        (lists.withColumn("seq", F.when(F.col("n_chunks") > 2, F.col("n_chunks") - 1 - F.col("seq")).otherwise(F.col("seq"))), chunks),
        (lists.withColumn("n_bytes", F.col("n_bytes") + 1), chunks),
    ]
    for a, b in broken:
        with pytest.raises(Exception, match="missing|differs"):
            media.rebuilt(a, b, b"").collect()


def test_payloads_by_the_standard_library(spark):
    """The stored form of every text of a table, written by the wave module instead."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op7(spark, sf).collect():
        raw = texts[r.doc_id]
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media.RATE)
            w.writeframes(p)
        signed = [x - 128 for x in p]
        f = dict(x.split("=") for x in r.feature.split(";"))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert float(f["mean"]) == pytest.approx(sum(p) / len(p), abs=1e-3) and int(f["crossings"]) == sum((x < 0) != (y < 0) for x, y in zip(signed, signed[1:]))
