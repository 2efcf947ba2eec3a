"""Operator 7, media columns stored as content-defined chunks.

A text's bytes, padded to a multiple of 192, are the 8-bit samples of a mono
WAV. A rolling gear hash cuts the samples into chunks; joins on the chunk
digest keep one copy of each chunk (its owner is the media and place that come
first by key), compressed by zstandard with a dictionary learned from a
bounded sample. Media that are equal throughout share an ordered chunk list;
each list is joined with the chunks, rebuilt in order, verified chunk by chunk
and as a whole, and gives its features once.

Nulls: a null text is the empty one (192 blanks). Null and repeated doc_ids
keep their rows; only digests decide what is stored. A text is chunked whole by
one task, with some ten bytes of work space a byte. An empty table gives an empty
result; other columns are not read and may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import bounded_batches, mix, parts, sorted_groups, text_buffer

PAD = 192
RATE = 8000
#: Chunk sizes: least, average (a power of two) and most.
LEAST, AVERAGE, MOST = 2048, 8192, 65_536
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
#: Bounds of the sample that the dictionary is learned from, and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY = 512, 4000, 110_000


def digest_of(data: bytes) -> bytes:
    """128 bits that name a chunk or a media."""
    return hashlib.blake2b(data, digest_size=16).digest()


def wav(samples: bytes) -> bytes:
    """A mono WAV of 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of such a WAV."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
    return media[at + 8 : at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte (of the last 32 bytes), by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one payload."""
    n = len(data)
    found = np.flatnonzero(gear(data) >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1 if n > LEAST else ()
    out, last = [], 0
    for c in [*(found.tolist() if len(found) else ()), n]:
        while c - last > MOST:
            out.append(last := last + MOST)
        if c - last >= LEAST or c == n:
            out.append(last := c)
    return out


@functools.lru_cache(maxsize=2)
def packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=9, dict_data=d, write_checksum=False, write_dict_id=False)


@functools.lru_cache(maxsize=2)
def unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def learn_dictionary(docs: DataFrame) -> bytes:
    """A dictionary from the beginnings of about SAMPLE_DOCS texts, picked by a hash of their id; none if there are too few."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    picked = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(every)) == 0) & (F.length("text") > 0))
    rows = picked.select(F.xxhash64("doc_id", F.lit(11)).alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t")).orderBy("h", "t").limit(SAMPLE_DOCS).collect()
    sample = [r.t[i : i + 800].encode() for r in rows for i in range(0, len(r.t), 800)]
    if len(sample) < 200:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:  # texts too short or too alike to learn from
        return b""


def payloads(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Row, unpadded size and payload of each text."""
    data, offs = text_buffer(batch.column(1))
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        yield i, b - a, raw[a:b] + b" " * (-(b - a) % PAD or (PAD if a == b else 0))


def chunked(docs: DataFrame, dictionary: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """media (doc_id, key, n_bytes), lists (key, seq, digest, n_chunks, n_bytes) and chunks (digest, packed), the latter once each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def media(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size = [], []
            for _, n, p in payloads(b):
                key.append(digest_of(p + n.to_bytes(8, "big")))
                size.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(size, pa.int64())], ["doc_id", "key", "n_bytes"])

    def chunk_rows(with_bytes: bool):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: set[bytes] = set()
                out: list[tuple] = []
                first: dict[bytes, tuple] = {}  # of each chunk of the batch, the place that comes first by key
                for _, n, p in payloads(b):
                    key, last = digest_of(p + n.to_bytes(8, "big")), 0
                    if key in seen:  # equal media have equal lists
                        continue
                    seen.add(key)
                    ends = cuts(np.frombuffer(p, np.uint8))
                    for seq, end in enumerate(ends):
                        digest = digest_of(p[last:end])
                        if not with_bytes:
                            out.append((key, seq, digest, len(ends), n))
                        elif digest not in first or (key, seq) < first[digest][:2]:
                            first[digest] = (key, seq, digest, p[last:end])
                        last = end
                out += [(k, s, d, packer(dictionary).compress(x)) for k, s, d, x in first.values()]
                types = [pa.binary(), pa.int32(), pa.binary(), *([pa.binary()] if with_bytes else [pa.int32(), pa.int64()])]
                names = ["key", "seq", "digest", *(["packed"] if with_bytes else ["n_chunks", "n_bytes"])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(types), types)], names)

        return work

    lists = rows.mapInArrow(chunk_rows(False), "key binary, seq int, digest binary, n_chunks int, n_bytes long").distinct()
    held = rows.mapInArrow(chunk_rows(True), "key binary, seq int, digest binary, packed binary")
    owners = lists.groupBy("digest").agg(F.min(F.struct("key", "seq")).alias("at")).select("digest", F.col("at.key").alias("own_key"), F.col("at.seq").alias("own_seq"))
    # The owner's place is compared without equalities, so that rows are dealt by digest alone: the
    # aggregation and the join with the lists then need no further exchange of bytes. Batches that
    # hold the owner's media alike offer the same bytes; one of them is enough.
    here = (F.col("key") >= F.col("own_key")) & (F.col("key") <= F.col("own_key")) & (F.col("seq") >= F.col("own_seq")) & (F.col("seq") <= F.col("own_seq"))
    chunks = held.join(owners, "digest").where(here).groupBy("digest").agg(F.first("packed").alias("packed"))
    return rows.mapInArrow(media, "doc_id long, key binary, n_bytes long"), lists, chunks


def rebuilt(lists: DataFrame, chunks: DataFrame, dictionary: bytes) -> DataFrame:
    """key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each chunk list, read back from its chunks.

    A list with a gap, a chunk that is missing or altered, or a whole that its key does not name raises an error.
    """
    found = lists.join(chunks, "digest", "left").select("key", "seq", "digest", "packed", "n_chunks", "n_bytes")
    # Media of one chunk are whole where they are; only longer ones are gathered from their chunks' places.
    longer = found.where("n_chunks > 1").repartition(parts(lists.sparkSession), "key").sortWithinPartitions("key", "seq")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for t, at in sorted_groups(batches, ["key"]):
            key, seq, digest, packed, count, size = (t.column(c).to_pylist() for c in ("key", "seq", "digest", "packed", "n_chunks", "n_bytes"))
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if seq[a:b] != list(range(count[a])) or None in packed[a:b]:
                    raise ValueError("a chunk of a media is missing")
                got = [unpacker(dictionary).decompress(p) for p in packed[a:b]]
                if any(digest_of(x) != d for x, d in zip(got, digest[a:b], strict=True)):
                    raise ValueError("a chunk read back differs from its digest")
                stored = wav(b"".join(got))
                payload = samples_of(stored)
                if digest_of(payload + size[a].to_bytes(8, "big")) != key[a]:
                    raise ValueError("a media read back differs from its key")
                out.append((key[a], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    kind = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return found.where("n_chunks = 1").mapInArrow(work, kind).unionByName(longer.mapInArrow(work, kind))


def feature(x: np.ndarray) -> str:
    """Mean, root mean square about 128 and zero crossings of the samples, and their chunks."""
    y = x.astype(np.int32) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt((y * y).mean()):.4f};crossings={int(((y[1:] < 0) != (y[:-1] < 0)).sum())};chunks={len(cuts(x))}"


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionary = learn_dictionary(docs)
    media, lists, chunks = chunked(docs, dictionary)
    read = media.join(rebuilt(lists, chunks, dictionary), "key", "left")
    whole = F.when(F.col("payload_sha256").isNull(), F.raise_error(F.lit("the chunk list of a media is missing"))).otherwise(F.col("payload_bytes"))
    return read.select("doc_id", "n_bytes", whole.cast("long").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
