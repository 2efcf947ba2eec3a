"""Operator 11, document fingerprints: bottom-k sketches of shingle hashes.

A document's fingerprint is the k smallest of the hashes of its word shingles,
each hash once. Sketches of parts merge into the sketch of their union (the k
smallest of both), and two sketches estimate resemblance, containment and the
number of distinct shingles. A set of fewer than k shingles is its own sketch,
so that its estimates are exact.

A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; fewer words than a shingle
has are one shingle; shingles across the boundary of two parts belong to neither.

Nulls: a null text is empty; an empty text has an empty sketch, which resembles
an empty one by 1 and any other by 0, and is contained in every one. Copies of a
text have one fingerprint. Repeated rows come out once each. Other columns are
not read and may have any name. An empty table gives an empty result. A text is
held whole by one task, with some eighty bytes of work space a byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import LOWER, bounded_batches, lean, mix, parts, ragged, sorted_groups, spans, text_buffer, word_hashes, word_spans

#: Hashes of a sketch, bits of a hash, words of a shingle.
K, BITS, WORDS = 256, 48, 5
#: Bytes of text hashed at a time.
PIECE = 512 << 10
#: Multiplier that joins the hashes of a shingle's words.
JOIN = np.uint64(0xA24BAED4963EE407)
#: Buckets of the ring of documents for each shuffle partition.
FINE = 2


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (BITS bits) of the word shingles of all texts, one after another, and their number per text."""
    starts, ends, first = word_spans(data, offs)
    count = np.diff(first)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not len(starts):
        return np.zeros(0, np.int64), shingles
    w = word_hashes(LOWER[data], starts, ends)
    head, width = ragged(first[:-1], shingles), np.repeat(np.minimum(count, words), shingles)
    h = w[head]
    for i in range(1, words):
        h = np.where(width > i, mix(h * JOIN + w[np.minimum(head + i, len(w) - 1)]), h)
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64), shingles


def smallest(h: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n owners its k smallest distinct hashes, ascending, one owner after another, and where each begins (n + 1)."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    first = np.searchsorted(owner, np.arange(n + 1))
    keep = np.arange(len(h)) - first[owner] < k
    return h[keep], np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), k))])


def sketches(data: np.ndarray, offs: np.ndarray, k: int = K, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all texts, one after another, and where each begins (n + 1)."""
    out, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for i, j in spans(np.diff(offs) + 1, PIECE):
        h, count = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
        s, at = smallest(h, np.repeat(np.arange(j - i), count), j - i, k)
        out.append(s)
        sizes.append(np.diff(at))
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))


def union(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two sets together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """How many shingles the sketched set holds."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity: the share of the union's sketch that both hold."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    size = min(k, len(both) - int(twice.sum()))
    # The size-th distinct value ends the union's sketch.
    last = both[np.flatnonzero(np.concatenate([[True], ~twice]))[size - 1]]
    return int((twice & (both[1:] <= last)).sum()) / size


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(union(a, b, k), k) / distinct(a, k))


def encoded(a: np.ndarray) -> str:
    """A sketch as text: eight base64 letters a hash, ascending."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decoded(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).ravel().view(">u8").astype(np.int64)


def list_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = K, words: int = WORDS) -> DataFrame:
    """key (as long), sketch array<long>: the fingerprint of every row's text."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(*sketches(*text_buffer(b.column(1)), k, words))], [key, "sketch"])

    return docs.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), f"`{key}` long, sketch array<long>")


def merged(parts_: DataFrame, key: str = "doc_id", k: int = K) -> DataFrame:
    """key, sketch: one sketch for each key, of the union of its parts; a null sketch is empty, null keys are one key.

    Each task merges what it holds of a key before the exchange, so a key has as many rows there as there are tasks at most.
    """
    kind = f"absent int, `{key}` long, sketch array<long>"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in sorted_groups(bounded(batches), ["absent", key]):
            lists = t.column("sketch").combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            n = len(start) - 1
            owner = np.repeat(np.arange(n), np.diff(start))
            s, at = smallest(lists.flatten().to_numpy(), np.repeat(owner, sizes), n, k)
            firsts = t.select(["absent", key]).take(pa.array(start[:-1])).combine_chunks()
            yield pa.RecordBatch.from_arrays([firsts.column(0).combine_chunks(), firsts.column(1).combine_chunks(), list_array(s, at)], ["absent", key, "sketch"])

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in which a key that goes on and on is one row."""
        for b in batches:
            if b.num_rows > 1:
                same = [b.column(i).to_numpy() for i in (0, 1)]
                if all(x[0] == x[-1] for x in same):
                    lists = b.column(2)
                    s, at = smallest(lists.flatten().to_numpy(), np.zeros(len(lists.flatten()), np.int64), 1, k)
                    b = pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1), list_array(s, at)], b.schema.names)
            yield b

    rows = parts_.select(F.col(key).isNull().cast("int").alias("absent"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias(key), F.col("sketch").cast("array<long>"))
    some = rows.sortWithinPartitions("absent", key).mapInArrow(lean(work), kind)
    out = some.repartition(parts(parts_.sparkSession), "absent", key).sortWithinPartitions("absent", key).mapInArrow(lean(work), kind)
    return out.select(F.when(F.col("absent") == 0, F.col(key)).alias(key), "sketch")


def marks(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, where code points begin (and the end), and the index of each text's first one (n + 1)."""
    data, offs = text_buffer(text)
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return data, offs, points, np.searchsorted(points, offs)


def spliced(text: pa.Array, rows: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_chars of the rows, and bytes and offsets of their edited texts: the last half becomes the beginning of the following text."""
    data, offs, points, first = marks(text)
    chars = np.diff(first)
    n = chars[rows]
    own = points[first[rows] + n - n // 2] - offs[rows]
    borrowed = points[first[following] + np.minimum(n // 2, chars[following])] - offs[following]
    begins, sizes = np.stack([offs[rows], offs[following]], 1).ravel(), np.stack([own, borrowed], 1).ravel()
    return n, data[ragged(begins, sizes)], np.concatenate([[0], np.cumsum(own + borrowed)])


def ring(docs: DataFrame) -> DataFrame:
    """bucket, ghost, doc_id, text, sorted: documents by descending doc_id, in buckets of which each ends with the row that follows it (ghost 1).

    Documents without an id come last, by the hash of their text; equal ids are
    ordered by text. The last bucket ends with the first document. A bucket's
    bounds are ids of documents, so the document that follows a bucket is known
    before any row moves and each row moves once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = docs.select(F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce("doc_id", F.xxhash64("text")).alias("place"), "doc_id", "text")
    n = parts(spark) * FINE
    keys = place.select("absent", "place")
    cuts = keys.groupBy("absent").agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [1.0], max(10_000, 4 * n)).alias("cuts")).collect()
    about = {r.absent: np.unique(np.array(r.cuts, np.int64)) for r in cuts}

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], int] = {}
        for b in batches:
            absent, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for kind, cut in about.items():
                mine = np.sort(at[absent == kind])
                bucket = np.searchsorted(cut, mine)
                for i in np.flatnonzero(np.diff(bucket, append=-1)).tolist():
                    key = (kind, int(bucket[i]))
                    best[key] = max(best.get(key, int(mine[i])), int(mine[i]))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in best], pa.int32()), pa.array([x[1] for x in best], pa.int32()), pa.array(list(best.values()), pa.int64())], ["absent", "bucket", "top"])

    # The largest id in each range: as many ids as buckets, whatever the number of documents.
    found = keys.mapInArrow(tops, "absent int, bucket int, top long").groupBy("absent", "bucket").agg(F.max("top").alias("top")).collect()
    known, unknown = (np.array(sorted(r.top for r in found if r.absent == x), np.int64) for x in (0, 1))
    total = len(known) + len(unknown)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absent, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            bucket = np.where(absent == 0, len(known) - 1 - np.searchsorted(known, at), total - 1 - np.searchsorted(unknown, at))
            heads = np.flatnonzero(np.where(absent == 0, np.isin(at, known), np.isin(at, unknown)))
            use = pa.array(np.concatenate([np.arange(len(at)), heads]))
            names = ["bucket", "ghost", *b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket, (bucket[heads] - 1) % max(total, 1)]).astype(np.int32)), pa.array(np.repeat([0, 1], [len(at), len(heads)]).astype(np.int32)), *(b.column(i).take(use) for i in range(4))], names)

    dealt = place.mapInArrow(lean(deal), "bucket int, ghost int, absent int, place long, doc_id long, text string")
    return dealt.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("place"), "text").select("bucket", "ghost", "doc_id", "text")


def edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketches of the text and of its edited form, and how alike they and the next document's are."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_of_edited double, n_shingles double"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            ghost = t.column("ghost").to_numpy()
            held = t.slice(len(ghost) - 1).to_batches()  # a batch's last row waits for what follows
            rows = np.flatnonzero(ghost[:-1] == 0)
            if not len(rows):
                continue
            text = t.column("text").combine_chunks()
            used = int(rows[-1]) + 2
            n, data, offs = spliced(text.slice(0, used), rows, rows + 1)
            s, at = sketches(*text_buffer(text.slice(0, used)), k, words)
            e, edge = sketches(data, offs, k, words)
            own = [s[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            new = [e[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            raw = memoryview(data)
            sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            names = [f.split()[0] for f in kind.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("doc_id").combine_chunks().take(pa.array(rows)), pa.array(n.astype(np.int64)), pa.array(sha, pa.string()),
                    pa.array([encoded(own[i]) for i in rows.tolist()], pa.string()), pa.array([encoded(x) for x in new], pa.string()),
                    pa.array([resemblance(own[i], x, k) for i, x in zip(rows.tolist(), new, strict=True)], pa.float64()), pa.array([resemblance(own[i], own[i + 1], k) for i in rows.tolist()], pa.float64()),
                    pa.array([containment(x, own[i], k) for i, x in zip(rows.tolist(), new, strict=True)], pa.float64()), pa.array([distinct(own[i], k) for i in rows.tolist()], pa.float64()),
                ],
                names,
            )

    return ring(docs).mapInArrow(lean(work), kind)


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract digest; beside it, the share of the edited text's shingles that the text holds, and the number of distinct shingles."""
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
