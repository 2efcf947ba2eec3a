"""Operator 10, SimHash near-duplicates by bit-sliced comparison.

Texts become 64-bit fingerprints; distinct fingerprints meet in buckets that
agree on some of the 64 bits (any pair within the radius meets in one bucket
at least), and inside a bucket blocks of 64 fingerprints are stored as 64
vertical bit planes. Carry-save counters add the differing bits of one
fingerprint against a whole block; a block is abandoned once all its lanes
exceed the radius.

Nulls: a null text has no words and so fingerprint zero; a null doc_id keeps
its row but offers no component id (null if nothing else is reachable). Copies
of a text or a row share a fingerprint and are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import LOWER, SPACE, bounded_batches, components, lean, parts, ragged, sorted_groups, spans, text_buffer, word_spans, written

#: Fingerprints of one bucket that one task compares; larger buckets are dealt out as pairs of tiles.
TILE = 4096
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
#: For each byte, its 8 bits as 8 counters of 8 bits.
SPREAD = np.array([[x >> i & 1 for i in range(8)] for x in range(256)], dtype=np.uint8).view(np.uint64).ravel()


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the word shingles of all texts, one after another, and their number per text."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    # One space after each word: slices from a word's start to another's end are the joined shingles.
    inner = ~SPACE[data]
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    at = np.cumsum(keep) - 1
    joined = np.where(inner, LOWER[data], 32)[keep].astype(np.uint8).tobytes()
    starts, ends = at[starts], at[ends - 1] + 1
    count = np.diff(first)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    head = ragged(first[:-1], shingles)
    tail = head + np.repeat(np.minimum(count, words) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)), np.uint64, len(head)), shingles


def folded(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """SimHash (uint64) of each text from the hashes of its shingles; zero of none."""
    n = len(shingles)
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    # Counters of 8 bits hold 255 shingles: sum by segments, then by text.
    pieces = (shingles + 254) // 255
    bounds = ragged(np.zeros(n, np.int64), pieces) * 255 + np.repeat(np.cumsum(shingles) - shingles, pieces)
    sums = np.stack([np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)[:, k]], bounds).view(np.uint8).reshape(-1, 8) for k in range(8)], 1).reshape(-1, 64).astype(np.int64)
    some = np.flatnonzero(pieces)
    sums = np.add.reduceat(sums, (np.cumsum(pieces) - pieces)[some], axis=0)
    bits = (2 * sums > shingles[some, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray, words: int = 4) -> np.ndarray:
    """SimHash (uint64) of each text over its word shingles."""
    return folded(*shingle_hashes(data, offs, words))


def fingerprint_table(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(*text_buffer(b.column(1)), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), "doc_id long, fp long")


def close_pairs(fp: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within the radius, for sorted groups given by their starts and the end."""
    size = np.diff(start)
    for lo, hi in spans(size[size > 1], 1 << 16):
        some = np.flatnonzero(size > 1)[lo:hi]
        first, n = start[some], size[some]
        blocks = (n + 63) // 64
        block0 = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        row = ragged(first, n)
        slot = row - np.repeat(first, n)
        own = np.repeat(block0, n) + slot // 64
        lane = (slot % 64).astype(np.uint64)
        edge = np.flatnonzero(lane == 0)
        planes = np.stack([np.bitwise_or.reduceat((fp[row] >> np.uint64(i) & np.uint64(1)) << lane, edge) for i in range(64)])
        width = np.bitwise_or.reduceat(np.uint64(1) << lane, edge)
        last = np.repeat(block0 + blocks, n)
        for a, b in spans(last - own, 1 << 19):
            q = np.repeat(np.arange(a, b), (last - own)[a:b])
            block = ragged(own[a:b], (last - own)[a:b])
            later = np.where(block == own[q], ~((np.uint64(2) << lane[q]) - np.uint64(1)), ~np.uint64(0))
            alive = width[block] & later
            live = np.flatnonzero(alive)
            q, block, alive = q[live], block[live], alive[live]
            one = np.zeros(len(q), np.uint64)
            two, four, over = one.copy(), one.copy(), one.copy()
            mine = fp[row[q]]
            for i in range(64):
                x = planes[i][block] ^ (np.uint64(0) - (mine >> np.uint64(i) & np.uint64(1)))
                carry = one & x
                one ^= x
                x = two & carry
                two ^= carry
                over |= four & x
                four ^= x
                if i % 8 == 7:
                    alive &= ~beyond(one, two, four, over, radius)
                    live = np.flatnonzero(alive)
                    if len(live) < len(alive):
                        q, block, alive, mine, one, two, four, over = (v[live] for v in (q, block, alive, mine, one, two, four, over))
                    if not len(live):
                        break
            for i in range(64) if len(q) else ():
                hit = np.flatnonzero(alive >> np.uint64(i) & np.uint64(1))
                if len(hit):
                    yield row[q[hit]], row[edge[block[hit]]] + i


def beyond(one: np.ndarray, two: np.ndarray, four: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (three bits and an overflow) is over the radius, 0 to 7."""
    more, equal = over.copy(), ~over
    for plane, bit in ((four, 4), (two, 2), (one, 1)):
        if radius & bit:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return more


def union(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n indices reaches."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(label, up := label[label]):
                label = up
    return label


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) long: edges whose components are those of all pairs within the radius.

    Fingerprints agree on all blocks but the radius; every choice of the other
    blocks is a table of buckets. Each bucket gives a spanning forest, so the
    edges grow with the fingerprints and not with the pairs.
    """
    spark = fps.sparkSession
    fps = fps.select("fp").distinct()
    n = fps.count()
    blocks = radius + 2
    while n >> (64 * (blocks - radius) // blocks) > 64 and blocks < radius + 4:
        blocks += 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cut[i + 1]) - (1 << cut[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)])).alias("x")).select("x.t", "x.k", F.lit(0).alias("pair"), "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > 2 * TILE:
        hot = sizes.where(F.col("n") > 2 * TILE).select("t", "k", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
        keyed = keyed.join(hot, ["t", "k"], "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")))
        other = F.sequence(F.lit(0), F.col("tiles") - 1)
        keyed = keyed.withColumn("pair", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.transform(other, lambda j: F.least(j, F.col("tile")) * F.col("tiles") + F.greatest(j, F.col("tile")))))).select("t", "k", "pair", "fp")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in sorted_groups(batches, ["t", "k", "pair"]):
            fp = rows.column("fp").combine_chunks().to_numpy().view(np.uint64)
            root = union(len(fp), close_pairs(fp, at, radius))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["a", "b"])

    dealt = keyed.repartition(parts(spark), "t", "k", "pair").sortWithinPartitions("t", "k", "pair", "fp")
    return dealt.mapInArrow(lean(work), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp, component_id: every document with its fingerprint and the smallest doc_id it reaches."""
    prints = written(fingerprint_table(docs, words), "fingerprints")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(prints, radius), name="simhash")
    fps = written(fps.join(roots, F.col("node") == F.col("fp"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lows = fps.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(fps.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id (once). Rows with a null doc_id stay."""
    return lowest_rows(docs, near_duplicates(docs, radius, words))


def lowest_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component_id in found (once), and those with a null doc_id.

    Only the ids that go are joined with the texts, and they are broadcast if
    they were counted to be few; more are joined by shuffle.
    """
    own = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    own = written(own, "keepers")
    go = own.where("NOT stays").select("doc_id")
    if go.count() <= BROADCAST_ROWS:
        go = F.broadcast(go)
    out = docs.join(go, "doc_id", "left_anti").select(docs.columns)
    if not own.where("stays AND n > 1").isEmpty():
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, radius=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
