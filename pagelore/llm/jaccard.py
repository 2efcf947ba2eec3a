"""Near-duplicates by Jaccard similarity of word shingles, exact at 0.8 or more.

A text is the set of its shingles' hashes; texts of equal sets are one node. Only
the first fifths of sets are stored; whole sets are made again, of one document for
each node that some pair holds.
Shingles are ordered by how often a bounded sample holds them, then by hash;
two sets that share 8 of 9 parts of their sizes' sum (similarity 0.8) have
their first common shingle within the first fifth of both. So every pair meets
in the bucket of such a shingle, and sizes and places rule out most others.
What remains is compared in full.

Pairs come in two rounds, so that a large group of near copies costs no
square: first, pairs linked by SimHash, and each node with one of its buckets'
first nodes; then, in every bucket, all pairs that the components so far leave apart.
The sample decides the cost only; the result is exact but for collisions of
64-bit hashes.

Nulls: as in ``simhash``; texts without words are alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import LOWER, bounded_batches, components, lean, mix, parts, ragged, sorted_groups, spans, text_buffer, word_hashes, word_spans, written
from pagelore.llm.simhash import BROADCAST_ROWS, folded, links, lowest_rows

#: Nodes that the shingle sample holds, how many of them make a shingle common, and how many common ones are kept.
SAMPLE_NODES, COMMON, MOST_COMMON = 4096, 3, 100_000
#: Bins that a set's hashes are counted in: sets whose bins can't hold enough common hashes are not compared.
BINS = 128
#: Bytes of sets in a slice of a cluster; a larger cluster's hashes are dealt to several.
SLICE_BYTES = 32 << 20
#: Nodes that a task remembers to have dealt out.
SEEN = 200_000
#: Pairs looked at in one step.
STEP = 1 << 18
#: Pairs whose bins are looked at in one step.
PAIRS = 1 << 14
#: Bytes of text hashed at a time: hashing takes some fifty bytes of memory a byte.
PIECE = 256 << 10
#: Multiplier that joins the hashes of a shingle's words.
JOIN = np.uint64(0x9E6C63D0676A9A99)
#: Leading bits of a hash that tell most uncommon shingles.
LEADING = 22


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the word shingles of all texts, A-Z lower-cased, one after another, and their number per text. Made of hashes of words."""
    starts, ends, first = word_spans(data, offs)
    count = np.diff(first)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not len(starts):
        return np.zeros(0, np.uint64), shingles
    w = word_hashes(LOWER[data], starts, ends)
    head, width = ragged(first[:-1], shingles), np.repeat(np.minimum(count, words), shingles)
    h = w[head]
    for i in range(1, words):
        h = np.where(width > i, h * JOIN + w[np.minimum(head + i, len(w) - 1)], h)
    return mix(h), shingles


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the sorted set of its shingles' hashes, one after another; where sets begin (n + 1); their hashes (nodes); the SimHashes."""
    data, offs = text_buffer(text)
    pieces = [shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words) for i, j in spans(np.diff(offs), PIECE)]
    h = np.concatenate([x for x, _ in pieces] or [np.zeros(0, np.uint64)])
    count = np.concatenate([x for _, x in pieces] or [np.zeros(0, np.int64)])
    fp = folded(h, count).view(np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    h = h.view(np.int64)
    ends = np.cumsum(count)
    for i, j in zip((ends - count).tolist(), ends.tolist(), strict=True):
        h[i:j].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h = h[new]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(count)))])
    node = np.array([xxhash.xxh64_intdigest(h[i:j].tobytes(), 7) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64).view(np.int64)
    return h, at, node, fp


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and its n + 1 offsets."""
    at = col.offsets.to_numpy()
    return col.values.to_numpy()[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string"))


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that several nodes of a sample hold, and how many do."""
    picked = rows.where(F.pmod(F.xxhash64("mark"), F.lit(max(1, rows.count() // SAMPLE_NODES))) == 0).select("text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, node, _ = shingle_sets(b.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, np.diff(at))), pa.array(h)], ["node", "h"])

    counts = picked.mapInArrow(lean(work), "node long, h long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64), np.array([r.n for r in found], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


def head_table(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, node (hash of the set), fp (SimHash), size, bins (counts, 255 for that or more) and head (the first fifth of the set in the common order) of every document."""
    common, often = common_shingles(rows, words)
    leading = np.zeros(1 << LEADING, bool)
    leading[common.view(np.uint64) >> np.uint64(64 - LEADING)] = True

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, node, fp = shingle_sets(b.column(2), words)
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            bins = np.minimum(np.bincount(owner * BINS + (h & (BINS - 1)), minlength=len(size) * BINS), 255).astype(np.uint8).reshape(-1, BINS)
            # Places of common shingles and of the others, each in its text's order; the others come first.
            some = np.flatnonzero(leading[h.view(np.uint64) >> np.uint64(64 - LEADING)])
            i = np.minimum(np.searchsorted(common, h[some]), max(len(common) - 1, 0))
            i, some = (v[common[i] == h[some]] if len(some) else v for v in (i, some))
            some = some[np.lexsort((h[some], often[i], owner[some]))]
            rare = np.ones(len(h), bool)
            rare[some] = False
            rare = np.flatnonzero(rare)
            n = np.bincount(owner[rare], minlength=len(size))
            most = np.minimum(size, size - (4 * size + 4) // 5 + 1)
            lead = np.minimum(most, n)
            place = np.concatenate([rare[ragged(np.cumsum(n) - n, lead)], some[ragged(np.cumsum(size - n) - (size - n), most - lead)]])
            place = place[np.argsort(owner[place], kind="stable")]
            head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), pa.array(h[place]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(fp), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in bins], pa.binary()), head], ["doc_id", "mark", "node", "fp", "size", "bins", "head"])

    return rows.mapInArrow(lean(work), "doc_id long, mark long, node long, fp long, size int, bins binary, head array<long>")


def in_several(sets: DataFrame) -> DataFrame:
    """k (shingle), node, size, place: the heads' shingles that several nodes hold; low is k's first node and low_size its size."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            h, at = lists(b.column(2))
            if len(seen) > SEEN:
                seen.clear()
            some = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            most = np.where(some, np.diff(at), 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[ragged(at[:-1], most)], np.repeat(node, most), np.repeat(size, most), ragged(np.zeros_like(most), most).astype(np.int32))], ["k", "node", "size", "place"])

    def several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "node", "size", "place"]
        # The first row of the group that a batch leaves open, and whether it went out.
        held: pa.RecordBatch | None = None
        known = False
        for b in batches:
            if not b.num_rows:
                continue
            known &= held is not None and held.column(0)[0] == b.column(0)[0]
            own = held is not None and held.column(0)[0] == b.column(0)[0]
            t = pa.Table.from_batches([held, b] if own else [b]).combine_chunks()
            k, node, size, place = (t.column(c).to_numpy() for c in names)
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            other = new.copy()
            other[1:] |= node[1:] != node[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            many = np.bincount(first[other], minlength=len(k))[first] > 1
            if known:
                many |= first == 0
            go = other & many
            go[0] &= not known
            r, known = np.flatnonzero(go), bool(many[-1])
            held = t.slice(int(first[-1]), 1).to_batches()[0]
            for i in range(0, len(r), STEP):
                x = r[i : i + STEP]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k[x], node[x], size[x], place[x], node[first[x]], size[first[x]])], [*names, "low", "low_size"])

    dealt = sets.select("node", "size", "head").mapInArrow(lean(deal), "k long, node long, size int, place int").repartition(parts(sets.sparkSession), "k").sortWithinPartitions("k", "node")
    return dealt.mapInArrow(lean(several), "k long, node long, size int, place int, low long, low_size int")


def may_be_alike(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether bins leave room for as many common hashes as 0.8 needs; a full bin says nothing. both: the sizes' sums."""
    common = np.minimum(x, y)
    return (9 * common.sum(1, dtype=np.int64) >= 4 * both) | (common == 255).any(1)


def apart(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of a bucket in different components whose sizes, places and bins allow 0.8. rows: k, node, size, place, root, bins.

    All that two sets have in common lies at or behind their first common shingle, so a pair is
    given out only by buckets behind which both sets are still long enough; the bucket of its first
    common shingle is one of them. Bins rule most other pairs out before they leave the bucket.
    """
    names = ["a", "b", "size_a", "size_b", "place_a", "place_b"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["k"]):
            node, size, place, root = (t.column(c).combine_chunks().to_numpy() for c in ("node", "size", "place", "root"))
            packed = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                kinds, kind, n = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
                if len(kinds) < 2:
                    continue
                # The largest component comes first and is not compared with itself.
                order = np.argsort(-n[kind], kind="stable") + lo
                x, s, at_, c, bins = node[order], size[order].astype(np.int64), place[order], root[order], packed[order]
                left = 9 * (s - at_)
                i, step = int((c == c[0]).sum()), max(1, STEP // (hi - lo))
                while i < hi - lo:
                    j = min(i + step, hi - lo)
                    fits = 5 * np.minimum(s[i:j, None], s[None, :j]) >= 4 * np.maximum(s[i:j, None], s[None, :j])
                    fits &= np.minimum(left[i:j, None], left[None, :j]) >= 4 * (s[i:j, None] + s[None, :j])
                    p, q = np.nonzero(fits & (c[i:j, None] != c[None, :j]) & (np.arange(i, j)[:, None] > np.arange(j)[None, :]))
                    p = p + i
                    good = [may_be_alike(bins[p[u : u + PAIRS]], bins[q[u : u + PAIRS]], s[p[u : u + PAIRS]] + s[q[u : u + PAIRS]]) for u in range(0, len(p), PAIRS)]
                    good = np.concatenate(good) if good else np.zeros(0, bool)
                    p, q = p[good], q[good]
                    if len(p):
                        low, high = np.where(x[p] < x[q], p, q), np.where(x[p] < x[q], q, p)
                        yield pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in ((x[low], np.int64), (x[high], np.int64), (s[low], np.int32), (s[high], np.int32), (at_[low], np.int32), (at_[high], np.int32))], names)
                    i = j

    met = rows.repartition(parts(rows.sparkSession), "k").sortWithinPartitions("k").mapInArrow(lean(work), "a long, b long, size_a int, size_b int, place_a int, place_b int")
    ends = [F.max(f"place_{c}").alias(f"last_{c}") for c in "ab"]
    met = met.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"), *ends)
    # Common are the n shingles met here, the first ones of all, and what lies behind the last of them.
    return met.where("9 * least(n + size_a - last_a - 1, n + size_b - last_b - 1) >= 4 * (size_a + size_b)").select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of 0.8 or more. One document of each node is read again."""
    some = sets.groupBy("node").agg(F.first("size").alias("size"), F.first("bins").alias("bins"))
    ends = [some.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab"]

    def may(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (3, 5))
            size = b.column(2).to_numpy().astype(np.int64) + b.column(4).to_numpy()
            good = may_be_alike(x, y, size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size)], ["a", "b", "both"]).filter(pa.array(good))

    binned = pairs.where("a <> b").distinct().join(ends[0], "a").join(ends[1], "b").select("a", "b", "size_a", "bins_a", "size_b", "bins_b")
    pairs = written(binned.mapInArrow(lean(may), "a long, b long, both long"), "pairs")
    # Sets that pairs connect are a cluster; slices of it hold the hashes of one remainder, and every pair counts what it has in common there.
    linked = written(components(pairs, name="clusters"), "clusters")
    members = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    sized = written(members.join(some.select("node", "size"), "node"), "members")
    slices = sized.groupBy("root").agg(F.ceil(F.sum(F.col("size").cast("long")) * 8 / SLICE_BYTES).cast("int").alias("slices"))
    dealt = written(sized.join(slices, "root").select("node", "root", F.greatest("slices", F.lit(1)).alias("slices")), "slices")
    one = sets.join(dealt, "node").groupBy("root", "slices", "node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x"))
    one = written(one.select("root", "slices", F.col("x.doc_id").alias("id"), F.col("x.mark").alias("its")), "representatives")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root, many = (b.column(c).to_numpy().astype(np.int64) for c in (1, 2))
            h, at, node, _ = shingle_sets(b.column(0), words)
            owner = np.repeat(np.arange(len(node)), np.diff(at))
            own = (np.cumsum(many) - many)[owner] + (h.view(np.uint64) % many[owner].astype(np.uint64)).astype(np.int64)
            if len(many) and many.max() > 1:
                h = h[np.argsort(own, kind="stable")]
            n = np.bincount(own, minlength=int(many.sum()))
            row, which = np.repeat(np.arange(len(node)), many), ragged(np.zeros_like(many), many)
            row, which, n = row[n > 0], which[n > 0], n[n > 0]
            end = np.cumsum(n)
            for lo, hi in spans(n, 1 << 18):
                r, begin = row[lo:hi], end[lo] - n[lo]
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end[lo:hi] - begin]), pa.int32()), pa.array(h[begin : end[hi - 1]]))
                zero = np.zeros(len(r), np.int64)
                columns = [pa.array(root[r]), pa.array(which[lo:hi].astype(np.int32)), pa.array(zero.astype(np.int32)), pa.array(node[r]), pa.array(zero), pa.array(zero), made]
                yield pa.RecordBatch.from_arrays(columns, ["root", "slice", "kind", "a", "b", "both", "hashes"])

    read = rows.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its"))).select("text", "root", "slices")
    asked = pairs.join(dealt.select(F.col("node").alias("a"), "root", "slices"), "a").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asked = asked.select("root", "slice", F.lit(1).alias("kind"), "a", "b", "both", F.lit(None).cast("array<long>").alias("hashes"))
    kind = "root long, slice int, kind int, a long, b long, both long, hashes array<long>"
    meeting = read.mapInArrow(lean(sets_of), kind).unionByName(asked).repartition(parts(sets.sparkSession), "root", "slice").sortWithinPartitions("root", "slice", "kind")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            root, at, which, x, y = (b.column(c).to_numpy() for c in range(5))
            n = np.zeros(b.num_rows, np.int64)
            h, begin = lists(b.column(6))
            for i in range(b.num_rows):
                if (root[i], at[i]) != now:
                    now, held = (root[i], at[i]), {}
                if which[i] == 0:
                    held[x[i]] = h[begin[i] : begin[i + 1]].copy()
                    continue
                u, v = held.get(x[i]), held.get(y[i])
                if u is not None and v is not None:
                    u, v = (u, v) if len(u) >= len(v) else (v, u)
                    n[i] = (u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), b.column(5), pa.array(n)], ["a", "b", "both", "n"]).filter(pa.array(n > 0))

    counted = meeting.mapInArrow(lean(work), "a long, b long, both long, n long")
    return counted.groupBy("a", "b", "both").agg(F.sum("n").alias("n")).where("9 * n >= 4 * both").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, component_id: every document and the smallest doc_id that it reaches by pairs of similarity 0.8 or more."""
    bounded_batches(docs.sparkSession)
    rows = rows_of(docs)
    sets = written(head_table(rows, words), "heads")
    buckets = written(in_several(sets), "buckets")
    firsts = sets.groupBy("fp").agg(F.min("node").alias("node"))
    linked = links(sets, radius).join(firsts.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    alike = sets.select("fp", F.col("node").alias("y")).distinct().join(firsts.select("fp", F.col("node").alias("x")), "fp")
    # Of the first nodes of its buckets, a node meets the one with which it shares most; the rest is for the second round.
    starred = buckets.where("node <> low AND 5 * least(size, low_size) >= 4 * greatest(size, low_size)").groupBy("node", "low").agg(F.count(F.lit(1)).alias("n"))
    starred = starred.groupBy(F.col("node").alias("x")).agg(F.max(F.struct("n", "low")).alias("m")).select("x", F.col("m.low").alias("y"))
    first = linked.select("x", "y").unionByName(alike.select("x", "y")).unionByName(starred).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    roots = written(components(similar(first, sets, rows, words), name="jaccard"), "near")
    rooted = buckets.join(roots, "node", "left").select("k", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    # Buckets that one component holds have no pair left; only the rows of others carry bins.
    own = Window.partitionBy("k")
    rooted = rooted.withColumns({"low": F.min("root").over(own), "high": F.max("root").over(own)}).where("low <> high").drop("low", "high")
    binned = rooted.join(sets.groupBy("node").agg(F.first("bins").alias("bins")), "node")
    rest = similar(apart(binned), sets, rows, words)
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    rest = rest.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    again = written(components(rest, name="jaccard"), "far").select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes.join(again, "root", "left").select("node", "low", F.coalesce("top", "root").alias("top")), "nodes")
    lows = nodes.groupBy("top").agg(F.min("low").alias("component_id"))
    return sets.select("doc_id", "node").join(nodes.join(lows, "top").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id (once). Rows with a null doc_id stay."""
    return lowest_rows(docs, near_duplicates(docs, words))
