"""Repeated windows of a corpus: shared by operators 4 and 8, which differ in how a block of strings is searched.

1. Every batch of texts is cut into anchored runs (anchors.py). Runs whose anchor
   recurs in the batch are a block: the operator finds its windows that start
   earlier in the same block. What is left goes, packed, to a bucket of its anchor.
2. A bucket asks for the runs whose anchor came from several places.
3. Texts answer with passages (a run and the window it ends in), which meet in
   the bucket of their anchor. There the operator searches them as a block
   again, so that each removed window was found by its method, in step 1 or here.

Anchors only decide where text is compared; equal windows have equal anchors.
Grams in several of a bounded sample of documents are avoided as anchors, so
that a common passage in many contexts spreads over the contexts' own grams.
Windows that hold nothing else are the same everywhere: step 1 leaves one of
each in a batch, these are dealt by home, searched, and what is left of them
meets in the bucket of the anchor in one more round. The sample changes no result.

A window counts as a copy if an equal one starts earlier (smaller doc_id, or
the same doc_id and an earlier start). Rows with a null doc_id have no place in
that order: nothing is removed from them and they are no reference. Rows that
share a doc_id are one document: equal places in them are the same place.
Texts shorter than a window, empty ones and nulls have no windows; long ones are
whole strings of their block. An empty table gives an empty result. Other
columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.anchors import Frequent, Runs, gram_hashes, groups
from pagelore.llm.common import bounded_batches, mix, parts, ragged, sorted_groups, text_buffer, written

#: Bytes of text for each bucket and for each home (the group of documents that a span returns to).
BUCKET_BYTES, HOME_BYTES, MOST_BUCKETS = 2 << 20, 4 << 20, 1 << 24
#: Sampled documents, and how many of them make a gram frequent.
SAMPLE_DOCS, FREQUENT = 2000, 4
#: Bytes of passages that are searched as one block; those of one anchor stay together.
CHUNK = 1 << 18

#: (symbols to hash, where texts begin, what the operator searches and passages carry) of a batch of texts.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (raw units, where strings begin, doc_id and start of each string, window): string and offset of the windows that start earlier in the block.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
ROWS = "bucket int, blob binary"


@dataclass
class Plan:
    """What all steps share. within searches a batch of texts, between a block of passages from many."""

    units: Units
    within: Search
    between: Search
    window: int
    gram: int
    buckets: int
    homes: int
    frequent: Frequent

    def bucket_of(self, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Frequent anchors are dealt by home as well."""
        salt = np.where(self.frequent(anchor), mix(home_of(doc, self.homes).astype(np.uint64) + np.uint64(1)), np.uint64(0))
        return ((anchor ^ salt) % np.uint64(self.buckets)).astype(np.int64)


def home_of(ids: np.ndarray, homes: int) -> np.ndarray:
    low = (ids ^ (ids.view(np.uint64) >> np.uint64(32)).view(np.int64)) & 0x7FFFFFFF
    return ((low * 1640531527) >> 15) % homes


def home_column(homes: int) -> Column:
    low = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 32)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.pmod(F.shiftright(low * F.lit(1640531527), 15), F.lit(homes)).cast("int")


def pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blobs: Iterable[bytes], *types: type) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in types]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for x, t in zip(out, types, strict=True):
            x.append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]


def dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) for rows of any order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(groups(bucket)) if len(bucket) else np.zeros(0, np.int64)
    arrays = tuple(a[order] for a in arrays)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), pack(*(x[a:b] for x in arrays))


def batch_of(rows: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["bucket", "blob"])


RUN = (np.uint64, np.int64, np.int32, np.int32)  # anchor, doc_id, start, count
SPAN = (np.int64, np.int32, np.int32)  # doc_id, start, count of windows
ASK = (np.int64, np.int32, np.int32, np.uint64)  # doc_id, start, count, anchor


def later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows come after another place with their key, for rows sorted by key."""
    if not len(key):
        return np.zeros(0, bool)
    place = np.unique(doc, return_inverse=True)[1] << 32 | start
    new = groups(key)
    return place > np.minimum.reduceat(place, np.flatnonzero(new))[np.cumsum(new) - 1]


def texts_of(batch: pa.RecordBatch, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.ascontiguousarray(batch.column("doc_id").to_numpy()), *units(*text_buffer(batch.column("text")))


def find_runs(docs: DataFrame, plan: Plan) -> DataFrame:
    """Packed runs by bucket; spans that a batch settles, by buckets + home."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, symbols, first, raw = texts_of(b, plan.units)
            r = Runs(symbols, first, plan.window, plan.gram, plan.frequent)
            # Stretches of runs whose anchors recur in the batch are its block.
            _, same, often = np.unique(r.anchor, return_inverse=True, return_counts=True)
            again = np.flatnonzero(often[same] > 1)
            lo, hi = r.at[again], r.at[again] + r.count[again]
            opens = np.append(lo[:1] == lo[:1], lo[1:] != hi[:-1])
            lo, hi, text = lo[opens], hi[np.append(opens[1:], opens[:1])], r.text[again][opens]
            size = hi - lo + plan.window - 1
            string, offset = plan.within(raw[ragged(lo, size)], np.concatenate([[0], np.cumsum(size)]), ids[text], lo - first[:-1][text], plan.window)
            copies = lo[string] + offset
            doc, start, count = joined(ids[text[string]], copies - first[:-1][text[string]])
            yield from batch_of(dealt(home_of(doc, plan.homes) + plan.buckets, doc, start, count))
            # A run is narrowed to the windows that are new in this batch.
            new = np.ones(len(raw) + 1, bool)
            new[copies] = False
            new = np.flatnonzero(new)
            head, past = np.searchsorted(new, r.at), np.searchsorted(new, r.at + r.count)
            some = head < past
            head, tail = new[head[some]], new[past[some] - 1]
            doc, anchor = ids[r.text[some]], r.anchor[some]
            start, count = (r.start[some] + head - r.at[some]).astype(np.int32), (tail - head + 1).astype(np.int32)
            yield from batch_of(dealt(plan.bucket_of(anchor, doc), anchor, doc, start, count))

    return docs.select("doc_id", "text").mapInArrow(work, ROWS)


def settle_runs(runs: DataFrame, plan: Plan) -> DataFrame:
    """Spans by home; passages to ask for by homes + home."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in sorted_groups(batches, ["bucket"]):
            bucket, blobs = rows.column("bucket").to_pylist(), rows.column("blob").to_pylist()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if bucket[a] >= plan.buckets:
                    yield from batch_of((bucket[a] - plan.buckets, x) for x in blobs[a:b])
                    continue
                anchor, doc, start, count = unpack(blobs[a:b], *RUN)
                order = np.argsort(anchor)
                new = groups(anchor[order])
                several = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
                ask = order[several | plan.frequent(anchor[order])]
                yield from batch_of(dealt(home_of(doc[ask], plan.homes) + plan.homes, doc[ask], start[ask], count[ask], anchor[ask]))

    return runs.repartition(parts(runs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(work, ROWS)


def with_texts(docs: DataFrame, blobs: DataFrame, plan: Plan, work: Callable, schema: str) -> DataFrame:
    """work(ids, texts batch, blobs of their home) over all texts, dealt by home; the blobs (bucket = home) come first."""
    texts = docs.select(home_column(plan.homes).alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    given = blobs.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
    rows = texts.unionByName(given).repartition(parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            bucket, kind = b.column("bucket").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero(groups(bucket, kind)).tolist() if b.num_rows else []
            for lo, hi in zip(cut, [*cut[1:], b.num_rows]):
                if bucket[lo] != now:
                    now, held = bucket[lo], []
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held += part.column("blob").to_pylist()
                else:
                    yield from work(part, held)

    return rows.mapInArrow(stream, schema)


class ByDoc:
    """Rows of packed arrays (the first is doc_id), looked up by document."""

    def __init__(self, blobs: list[bytes], types: tuple):
        arrays = unpack(blobs, *types)
        order = np.argsort(arrays[0], kind="stable")
        self.arrays = [a[order] for a in arrays]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For the documents ids: of each row found, the index of its document and the other arrays."""
        lo, hi = np.searchsorted(self.arrays[0], ids), np.searchsorted(self.arrays[0], ids, "right")
        at = ragged(lo, hi - lo)
        return np.repeat(np.arange(len(ids)), hi - lo), [a[at] for a in self.arrays[1:]]


def passage_blobs(bucket: np.ndarray, anchor, doc, start, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed passages): their anchors, places and sizes, then their units."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(groups(bucket[order])).tolist()
    for a, b in zip(cut, [*cut[1:], len(order)]):
        o = order[a:b]
        yield int(bucket[o[0]]), pack(anchor[o], doc[o], start[o], size[o]) + raw[ragged(at[o], size[o])].tobytes()


def find_passages(docs: DataFrame, asked: DataFrame, plan: Plan) -> DataFrame:
    """The passages asked for, by bucket."""

    def work(batch: pa.RecordBatch, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        ids, _, first, raw = texts_of(batch, plan.units)
        text, (start, count, anchor) = ByDoc(blobs, ASK).of(ids)
        # A place that a shorter row of the same doc_id lacks is no passage.
        fits = first[:-1][text] + start + count + plan.window - 1 <= first[1:][text]
        text, start, count, anchor = text[fits], start[fits], count[fits], anchor[fits]
        if len(text):
            yield from batch_of(passage_blobs(plan.bucket_of(anchor, ids[text]), anchor, ids[text], start, raw, first[:-1][text] + start, count.astype(np.int64) + plan.window - 1))

    return with_texts(docs, asked, plan, work, ROWS)


PASSAGE = (np.uint64, np.int64, np.int32, np.int64)  # anchor, doc_id, start, size


def settle_passages(found: DataFrame, plan: Plan, again: bool, unit: type) -> DataFrame:
    """Spans by home; with again, passages with frequent anchors that still hold new windows, by homes + their anchor's bucket."""
    width = np.dtype(unit).itemsize
    row = sum(np.dtype(t).itemsize for t in PASSAGE)

    def blocks(blobs: list[bytes]) -> Iterator[tuple]:
        heads, raws = [], []
        for x in blobs:
            end = 8 + row * int(np.frombuffer(x, np.int64, 1)[0])
            heads.append(x[:end])
            raws.append(np.frombuffer(x, unit, offset=end))
        anchor, doc, start, size = unpack(heads, *PASSAGE)
        raw = np.concatenate(raws)
        at = np.cumsum(size) - size
        order = np.lexsort((start, doc, anchor))
        kinds = np.cumsum(groups(anchor[order]))
        total = np.cumsum(size[order]) * width
        lo = 0
        while lo < len(order):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, "right"))
            hi = int(np.searchsorted(kinds, kinds[min(max(hi, lo + 1), len(order)) - 1], "right"))
            o, lo = order[lo:hi], hi
            yield anchor[o], doc[o], start[o], size[o], raw[ragged(at[o], size[o])]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in sorted_groups(batches, ["bucket"]):
            blobs = rows.column("blob").to_pylist()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for anchor, doc, start, size, raw in blocks(blobs[a:b]):
                    first = np.concatenate([[0], np.cumsum(size)])
                    string, offset = plan.between(raw, first, doc, start, plan.window)
                    d, s, n = joined(doc[string], start[string] + offset)
                    yield from batch_of(dealt(home_of(d, plan.homes), d, s, n))
                    if again:
                        left = size - plan.window + 1 > np.bincount(string, minlength=len(size))
                        go = np.flatnonzero(left & plan.frequent(anchor))
                        if len(go):
                            bucket = (anchor[go] % np.uint64(plan.buckets)).astype(np.int64) + plan.homes
                            yield from batch_of(passage_blobs(bucket, anchor[go], doc[go], start[go], raw, first[go], size[go]))

    return found.repartition(parts(found.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(work, ROWS)


def joined(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as maximal runs of consecutive ones: doc, start, count."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    new = groups(doc) | np.concatenate([[True][: len(doc)], np.diff(start) > 1]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return doc[at], start[at].astype(np.int32), (start[last] - start[at] + 1).astype(np.int32)


def frequent_grams(docs: DataFrame, units: Units, gram: int, n_docs: int) -> Frequent:
    """Grams in FREQUENT of about SAMPLE_DOCS documents. Only a hint on how to deal rows."""
    every = max(1, n_docs // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, symbols, first, _ = texts_of(b, units)
            h, text = gram_hashes(symbols, first, gram)
            sort = np.lexsort((text, h))
            h = h[sort][groups(h[sort], text[sort])]
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["gram", "n"])

    counts = sample.select("doc_id", "text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).select("gram").toArrow()
    return Frequent(rows.column(0).to_numpy().view(np.uint64))


def repeated_windows(docs: DataFrame, units: Units, within: Search, between: Search, window: int, gram: int, unit: type) -> tuple[DataFrame, Plan]:
    """(bucket = home, blob of SPAN rows) of all windows that have an earlier equal, and the plan that deals them."""
    bounded_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    clamp = lambda x: int(min(max(1, x), MOST_BUCKETS))
    plan = Plan(units, within, between, window, gram, clamp(size // BUCKET_BYTES), clamp(size // HOME_BYTES), frequent_grams(docs, units, gram, n))
    split = lambda df: (df.where(F.col("bucket") < plan.homes), df.where(F.col("bucket") >= plan.homes).withColumn("bucket", F.col("bucket") - plan.homes))
    early, asked = split(written(settle_runs(find_runs(docs, plan), plan), "runs"))
    inner, left = split(written(settle_passages(find_passages(docs, asked, plan), plan, True, unit), "passages"))
    last = written(settle_passages(left, plan, False, unit), "frequent")
    return early.unionByName(inner).unionByName(last), plan


def covered(spans: ByDoc, ids: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Whether each symbol lies in a repeated window."""
    text, (start, count) = spans.of(ids)
    n = int(first[-1])
    step = np.zeros(n + 1, np.int64)
    at = first[:-1][text] + start
    # A place that a shorter row of the same doc_id lacks counts for nothing.
    end = np.minimum(at + count + window - 1, first[1:][text])
    fits = at < end
    np.add.at(step, at[fits], 1)
    np.add.at(step, end[fits], -1)
    return np.cumsum(step)[:n] > 0
