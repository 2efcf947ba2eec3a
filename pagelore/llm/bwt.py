"""Operator 8, suffix-array deduplication of byte strings by merging Burrows-Wheeler transforms.

Each batch of texts is a shard whose suffixes are sorted; intervals of ``window``
common bytes are its own repeats. What is new in its shard and may lie in others
meets as passages, dealt by anchors (passages.py). Equal passages enter once, with
all their places. They are dealt to shards again, each shard sorts its rotations
and gives its transform, and the transforms are merged by interleave refinement:
one stable pass over the merged symbols turns an interleave that is right for r
symbols into one for more, and the rows that part in it have a common prefix of r.
Passes take blocks of up to ten symbols. After ``window`` symbols, intervals
without a cut are the repeated strings; no suffix is sorted again.

Nulls: a null or empty text has no bytes. See passages.py for null and repeated
doc_ids, ties, very long texts and empty tables. Matches are of bytes and may cut
a character; ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm import passages
from pagelore.llm.anchors import groups
from pagelore.llm.common import mix, ragged, text_buffer
from pagelore.llm.suffixes import Suffixes, along

#: Bytes of an anchor gram, shards that a block of passages is dealt to, and symbols that a pass may take at once.
GRAM, SHARDS, BLOCKS = 32, 2, (5, 10, 4, 2)
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def byte_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return SYMBOLS[data], offs, data


def eights(symbols: np.ndarray, after) -> np.ndarray:
    """Eight symbols from each place on as one number."""
    key, width = symbols.astype(np.uint64), 1
    while width < 8:
        key = key << np.uint64(8 * width) | key[after(width)]
        width *= 2
    return key


def shard_repeats(data: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of the windows (8 bytes or more) that start earlier in the shard."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    every = np.arange(n)
    order = Suffixes(eights(data, lambda k: np.minimum(every + k, n - 1)), 8, along(n))
    while 2 * order.width <= window and len(order.open):
        order.to(2 * order.width)
    half, rows = order.width, order.order[order.open]
    string = np.searchsorted(first, rows, "right") - 1
    whole = rows + window <= first[1:][string]
    rows, string = rows[whole], string[whole]
    pair = order.rank[rows] << 32 | order.rank[rows + window - half]
    sort = np.argsort(pair)
    new = groups(pair[sort])
    many = sort[np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1]
    string, offset = string[many], rows[many] - first[:-1][string[many]]
    late = passages.later(pair[many], doc[string], start[string] + offset)
    return string[late], offset[late]


def rotations(symbols: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rotations of each string (symbols between first) by ``depth`` symbols at least, by prefix doubling."""
    size = np.diff(first)
    base, turn = np.repeat(first[:-1], size), np.repeat(size, size)
    place = np.arange(len(symbols)) - base
    key = eights(symbols, lambda k: base + (place + k) % turn)
    return Suffixes(key, 8, lambda rows, k: base[rows] + (place[rows] + k) % turn[rows]).to(depth).order


def merged(transforms: list[np.ndarray], depth: int, block: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' rows and the interval of each merged row: rows of one interval share ``depth`` symbols.

    transforms: of each row of a shard, the ``block`` symbols before it as one small number.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    along = np.empty_like(symbols)
    interval, count = np.zeros(len(symbols), np.int32), 1
    bounds = np.cumsum([0, *map(len, transforms)]).tolist()
    for _ in range(0, depth, block):
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            along[source == k] = symbols[a:b]
        order = np.argsort(along, kind="stable")
        source, interval, now = source[order], interval[order], along[order]
        cut = (interval[1:] != interval[:-1]) | (now[1:] != now[:-1])
        interval = np.concatenate([np.zeros(1, np.int32), np.cumsum(cut, dtype=np.int32)])
        if interval[-1] + 1 == count:  # no row parted: none will
            break
        count = int(interval[-1]) + 1
    return source, interval


def intervals(strings: np.ndarray, first: np.ndarray, depth: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset (its length for the end) and interval of all suffixes in merged order. strings: uint8, first: where they begin (n + 1)."""
    n = len(first) - 1
    ends = np.arange(n, dtype=np.int64)
    size = np.diff(first) + 1
    # A lowest symbol ends each string; UTF-8 has no byte 255.
    symbols = np.zeros(len(strings) + n, np.uint8)
    symbols[np.arange(len(strings)) + np.repeat(ends, size - 1)] = strings + np.uint8(1)
    bounds = first + np.arange(n + 1)
    base, turn = np.repeat(bounds[:-1], size), np.repeat(size, size)
    place = np.arange(len(symbols)) - base
    cuts = np.searchsorted(bounds, np.linspace(0, bounds[-1], shards + 1)[1:-1])
    cuts = np.unique(np.concatenate([[0], cuts, [n]]))
    # The symbols before each place; as many at once as leave numbers of two bytes.
    block, before = 1, symbols[base + (place - 1) % turn]
    codes = {1: before}
    for k in BLOCKS:
        if depth % k or k < max(codes):
            continue
        most = max(j for j in codes if k % j == 0)
        code = np.zeros(len(symbols), np.uint64)
        for j in range(k - most, -1, -most):
            code = code << np.uint64(64 * most // k) | codes[most][base + (place - j) % turn]
        seen, code = np.unique(code, return_inverse=True)
        if len(seen) <= 1 << 16:
            codes[k] = code.astype(np.uint16)
    block, before = max(codes.items())
    orders = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lo, hi = int(bounds[a]), int(bounds[b])
        orders.append(rotations(symbols[lo:hi], bounds[a : b + 1] - lo, depth + block) + lo)
    source, interval = merged([before[o] for o in orders], depth, block)
    at = np.empty(len(symbols), np.int64)
    at[np.argsort(source, kind="stable")] = np.concatenate(orders)
    string = np.searchsorted(bounds, at, "right") - 1
    return string, at - bounds[string], interval


def merged_repeats(data: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of the windows of passages that start earlier in the block, from the intervals of the merged transforms."""
    seen: dict[bytes, int] = {}
    raw, cut = data.tobytes(), first.tolist()
    same = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)
    by = np.argsort(same, kind="stable")  # the places of each different passage
    owners = np.bincount(same, minlength=len(seen))
    begin = np.cumsum(owners) - owners
    size = np.array([len(x) for x in seen], np.int64)
    string, offset, interval = intervals(np.frombuffer(b"".join(seen), np.uint8), np.concatenate([[0], np.cumsum(size)]), window)
    good = np.flatnonzero(offset + window <= size[string])
    total = np.bincount(interval[good], owners[string[good]], int(interval.max(initial=0)) + 1)
    good = good[total[interval[good]] > 1]
    n = owners[string[good]]
    passage, offset, interval = by[ragged(begin[string[good]], n)], np.repeat(offset[good], n), np.repeat(interval[good], n)
    late = passages.later(interval, doc[passage], start[passage] + offset)
    return passage[late], offset[late]


def deduplicated(docs: DataFrame, window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans array<struct<start, end>> of removed bytes."""
    spans, plan = passages.repeated_windows(docs, byte_symbols, shard_repeats, merged_repeats, window, GRAM, np.uint8)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, offs = text_buffer(batch.column("text"))
        gone = passages.covered(passages.ByDoc(blobs, passages.SPAN), batch.column("doc_id").to_numpy(), offs, window) if blobs else np.zeros(len(data), bool)
        edge = np.concatenate([[0], np.cumsum(~gone)])[offs]
        raw = data[~gone].tobytes()
        kept = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        n = np.diff(offs)
        lists: list[list] = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            cut = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist() if gone[a:b].any() else []
            lists.append([{"start": x, "end": y} for x, y in zip(cut[::2], cut[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(edge)), pa.array([len(x) for x in lists], pa.int64()), pa.array(kept, pa.binary()), pa.array(lists, place)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    out = passages.with_texts(docs.where("doc_id IS NOT NULL"), spans, plan, work, kind)

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from work(b, [])

    return out.unionByName(docs.where("doc_id IS NULL").mapInArrow(alone, kind))


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
