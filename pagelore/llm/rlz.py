"""Operator 4, substring deduplication by relative Lempel-Ziv parsing of words.

A reference block is a set of strings of words with a suffix array over them.
A document is parsed against it from left to right: the longest factor that
also starts earlier (smaller doc_id, or same document, earlier start) is taken
greedily, then the parse goes on behind it. A factor of ``window`` words or more
is a duplicate span. Where two factors meet, the windows across their boundary
are checked in the index; a window across two boundaries can't repeat, because
the factor between would have been taken longer. Spans that touch or overlap join.

The corpus is a row of blocks: each batch of texts is parsed against itself, and
each bucket of passages against itself (passages.py deals every passage to the
block in which an equal window could lie, so a document visits the blocks that
matter and no others). Words are compared by 64-bit hashes of all
their bytes, not polynomial ones, for which unlike words of equal hash can be built.

Nulls: a null or empty text has no words. See passages.py for null and repeated
doc_ids, ties, very long texts and empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm import passages
from pagelore.llm.anchors import groups
from pagelore.llm.common import ragged, text_buffer, word_hashes, word_spans
from pagelore.llm.suffixes import Suffixes, along

#: Words of an anchor gram.
GRAM = 6
#: Windows of a text that are parsed as one piece of it.
PIECE = 64


def word_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offs)
    symbols = word_hashes(data, starts, ends)
    return symbols, first, symbols


class Reference:
    """A block of strings of symbols, indexed for factors that start earlier."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, longest: int):
        """Strings lie between first; doc and start say where each comes from. Factors have ``longest`` symbols at most."""
        size = np.diff(first)
        string = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(symbols)) + string
        _, codes = np.unique(symbols, return_inverse=True)
        n = len(symbols) + len(size)
        #: Symbols from 1; a 0 ends each string.
        self.text = np.zeros(n + longest + 1, np.int64)
        self.text[at] = codes + 1
        self.first = first + np.arange(len(first))
        # Places in the order of the corpus; what ends a string lies behind all.
        self.place = np.full(n, np.iinfo(np.int64).max)
        self.place[at] = np.unique(doc, return_inverse=True)[1][string] << 32 | (start[string] + np.arange(len(symbols)) - first[:-1][string])
        order = Suffixes(self.text[:n] << 32 | self.text[1 : n + 1], 2, along(n))
        half = 2
        while 2 * half <= window:
            half *= 2
        rank = order.to(half).rank.copy()
        self.order = order.to(longest).order
        pos = self.place[self.order]
        new = groups(rank[self.order], rank[np.minimum(self.order + window - half, n - 1)])
        cut = np.flatnonzero(new)
        #: Of each suffix, the earliest place of its first window symbols, and whether they recur.
        self.low, self.again = np.empty(n, np.int64), np.empty(n, bool)
        group = np.cumsum(new) - 1
        self.low[self.order] = np.minimum.reduceat(pos, cut)[group] if n else pos
        self.again[self.order] = np.diff(np.append(cut, n))[group] > 1
        #: Earliest place of each power of two of neighbouring suffixes.
        self.least = [pos]
        while 2 << (len(self.least) - 1) <= n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))
        self.begins = np.searchsorted(self.text[self.order], np.arange(int(codes.max(initial=0)) + 3))

    def earliest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The earliest place among the suffixes a to b of the order (b > a)."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.least[k][a[i]], self.least[k][b[i] - (1 << k)])
        return out

    def bound(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The first of the suffixes a to b (alike for depth symbols) whose next symbol is not below the given one."""
        a, b = a.copy(), b.copy()
        while len(live := np.flatnonzero(a < b)):
            m = (a[live] + b[live]) >> 1
            less = self.text[self.order[m] + depth[live]] < symbol[live]
            a[live[less]] = m[less] + 1
            b[live[~less]] = m[~less]
        return a

    def factors(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, start and length of the greedy factors of the pieces text[lo:hi], in order. Symbols without an earlier equal are in none."""
        piece, i = np.arange(len(lo)), lo.copy()
        size, a, b = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(piece):
            more = i + size < hi[piece]
            symbol = self.text[i + size]
            x, y = self.begins[symbol], self.begins[symbol + 1]
            old = np.flatnonzero(more & (size > 0))
            if len(old):
                x[old] = self.bound(a[old], b[old], size[old], symbol[old])
                y[old] = self.bound(x[old], b[old], size[old], symbol[old] + 1)
            longer = np.flatnonzero(more & (x < y))
            longer = longer[self.earliest(x[longer], y[longer]) < self.place[i[longer]]]
            ended = np.ones(len(piece), bool)
            ended[longer] = False
            a[longer], b[longer] = x[longer], y[longer]
            size[longer] += 1
            done = np.flatnonzero(ended & (size > 0))
            out.append((piece[done], i[done], size[done]))
            i[ended] += np.maximum(size[ended], 1)
            size[ended] = 0
            left = ~ended | (i < hi[piece])
            if not left.all():
                piece, i, size, a, b = (v[left] for v in (piece, i, size, a, b))
        piece, i, size = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 3))
        order = np.lexsort((i, piece))
        return piece[order], i[order], size[order]

    def repeats(self, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
        """Where in text the windows of the pieces text[lo:hi] begin that long factors hold or that a check at a boundary finds."""
        piece, i, size = self.factors(lo, hi)
        long = size >= window
        inside = ragged(i[long], size[long] - window + 1)
        meet = np.flatnonzero((piece[1:] == piece[:-1]) & (i[:-1] + size[:-1] == i[1:]) & (size[:-1] + size[1:] >= window))
        head = np.maximum(i[meet], i[meet + 1] - window + 1)
        tail = np.minimum(i[meet + 1] - 1, i[meet + 1] + size[meet + 1] - window)
        across = ragged(head, np.maximum(tail - head + 1, 0))
        return np.concatenate([inside, across[self.low[across] < self.place[across]]])


def factored(symbols: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, piece: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of windows that start earlier in the block; strings are parsed in pieces of so many windows (0: whole)."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none
    windows = np.maximum(np.diff(first) - window + 1, 0)
    piece = piece or int(windows.max())
    if not piece:
        return none, none
    ref = Reference(symbols, first, doc, start, window, piece + window - 1)
    n = -(-windows // piece)
    part = ragged(np.zeros(len(n), np.int64), n)
    string = np.repeat(np.arange(len(n)), n)
    lo = ref.first[string] + part * piece
    count = np.minimum(piece, windows[string] - part * piece)
    # A piece none of whose windows recurs in the block has no factor of interest.
    some = np.concatenate([[0], np.cumsum(ref.again)])
    use = some[lo + count] > some[lo]
    at = ref.repeats(lo[use], (lo + count + window - 1)[use], window)
    string = np.searchsorted(ref.first, at, "right") - 1
    return string, at - ref.first[string]


def factored_texts(symbols: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return factored(symbols, first, doc, start, window, PIECE)


def deduplicated(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), spans array<struct<start, end>> of removed words."""
    spans, plan = passages.repeated_windows(docs, word_symbols, factored_texts, factored, window, GRAM, np.uint64)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:long,end:long>>"
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, offs = text_buffer(batch.column("text"))
        starts, ends, first = word_spans(data, offs)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        gone = np.zeros(len(starts), bool)
        if blobs:
            gone = passages.covered(passages.ByDoc(blobs, passages.SPAN), ids, first, window)
        keep = np.flatnonzero(~gone)
        # Kept words with one blank after each, gathered at once.
        size = ends[keep] - starts[keep] + 1
        at = ragged(starts[keep], size)
        last = np.cumsum(size) - 1
        out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
        out[last] = 32
        edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(keep, first)]
        raw = out.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        n = np.diff(first)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        lists: list[list] = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist() if gone[a:b].any() else []
            lists.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array([t.decode() for t in texts], pa.string()), pa.array(lists, place)], ["doc_id", "n_words", "n_removed", "text", "spans"])

    out = passages.with_texts(docs.where("doc_id IS NOT NULL"), spans, plan, work, kind)

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from work(b, [])

    return out.unionByName(docs.where("doc_id IS NULL").mapInArrow(alone, kind))


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_words, n_removed, kept_sha256."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))



OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\t-\r]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM d
), v AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h, n FROM w
), k AS (
  SELECT doc_id, pos, h FROM v WHERE pos + 19 <= n
), f AS (
  SELECT h, min({'d': doc_id, 'p': pos}) AS first FROM k GROUP BY h HAVING count(*) > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM k JOIN f USING (h) WHERE doc_id <> first.d OR pos <> first.p
), s AS (
  SELECT w.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
