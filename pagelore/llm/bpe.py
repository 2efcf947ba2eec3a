"""Operator 6, byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression: every code point becomes a symbol
(its class and what follows it), symbols are functions on eight states, and an
associative scan over those functions gives the state before each code point
and so the boundaries. Equal slices of a batch are merged once, through a
cache; byte offsets of the ids are kept for decoding.

Nulls: a null text encodes as the empty one (no ids). Any row is encoded by
itself, so repeated rows and null doc_ids need no rule; long texts are scanned
in lanes and merged with a heap.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import BASES, SpanHash, bounded_batches, held_model, lean, ragged, spans, text_buffer

#: The pre-tokenisation that the scan below implements, and the code points of \s.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SHORT, LONG, JOIN, LAST, INNER = range(8)
FREE, IN_L, IN_N, IN_O, JOINED, IN_W, ONE, TWO = range(8)
LANE = 256
#: Bytes of text that are encoded, and whose slices are hashed, at a time: a worker's arrays stay small whatever a batch holds.
PIECE = 1 << 19


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]; symbols + 8 are the first of their text.

    SHORT and LONG are apostrophes before one or two letters of a contraction,
    JOIN a blank right before something visible, LAST other white space there,
    INNER white space before white space or the end.
    """
    to, new = np.zeros((8, 16), np.uint8), np.ones((8, 16), bool)
    for state in range(8):
        for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            to[state, symbol], new[state, symbol] = run, state not in (run, JOINED)
        for symbol, wait in ((SHORT, ONE), (LONG, TWO)):
            inside = state in (IN_O, JOINED)
            to[state, symbol], new[state, symbol] = IN_O if inside else wait, not inside
        to[state, JOIN], to[state, LAST] = JOINED, FREE
        to[state, INNER], new[state, INNER] = IN_W, state != IN_W
    to[ONE, LETTER], new[ONE, LETTER] = FREE, False
    to[TWO, LETTER], new[TWO, LETTER] = ONE, False
    to[:, 8:], new[:, 8:] = to[FREE, :8], True
    return to, new


TO, NEW = transitions()


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    t[WHITE] = INNER
    return t


def symbols(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The symbol of each code point; heads: where texts begin."""
    sym = classes()[points]
    n = len(points)
    ends = np.zeros(n + 2, bool)
    ends[heads] = ends[n:] = True
    after, second = np.zeros(n + 2, np.uint32), np.zeros(n + 2, np.uint32)
    after[: n - 1] = np.where(ends[1:n], 0, points[1:])
    second[: max(n - 2, 0)] = np.where(ends[1 : max(n - 1, 1)] | ends[2 : max(n, 2)], 0, points[2:]) if n > 2 else 0
    white = sym == INNER
    visible = np.zeros(n, bool)
    visible[: n - 1] = ~white[1:] & ~ends[1:n]
    sym[white & visible] = LAST
    sym[white & visible & (points == 32)] = JOIN
    at = np.flatnonzero(points == 39)
    one, two = after[at], second[at]
    sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    sym[at[pair]] = LONG
    sym[heads] += 8
    return sym


def begins(sym: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each symbol, by an associative scan of transition functions.

    The symbols are dealt to lanes. Each lane's function is composed from its
    end backwards until it is the same for every state (a few symbols), the
    lanes' functions are composed in order, and one lockstep pass follows.
    """
    n = len(sym)
    lanes = -(-n // LANE)
    steps = np.full(lanes * LANE, OTHER + 8, np.uint8)
    steps[:n] = sym
    steps = np.ascontiguousarray(steps.reshape(lanes, LANE).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8))
    for t in range(LANE - 1, -1, -1):
        whole = np.take_along_axis(whole, TO[:, steps[t]].T, 1)
        if (whole == whole[:, :1]).all():
            break
    state = np.zeros(lanes, np.uint8)
    if (whole == whole[:, :1]).all():
        state[1:] = whole[:-1, 0]
    else:
        for i in range(1, lanes):
            state[i] = whole[i - 1, state[i - 1]]
    out = np.empty((LANE, lanes), bool)
    to, new = TO.ravel(), NEW.ravel()
    for t in range(LANE):
        at = state * np.uint8(16) + steps[t]
        out[t] = new[at]
        state = to[at]
    return out.T.reshape(-1)[:n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if gone[i] or j >= n or end[j] != to:
            continue
        end[i], gone[j], after[i] = to, 1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes and decodes batches by the ranks of a tiktoken file."""

    #: Slices that the cache of merged slices holds before it starts anew.
    CACHE = 200_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_id = {i: b for b, i in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, list[int]] = {}

    def slices(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte offsets at which the slices of all texts begin, and the end."""
        if not len(data):
            return np.zeros(1, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.searchsorted(lead, offs[:-1][offs[:-1] < offs[1:]])
        return np.append(lead[begins(symbols(points, heads))], len(data))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """ids of all texts, their byte offsets, the index of each text's first id (n + 1), and each text's ids in decimal, joined by commas."""
        cut = self.slices(data, offs)
        starts, lengths = cut[:-1], np.diff(cut)
        hashed, pieces = np.empty(len(starts), np.uint64), list(spans(lengths, PIECE))
        for lo, hi in pieces:
            a, b = cut[lo], cut[hi]
            hashed[lo:hi] = SpanHash(data[a:b].astype(np.uint64) + np.uint64(1))(starts[lo:hi] - a, cut[lo + 1 : hi + 1] - a)
        hashed += lengths.astype(np.uint64) * np.uint64(BASES[1])
        _, one, same = np.unique(hashed, return_index=True, return_inverse=True)
        alike = np.array_equal(lengths, lengths[one][same])
        if not (alike and all(np.array_equal(data[cut[lo] : cut[hi]], data[ragged(starts[one][same[lo:hi]], lengths[lo:hi])]) for lo, hi in pieces)):
            seen: dict[bytes, int] = {}  # two slices share a hash: go by the bytes
            raw = data.tobytes()
            same = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.int64)
            one = np.unique(same, return_index=True)[1]
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        raw, found = data.tobytes(), []
        for a, b in zip(starts[one].tolist(), cut[one + 1].tolist(), strict=True):
            piece = raw[a:b]
            ids = self.cache.get(piece)
            if ids is None:
                ids = merge(piece, self.ranks)
                if len(piece) <= 256:
                    self.cache[piece] = ids
            found.append(ids)
        count = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int64)
        ids = flat[ragged((np.cumsum(count) - count)[same], count[same])]
        text_slice = np.searchsorted(starts, offs) if len(starts) else np.zeros(len(offs), np.int64)
        first = np.concatenate([[0], np.cumsum(count[same])])[text_slice]
        size = self.size[ids]
        decimal = np.empty(len(found), object)
        decimal[:] = [",".join(map(str, x)).encode() for x in found]
        joined = [b",".join(decimal[same[a:b]].tolist()) for a, b in zip(text_slice[:-1].tolist(), text_slice[1:].tolist(), strict=True)]
        return ids, np.cumsum(size) - size, first, joined

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as uint8."""
        return self.bytes[ragged(self.at[ids], self.size[ids])]


def codec(path: str) -> Codec:
    return held_model(path, lambda: Codec(path))


def row_pieces(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of the rows of a batch (id, text), about PIECE bytes at a time."""
    data, offs = text_buffer(b.column(1))
    for lo, hi in spans(np.diff(offs), PIECE):
        yield b.column(0).slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: ids of each text and the byte at which each begins."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, data, offs in row_pieces(b):
                ids, at, first, _ = codec(path).encode(data, offs)
                at = at - np.repeat(offs[:-1], np.diff(first))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, at)]
                yield pa.RecordBatch.from_arrays([names, *lists], ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work, model=True), "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes: what the ids stand for; null ids give none."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codec(path).decode(np.array(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(work, model=True), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text encoded and decoded again; with_ids adds ids array<int>."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offs in row_pieces(b):
                ids, at, first, joined = codec(path).encode(data, offs)
                back = codec(path).decode(ids)
                ends = np.append(at, len(back))[first]
                sums = [hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))] * with_ids
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.diff(first)), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), pa.array(sums, pa.string()), *lists], names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work, model=True), kind)


def vocabulary() -> str:
    """The rank file of the registered queries; its pattern must be the one the scan implements."""
    import public_tokenizers

    if public_tokenizers.PATTERN.strip() != PATTERN.strip():
        raise ValueError("the tokenizer's pattern is not the one that is implemented")
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
