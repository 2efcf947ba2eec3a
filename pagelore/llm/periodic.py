"""Operator 13, periodic run detection by the linear tandem-repeat method of Gusfield and Stoye.

A batch of texts is one string of words in which each text ends with a symbol of
its own. Its suffix tree is kept as a suffix array with the intervals of common
prefixes (an interval and a depth are a place in the tree). Then

1. the string falls into Lempel-Ziv blocks, and extensions to both sides of the
   blocks' bounds give squares that cover the leftmost occurrence of every one;
2. each primitive square found is marked at its place in the tree; from there the
   walk takes the suffix link and looks for the square's next rotation, in the same
   occurrence or in another that branches with its first word, until it meets a
   mark: the marks are the complete vocabulary;
3. the suffixes below a mark are where its square occurs. Places next to each other
   of one period merge into a run, and runs that are long enough stay.

A run of period q and ``times`` * q words or more has words behind its first q that
all occurred at most q words before. Only stretches of a text where that holds for
some scale of q are put into the string; all others can't hold such a run.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared as they are, by their bytes.

Nulls: a null text has no words; a null doc_id stays. Empty texts have no run.
Repeated rows come out once each, ties need no order, other columns are not read
and may have any name. An empty table gives an empty result. A text is held whole
by one task; a stretch that may hold a run takes some 300 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import bounded_batches, lean, ragged, text_buffer, word_spans
from pagelore.llm.suffixes import Suffixes, along

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Words of stretches that one string holds, but for a longer single stretch.
STRING = 1 << 17

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the bytes are."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, size)]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def stretches(codes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the parts of texts that may hold a run; what lies outside of them holds none."""
    n = len(codes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = text << 32 | codes
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    gap = np.full(n, n + 1)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    edge = np.zeros(n + 1, np.int64)
    longest, scale = int(np.diff(first).max(initial=0)), 1
    while True:
        # Periods over half the scale, up to the scale.
        lowest = scale // 2 + 1
        if lowest * times > longest:
            break
        need = max(least - scale, lowest * (times - 1))
        near = np.concatenate([[0], (gap <= scale).view(np.int8), [0]])
        turn = np.flatnonzero(near[1:] != near[:-1])
        a, b = turn[::2], turn[1::2]
        use = b - a >= need
        a, b = a[use], b[use]
        np.add.at(edge, np.maximum(a - scale, first[text[a]]), 1)
        np.add.at(edge, b, -1)
        scale *= 2
    inside = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
    cut = inside[1:] != inside[:-1]
    begin, end = cut[:-1] & inside[1:-1], cut[1:] & inside[1:-1]
    bound = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)]
    bound = bound[inside[bound] & inside[bound + 1]]  # neighbours on both sides of a text's end
    begin[bound], end[bound - 1] = True, True
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Tree:
    """Suffix array, common prefixes and extensions of a string whose last symbol is its own."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.codes, n = codes, len(codes)
        self.n = n
        suffixes = Suffixes(codes, 1, along(n))
        #: By power of two: equal where that many symbols from there on are.
        self.same = [suffixes.rank.astype(np.int32)]
        while len(suffixes.open) and 1 << len(self.same) <= 2 * longest:
            self.same.append(suffixes.to(1 << len(self.same)).rank.astype(np.int32))
        self.order = suffixes.to(n).order
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        #: Common prefix of each suffix of the order with the one before, and least ones of 2**k neighbours.
        common = np.concatenate([[0], self.forward(self.order[:-1], self.order[1:])]).astype(np.int32)
        self.least = [common]
        while 2 << (len(self.least) - 1) <= n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and b on are the same (a and b differ)."""
        a, b, top = a.copy(), b.copy(), self.n - 1
        began = a.copy()
        for k in range(len(self.same) - 1, -1, -1):
            rank = self.same[k]
            for _ in range(2 if k == len(self.same) - 1 else 1):
                step = (rank[np.minimum(a, top)] == rank[np.minimum(b, top)]).astype(np.int64) << k
                a += step
                b += step
        return a - began

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a and b are the same (a < b; a may be -1)."""
        a, b = a.copy(), b.copy()
        began = a.copy()
        for k in range(len(self.same) - 1, -1, -1):
            rank, size = self.same[k], 1 << k
            for _ in range(2 if k == len(self.same) - 1 else 1):
                fits = a >= size - 1
                step = (fits & (rank[np.where(fits, a - size + 1, 0)] == rank[np.where(fits, b - size + 1, 0)])).astype(np.int64) << k
                a -= step
                b -= step
        return began - a

    def below(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval (both ends in it) of the suffixes that share ``depth`` symbols with the suffix at each place."""
        low = self.slot[at]
        high = low.copy()
        for k in range(len(self.least) - 1, -1, -1):
            table, size = self.least[k], 1 << k
            down = low - size + 1
            ok = (down >= 1) & (table[np.maximum(down, 0)] >= depth)
            low = np.where(ok, low - size, low)
            up = high + 1
            ok = (up + size <= self.n) & (table[np.minimum(up, len(table) - 1)] >= depth)
            high = np.where(ok, high + size, high)
        return low, high

    def branch(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals alike for ``depth`` symbols: the first suffix that goes on with the symbol, and whether there is one."""
        a, b = low.copy(), high + 1
        for _ in range(int((high - low + 1).max(initial=0)).bit_length()):
            m = (a + b) >> 1
            live = a < b
            less = live & (self.codes[np.minimum(self.order[np.minimum(m, self.n - 1)] + depth, self.n - 1)] < symbol)
            a = np.where(less, m + 1, a)
            b = np.where(live & ~less, m, b)
        at = self.order[np.minimum(a, self.n - 1)]
        return at, (a <= high) & (self.codes[np.minimum(at + depth, self.n - 1)] == symbol)

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks begin, and the end: each is the longest factor that also starts earlier, or one symbol."""
        before, behind = np.full(self.n, -1), np.full(self.n, -1)
        stack: list[int] = []
        left, right = [-1] * self.n, [-1] * self.n
        for p in self.order.tolist():  # nearest neighbours in the order that start earlier
            while stack and stack[-1] > p:
                right[stack.pop()] = p
            if stack:
                left[p] = stack[-1]
            stack.append(p)
        before, behind = np.array(left), np.array(right)
        size = np.ones(self.n, np.int64)
        for earlier in (before, behind):
            some = np.flatnonzero(earlier >= 0)
            size[some] = np.maximum(size[some], self.forward(earlier[some], some))
        sizes, cut, i = size.tolist(), [], 0
        while i < self.n:
            cut.append(i)
            i += sizes[i]
        return np.array([*cut, self.n])


def primitive(tree: Tree, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the first half of the square is no power of a shorter word."""
    top = int(half.max(initial=1))
    factor = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            some = factor[p * p :: p]
            some[some == np.arange(p * p, top + 1, p)] = p
    good, rest, last = np.ones(len(at), bool), half.copy(), np.zeros_like(half)
    while len(live := np.flatnonzero(good & (rest > 1))):
        p = factor[rest[live]]
        rest[live] //= p
        live, p = live[p != last[live]], p[p != last[live]]
        last[live] = p
        period = half[live] // p
        good[live] = tree.forward(at[live], at[live] + period) < 2 * half[live] - period
    return good


def leftmost(tree: Tree, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and half length of primitive squares that cover the leftmost occurrence of every one whose half is not over ``longest``."""
    cut = tree.blocks()
    h, h1, h2 = cut[:-1], cut[1:], np.append(cut[2:], cut[-1])
    # From the bound behind a block, to its left: squares that begin in it.
    count = np.minimum(h1 - h, longest)
    own = np.repeat(np.arange(len(h)), count)
    k = ragged(np.ones(len(h), np.int64), count)
    b = h1[own]
    use = b < tree.n
    k, b = k[use], b[use]
    q = b - k
    ahead, back = tree.forward(q, b), tree.backward(q - 1, b - 1)
    good = (ahead + back >= k) & (ahead > 0)
    at, half = [np.maximum(q - back, q - k + 1)[good]], [k[good]]
    # From the bound before a block, to its right: squares that begin before it.
    count = np.minimum(h2 - h, longest)
    own = np.repeat(np.arange(len(h)), count)
    k = ragged(np.ones(len(h), np.int64), count)
    b = h[own]
    use = (b > 0) & (b + k < tree.n)
    k, b = k[use], b[use]
    ahead, back = tree.forward(b, b + k), tree.backward(b - 1, b + k - 1)
    good = (ahead + back >= k) & (ahead > 0) & (back > 0)
    at.append(np.maximum(b - back, b - k + 1)[good])
    half.append(k[good])
    place, size = np.concatenate(at), np.concatenate(half)
    good = primitive(tree, place, size)
    return place[good], size[good]


def vocabulary(tree: Tree, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half length of every primitive square of the string and the interval of suffixes that begin with it."""
    at, half = leftmost(tree, longest)
    known = np.zeros(0, np.int64)
    marks: list[Found] = []
    while len(at):
        # The rotations of a square that follow it in this occurrence; all of them, if there are as many as its half is long.
        turns = np.minimum(tree.forward(at, at + half) - half, half - 1)
        place, size = ragged(at, turns + 1), np.repeat(half, turns + 1)
        low, high = tree.below(place, 2 * size)
        key, one = np.unique(size << 32 | low, return_index=True)
        fresh = ~np.isin(key, known, assume_unique=True)
        known = np.concatenate([known, key[fresh]])
        one = one[fresh]
        marks.append((size[one], low[one], high[one]))
        # The suffix link of the last rotation here, where it is new and not the last of all: does another occurrence go on?
        end = np.cumsum(turns + 1) - 1
        new = np.zeros(len(place), bool)
        new[one] = True
        walk = np.flatnonzero((turns < half - 1) & np.isin(size[end] << 32 | low[end], key[fresh]))
        last, half = at[walk] + turns[walk], half[walk]
        low, high = tree.below(last + 1, 2 * half - 1)
        at, found = tree.branch(low, high, 2 * half - 1, tree.codes[last])
        at, half = at[found], half[found]
    size, low, high = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 3
    return size, low, high


def string_runs(codes: np.ndarray, longest: int, least: int, times: int) -> Found:
    """Start, length and period of all runs of a string."""
    tree = Tree(codes, longest)
    half, low, high = vocabulary(tree, max(longest // times, 1))
    place = np.sort(np.repeat(half, high - low + 1) << 32 | tree.order[ragged(low, high - low + 1)])
    if not len(place):
        return place, place, place
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1]))
    tail = np.append(head[1:], len(place)) - 1
    period, start = place[head] >> 32, place[head] & 0xFFFFFFFF
    length = (place[tail] & 0xFFFFFFFF) - start + 2 * period
    good = length >= np.maximum(least, times * period)
    return start[good], length[good], period[good]


def runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> Found:
    """Start (in codes), length and period of the runs of all texts, by start and period; texts lie between first."""
    out: list[Found] = [(np.zeros(0, np.int64),) * 3]
    a, b = stretches(codes, first, least, times) if len(codes) else (np.zeros(0, np.int64),) * 2
    size, lo = b - a, 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), STRING, "right")) + lo)
        n = size[lo:hi] + 1
        at = np.cumsum(n) - n
        words = codes[ragged(a[lo:hi], size[lo:hi])]
        string = np.empty(int(n.sum()), np.int64)
        string[ragged(at, size[lo:hi])] = np.unique(words, return_inverse=True)[1]
        string[at + n - 1] = len(words) + np.arange(hi - lo)
        start, length, period = string_runs(string, int(size[lo:hi].max()), least, times)
        part = np.searchsorted(at, start, "right") - 1
        out.append((start - at[part] + a[lo:hi][part], length, period))
        lo = hi
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> (by start, then period), text (words that no run holds behind its first period, joined by one space)."""
    bounded_batches(docs.sparkSession)
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffer(b.column(1))
            starts, ends, first = word_spans(data, offs)
            at, length, period = runs(word_codes(data, starts, ends), first, least, times)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, at + period, 1)
            np.add.at(edge, at + length, -1)
            keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            # Kept words, each with one blank behind it, gathered at once.
            size = ends[keep] - starts[keep] + 1
            out = data[np.minimum(ragged(starts[keep], size), max(len(data) - 1, 0))]
            out[np.cumsum(size) - 1] = 32
            bound = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(keep, first)]
            raw = out.tobytes()
            texts = [raw[x : max(x, y - 1)] for x, y in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            text = np.searchsorted(first, at, "right") - 1
            cut = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (at - first[text], length, period)], fields=list(item))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), found), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), kind)


def tampered(text: Column, doc_id: Column) -> Column:
    """The contract's test bed: in a tenth of the documents, words from the a-th on repeat the p words there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\t-\r]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int")))
    changed = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256; beside it n_words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = collapsed(docs.select("doc_id", tampered(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
