"""Operator 3, language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
flattened into a table whose missing transitions start a new phrase. A text is
parsed greedily into longest matches against each automaton; phrases times the
logarithm of the sample's length, per symbol, estimate the cross entropy, and
the lowest wins (ties: the first language by name).

Texts are parsed whole. Segments of all texts advance in lockstep as if each began
a phrase; then each takes up the state in which the segment before it ended and is
parsed again until both parses are in one state, so the phrases are those of an
unbroken parse. A letter that a language's sample lacks never matches there.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is
every text if no labelled text was learned. Rows with a null lang or doc_id are
predicted but teach nothing. Repeated rows are predicted alike. Texts of any
length are parsed to their end. An empty table gives an empty result. Other columns
are not read; ``accepted`` passes them through, whatever their names.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import bounded_batches, held_model, lean, ragged, spans, text_buffer

#: Bounds of the sample that a model is learned from, for each language: rows, and characters that their whole texts may have together.
DOCS_PER_LANGUAGE, SAMPLE_CHARS = 48, 60_000
#: A language all of whose labelled texts have more is learned from so many characters of one of them.
LONGEST = 240_000
#: Symbols that advance in lockstep. No result depends on it.
SEGMENT = 256
#: Bytes of text parsed at a time. No result depends on it.
PIECE = 512 << 10
NEW = np.int32(1 << 30)


@functools.cache
def folded() -> np.ndarray:
    """The lower-case letter of each code point, 0 if it is none."""
    low = (c if not (s := chr(c)).isalpha() else ord(t) if len(t := s.lower()) == 1 else c for c in range(0x110000))
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.fromiter(low, np.uint32, 0x110000), 0).astype(np.uint32)


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, runs of others as one 0, and each text's first (n + 1)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, offs)
    points = folded()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)] if len(data) else np.zeros(0, np.uint32)
    keep = points != 0
    if len(keep):
        again = keep.copy()
        again[1:] |= keep[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        again[heads] = keep[heads]
        keep = again
    before = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], before[at]


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of text; a missing one is NEW plus the state after the symbol alone."""
    most = 2 * len(text) + 3
    to = array("i", [-1]) * (most * width)
    link, length = array("i", [-1]) * most, array("i", [0]) * most
    last, states = 0, 1
    for c in text.tolist():
        cur = states
        states += 1
        length[cur], link[cur] = length[last] + 1, 0
        p = last
        while p >= 0 and to[p * width + c] < 0:
            to[p * width + c] = cur
            p = link[p]
        if p >= 0:
            q = to[p * width + c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = states
                states += 1
                to[clone * width : (clone + 1) * width] = to[q * width : (q + 1) * width]
                length[clone], link[clone] = length[p] + 1, link[q]
                while p >= 0 and to[p * width + c] == q:
                    to[p * width + c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    # One state more, at the start and after a symbol that the sample lacks: whatever follows is a new phrase.
    table = np.frombuffer(to, np.int32).reshape(most, width)[: states + 1].copy()
    del to
    fresh = np.where(table[0] < 0, states, table[0]) + NEW
    missing = table < 0
    table[missing] = np.broadcast_to(fresh, table.shape)[missing]
    return table


class Model:
    """Automata of labelled texts: {language: text}."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = [k for k, _ in sample]
        parts = []
        for _, text in sample:
            raw = np.frombuffer(text.encode(), np.uint8)
            parts.append(letters(raw, np.array([0, len(raw)]))[0])
        seen = np.unique(np.concatenate([*parts, np.zeros(0, np.uint32)]))
        #: Symbols of all samples, 0 for letters that none holds; then, for each language, its own, the last for letters that it lacks.
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.own, self.tables = [], []
        for p in parts:
            letters_ = np.unique(self.symbol[p])
            own = np.full(len(seen) + 1, len(letters_), np.int32)
            own[letters_] = np.arange(len(letters_))
            self.own.append(own)
            self.tables.append(automaton(own[self.symbol[p]], len(letters_) + 1))
        self.logs = np.array([np.log2(len(p) + 2) for p in parts])

    def phrases(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[text, language]: phrases of the greedy parse of each text."""
        n = np.diff(first)
        pieces = -(-n // SEGMENT)
        part = ragged(np.zeros(len(n), np.int64), pieces)
        start = np.repeat(first[:-1], pieces) + part * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(first[1:], pieces) - start)
        out = np.zeros((len(n), len(self.tables)), np.int64)
        some = np.flatnonzero(pieces)
        if not len(some):
            return out
        order = np.argsort(-size, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        # Of each lane, the lane of the next segment of its text, or -1.
        follows = np.full(len(order), -1)
        more = np.flatnonzero(part > 0)
        follows[lane[more - 1]] = lane[more]
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(SEGMENT), "left")
        code = self.symbol[points]
        for k, table in enumerate(self.tables):
            sym, flat, width = self.own[k][code], table.ravel(), np.int32(table.shape[1])
            states, new = np.empty((int(size.max()), len(order)), np.int32), np.zeros((int(size.max()), len(order)), bool)
            state = np.full(len(order), len(table) - 1, np.int32)
            for t in range(len(states)):
                a = active[t]
                step = flat[state[:a] * width + sym[start[:a] + t]]
                new[t, :a] = step >> 30
                state[:a] = states[t, :a] = step & (NEW - 1)
            again = np.flatnonzero(follows >= 0)
            while len(again):  # segments whose predecessor ended in another state than was assumed
                now, at = states[size[again] - 1, again], follows[again]
                ended: list[np.ndarray] = []
                for t in range(len(states)):
                    step = flat[now * width + sym[start[at] + t]]
                    now = step & (NEW - 1)
                    differ = now != states[t, at]
                    new[t, at], states[t, at] = step >> 30, now
                    last = size[at] == t + 1
                    ended.append(at[differ & last])
                    go = differ & ~last
                    now, at = now[go], at[go]
                    if not len(at):
                        break
                again = np.concatenate(ended)
                again = again[follows[again] >= 0]
            out[some, k] = np.add.reduceat(new.sum(0, dtype=np.int64)[lane], (np.cumsum(pieces) - pieces)[some])
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, phrases and symbols of each text, made of about PIECE bytes of text at a time."""
        if len(data) > PIECE and len(offs) > 2:
            found = [self.predict(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in spans(np.diff(offs), PIECE)]
            return [x for f in found for x in f[0]], *(np.concatenate(x) for x in list(zip(*found))[1:])
        points, first = letters(data, offs)
        n = np.diff(first)
        some = np.add.reduceat(np.append(points != 0, False), np.minimum(first[:-1], len(points))) * (n > 0) > 0
        if not self.tables:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n), np.int64), n
        found = self.phrases(points, first)
        cost = found * self.logs / np.maximum(n, 1)[:, None]
        best = cost.argmin(1)
        low = cost[np.arange(len(n)), best]
        cost[np.arange(len(n)), best] = np.inf
        second = cost.min(1) if cost.shape[1] > 1 else np.full(len(n), np.inf)
        score = np.where(some, 1 - low / np.maximum(second, 1e-12), 0.0).clip(0, 1)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], score, found[np.arange(len(n)), best], n


def model(sample: tuple[tuple[str, str], ...]) -> Model:
    return held_model(sample, lambda: Model(sample))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, most_docs: int | None = None, most_chars: int | None = None) -> tuple[tuple[str, str], ...]:
    """The sample: of each language, whole texts of the documents with the lowest hashes, as many as the bounds allow.

    Texts that are longer than the bound alone teach only where a language has no
    other; then one is taken, and of it no more than LONGEST characters.
    """
    most_docs, most_chars = most_docs or DOCS_PER_LANGUAGE, most_chars or SAMPLE_CHARS
    teach = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    teach = teach.select(F.col("lang").cast("string"), F.col("doc_id").cast("string"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    near = Window.partitionBy("lang").orderBy(F.col("size") > most_chars, F.xxhash64("doc_id", F.lit(7)), "doc_id", "mark")
    named = teach.select("lang", "doc_id", "mark", F.length("text").alias("size")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= most_docs)
    fits = named.withColumn("total", F.sum("size").over(Window.partitionBy("lang").orderBy("n"))).where((F.col("total") <= most_chars) | (F.col("n") == 1))
    taken = teach.withColumn("text", F.substring("text", 1, max(LONGEST, most_chars))).join(F.broadcast(fits.select("lang", "doc_id", "mark", "n")), ["lang", "doc_id", "mark"])
    by: dict[str, dict[int, str]] = {}
    for r in taken.dropDuplicates(["lang", "n"]).collect():
        by.setdefault(r.lang, {})[r.n] = r.text
    found = ((k, "\n".join(v[n] for n in sorted(v))) for k, v in sorted(by.items()))
    return tuple((k, t) for k, t in found if any(c.isalpha() for c in t))


def identify(docs: DataFrame, most_docs: int | None = None, most_chars: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases, symbols of every document; the bounds are of the sample to learn from (see ``learn``)."""
    bounded_batches(docs.sparkSession)
    sample = learn(docs, most_docs, most_chars)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, phrases, n = model(sample).predict(*text_buffer(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(phrases, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "phrases", "symbols"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(work, model=True), "doc_id long, held_out boolean, lang_pred string, score double, phrases long, symbols long")


def accepted(docs: DataFrame, most_phrases: float = 0.45, most_docs: int | None = None, most_chars: int | None = None) -> DataFrame:
    """The rows of docs whose text is in a learned language.

    Out go texts without a letter and those whose best parse has over
    ``most_phrases`` phrases a symbol: no language explains them.
    """
    bounded_batches(docs.sparkSession)
    sample, at = learn(docs, most_docs, most_chars), docs.columns.index("text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, _, phrases, n = model(sample).predict(*text_buffer(b.column(at)))
            known = np.array([x != "und" for x in lang], bool)
            yield b.filter(pa.array(known & (phrases <= 1 + most_phrases * n)))

    return docs.mapInArrow(lean(work, model=True), docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
