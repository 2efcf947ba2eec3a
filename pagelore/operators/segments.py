"""The stored full-text index: immutable segments of delta-coded posting blocks with block maxima.

A block holds the postings of one term in one chunk of the slides (chunks go by
the hash of the slide, so no term's block outgrows a chunk). Beside the postings
it carries what bounds every score in it: the largest weighted frequency and the
shortest slide. Ids and places are stored as differences.

A scan adds a segment; the slides that it replaces stay in older segments until
they are merged, but no longer count: a posting counts only while ``lengths`` holds its
slide with the posting's stamp.

A search reads the blocks' bounds first. It scores the most promising chunks, takes
the k-th score from there, and then reads only the chunks whose bounds reach it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators import fulltext
from pagelore.plans.query_parser import Parsed
from pagelore.schema import BM25_B, BM25_K1, BM25_WEIGHTS
from pagelore.store import Store

#: Slides of a chunk, about.
CHUNK = 512
#: Tokens that a task holds of one chunk.
HELD = 1 << 22
#: Chunks that a search scores before it knows a k-th score, beside one for each 64 hits wanted.
FIRST = 8
#: Segments that a scan leaves.
MOST_SEGMENTS = 8
#: Bits of a token's place in its column.
PLACE = 26
#: A bound is raised by this part, so that rounding never hides a hit.
SLACK = 1e-9


def _deltas(values: Column, kind: str) -> Column:
    """The first value and then the differences of neighbours, modulo 2**64 for longs."""
    least = F.lit(-(1 << 63))

    def step(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(values, i - 1)).otherwise(F.lit(0).cast(kind))
        if kind != "bigint":
            return x - before
        # Ids are ascending hashes: only from a negative to a positive one a difference may be too wide.
        return F.when((x < 0) | (before >= 0) | (x < before - least), x - before).otherwise((x + least) - (before - least))

    return F.transform(values, step)


def blocks(rows: DataFrame, stamp: int, chunks: int) -> DataFrame:
    """Posting blocks of rows (slide_id, title, body, notes, deck_title).

    Whole slides come together by chunk, in the only exchange, and are taken apart there: a token never travels alone. A chunk of
    more than HELD tokens gives several blocks of a term, each of other slides.
    """
    columns, weights = list(BM25_WEIGHTS), np.array(list(BM25_WEIGHTS.values()))
    slide = F.col("slide_id").cast("long")
    dealt = rows.select(slide.alias("slide_id"), *columns, F.pmod(F.xxhash64(slide), F.lit(chunks)).cast("int").alias("chunk")).repartition("chunk").sortWithinPartitions("chunk")
    texts = dealt.select("slide_id", "chunk", *[fulltext.text.tokens(c).alias(c) for c in columns])

    def firsts(*keys: np.ndarray) -> np.ndarray:
        """Where a run of equal keys begins."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(new)

    def differences(values: np.ndarray, first: np.ndarray) -> pa.Array:
        out = values.copy()
        out[1:] -= values[:-1]
        out[first] = values[first]
        return pa.array(out)

    def built(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slides = np.concatenate([b.column(0).to_numpy() for b in parts])
        sizes = [np.concatenate([b.column(2 + c).value_lengths().to_numpy() for b in parts]).astype(np.int64) for c in range(len(columns))]
        total = sum(sizes)
        if not total.sum():
            return
        terms = pa.chunked_array([b.column(2 + c).flatten() for c in range(len(columns)) for b in parts], pa.string()).combine_chunks()
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy()
        row = np.concatenate([np.repeat(np.arange(len(slides)), n) for n in sizes])
        place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (c << PLACE) for c, n in enumerate(sizes)]).astype(np.int32)
        order = np.lexsort((place, slides[row], code))
        code, row, place = code[order], row[order], place[order]
        pair = firsts(code, row)  # a term in a slide
        block = firsts(code[pair])
        ids = slides[row[pair]]
        counts = np.diff(np.append(pair, len(code))).astype(np.int32)
        weight = np.add.reduceat(weights[place >> PLACE], pair)
        ends = lambda first, n: pa.array(np.append(first, n).astype(np.int32))
        n = np.diff(np.append(block, len(pair))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            coded.dictionary.take(pa.array(code[pair[block]])), pa.array(np.full(len(block), chunk, np.int32)), pa.array(n),
            pa.array(np.maximum.reduceat(weight, block)), pa.array(np.minimum.reduceat(total[row[pair]], block)),
            pa.ListArray.from_arrays(ends(block, len(pair)), differences(ids, block)),
            pa.ListArray.from_arrays(ends(block, len(pair)), pa.array(counts)),
            pa.ListArray.from_arrays(ends(pair[block], len(code)), differences(place, pair)),
        ], ["term", "chunk", "n", "most", "shortest", "ids", "counts", "places"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0
        for b in batches:
            tokens = np.cumsum(sum(b.column(2 + c).value_lengths().to_numpy().astype(np.int64) for c in range(len(columns))))
            lo = 0
            for hi in [*firsts(b.column(1).to_numpy())[1:].tolist(), b.num_rows] if b.num_rows else []:
                chunk = b.column(1)[lo].as_py()
                if parts and (chunk != now or held > HELD):
                    yield from built(now, parts)
                    parts, held = [], 0
                now = chunk
                parts.append(b.slice(lo, hi - lo))
                held += int(tokens[hi - 1] - (tokens[lo - 1] if lo else 0))
                lo = hi
        if parts:
            yield from built(now, parts)

    made = texts.mapInArrow(work, "term string, chunk int, n int, most double, shortest long, ids array<long>, counts array<int>, places array<int>")
    return made.select("term", "chunk", F.lit(stamp).cast("long").alias("stamp"), "n", "most", "shortest", "ids", "counts", "places")


def tokens_of(found: DataFrame) -> DataFrame:
    """slide_id, n_tokens of the slides that these blocks hold: summed where the blocks lie first, a chunk lies together."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, at = np.unique(restart(b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy().astype(np.int64)), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, b.column(1).flatten().to_numpy(), len(ids)).astype(np.int64))], ["slide_id", "n"])

    return found.select("ids", "counts").mapInArrow(work, "slide_id long, n long").groupBy("slide_id").agg(F.sum("n").alias("n_tokens"))


def restart(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each of the parts."""
    total = np.cumsum(values)
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, total[begin - 1], 0)
    return total - np.repeat(before, sizes)


def encoded(each: DataFrame, stamp: int, chunks: int) -> DataFrame:
    """Blocks of (slide_id, n_tokens, term, places): a group is one term in one chunk."""
    weights = F.array(*[F.lit(w) for w in BM25_WEIGHTS.values()])
    weight = F.aggregate("places", F.lit(0.0), lambda a, p: a + F.get(weights, F.shiftright(p, PLACE)))
    rows = each.withColumn("chunk", F.pmod(F.xxhash64("slide_id"), F.lit(chunks)).cast("int"))
    item = F.struct("slide_id", _deltas(F.col("places"), "int").alias("places"))
    out = rows.groupBy("term", "chunk").agg(F.sort_array(F.collect_list(item)).alias("x"), F.count(F.lit(1)).cast("int").alias("n"), F.max(weight).alias("most"), F.min("n_tokens").alias("shortest"))
    ids = F.transform("x", lambda x: x["slide_id"])
    return out.select("term", "chunk", F.lit(stamp).cast("long").alias("stamp"), "n", "most", "shortest", _deltas(ids, "bigint").alias("ids"), F.transform("x", lambda x: F.size(x["places"])).alias("counts"), F.flatten(F.transform("x", lambda x: x["places"])).alias("places"))


def decoded(found: DataFrame, places: bool = True) -> DataFrame:
    """slide_id, stamp, term and, unless only slides are asked for, col and pos of every posting of blocks."""
    names = list(BM25_WEIGHTS)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            ids = restart(lists.flatten().to_numpy(), n)
            block = np.repeat(np.arange(b.num_rows), n)
            if not places:
                at = pa.array(block)
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(1).take(at), b.column(0).take(at)], ["slide_id", "stamp", "term"])
                continue
            counts = b.column(3).flatten().to_numpy().astype(np.int64)
            where = restart(b.column(4).flatten().to_numpy().astype(np.int64), counts)
            at = pa.array(np.repeat(block, counts))
            col = pa.DictionaryArray.from_arrays(pa.array((where >> PLACE).astype(np.int8)), pa.array(names)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), b.column(1).take(at), b.column(0).take(at), col, pa.array((where & ((1 << PLACE) - 1)).astype(np.int32))], ["slide_id", "stamp", "term", "col", "pos"])

    columns = ["term", "stamp", "ids"] + ["counts", "places"] * places
    return found.select(columns).mapInArrow(work, "slide_id long, stamp long, term string" + ", col string, pos int" * places)


class Index:
    """The index of a store: tables ``segments``, ``lengths`` and ``meta``."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    # What is kept about the index as a whole

    def _meta(self) -> dict[str, int]:
        return {r.key: r.value for r in self.store.read("meta").collect()}

    def _set(self, **values: int) -> None:
        self.store.replace("meta", None, self.spark.createDataFrame(list(values.items()), self.store.schemas["meta"]), small=True)

    # Changes

    def add(self, rows: DataFrame, replaced: bool) -> None:
        """A new segment of rows; replaced: whether slides of their decks may be in older ones."""
        with self.store.change():
            meta = self._meta()
            chunks = meta.get("index_chunks")
            stamp = meta.get("index_stamp", 0) + 1
            if not chunks:
                chunks = max(1, rows.count() // CHUNK)
            self.store.append("segments", blocks(rows, stamp, chunks), dealt=True)
            # Texts are taken apart once: lengths come from the blocks, and are 0 where a slide is in none.
            held = tokens_of(self.store.read("segments").where(F.col("stamp") == stamp))
            sizes = rows.select("deck_id", F.col("slide_id").cast("long").alias("slide_id")).join(held, "slide_id", "left").select("deck_id", "slide_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.lit(stamp).alias("stamp"))
            self.store.replace("lengths", rows.select("deck_id").distinct(), sizes)
            self._set(index_chunks=chunks, index_stamp=stamp, index_segments=meta.get("index_segments", 0) + 1, index_dead=int(replaced or meta.get("index_dead", 0)))
            if meta.get("index_segments", 0) + 1 > MOST_SEGMENTS:
                self.merge()

    def drop(self, decks: DataFrame) -> None:
        """Slides of these decks (deck_id) count no more."""
        with self.store.change():
            self.store.delete("lengths", decks)
            self._set(index_dead=1)

    def merge(self) -> None:
        """One segment of what still counts, in chunks of the right size again."""
        with self.store.change():
            meta, sizes = self._meta(), self.store.read("lengths")
            stamp, chunks = meta.get("index_stamp", 0) + 1, max(1, sizes.count() // CHUNK)
            places = decoded(self.store.read("segments")).join(sizes.select("slide_id", "stamp", "n_tokens"), ["slide_id", "stamp"])
            number = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(BM25_WEIGHTS) for x in (c, i)]), F.col("col"))
            each = places.groupBy("slide_id", "n_tokens", "term").agg(F.sort_array(F.collect_list((number * F.lit(1 << PLACE) + F.col("pos")).cast("int"))).alias("places"))
            self.store.put("segments", encoded(each, stamp, chunks))
            self.store.put("lengths", sizes.withColumn("stamp", F.lit(stamp).cast("long")))
            self._set(index_chunks=chunks, index_stamp=stamp, index_segments=1, index_dead=0)

    def clear(self) -> None:
        with self.store.change():
            for name in ("segments", "lengths"):
                self.store.put(name, self.store.read(name).limit(0))
            self._set(index_chunks=0, index_segments=0, index_dead=0)

    # Searches

    def _sizes(self) -> DataFrame:
        return self.store.read("lengths").select("slide_id", "n_tokens", "stamp")

    def _alive(self, rows: DataFrame, dead: bool) -> DataFrame:
        return rows.join(self._sizes().select("slide_id", "stamp"), ["slide_id", "stamp"], "left_semi") if dead else rows

    def candidates(self, parsed: Parsed) -> DataFrame:
        """The blocks of all terms that a query may mean: the only ones that are read."""
        wanted = fulltext.phrases(parsed)
        return self.store.read("segments").where(fulltext.term_filter(wanted))

    def matches(self, parsed: Parsed) -> DataFrame:
        """slide_id and score of every slide that the query matches."""
        index = self._alive(decoded(self.candidates(parsed)), bool(self._meta().get("index_dead")))
        return fulltext.match(index, self._sizes(), parsed)

    def top(self, parsed: Parsed, limit: int, admitted: DataFrame | None = None) -> DataFrame:
        """The best ``limit`` of the matches that are admitted (slide_id), best first, ties to the smaller id."""
        within = lambda df: df if admitted is None else df.join(admitted, "slide_id", "left_semi")
        wanted, dead = fulltext.phrases(parsed), bool(self._meta().get("index_dead"))
        if any(len(ts) > 1 or column for ts, column in wanted):
            # How many slides hold a phrase or hold a word in one column is not told by blocks' heads.
            return fulltext.top(within(self.matches(parsed)), limit)
        found, sizes = self.candidates(parsed), self._sizes()
        corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avgdl")).first()
        if not corpus.n:
            return fulltext.top(within(self.matches(parsed)), limit)
        dfs = self._document_frequencies(found, wanted, dead)
        head = self._bounds(found, parsed, wanted, dfs, corpus)
        head = head.orderBy(F.desc("bound"), "chunk")
        first = [r.chunk for r in head.limit(FIRST + limit // 64).collect()]

        def scored(some: DataFrame) -> DataFrame:
            return within(fulltext.match(self._alive(decoded(some), dead), sizes.drop("stamp"), parsed, dfs=dfs, corpus=corpus))

        best = fulltext.top(scored(found.where(F.col("chunk").isin(first))), limit).collect() if first else []
        known = self.spark.createDataFrame([(r.slide_id, r.score) for r in best], "slide_id long, score double")
        more = head.where(~F.col("chunk").isin(first)) if first else head
        if len(best) == limit and limit:
            more = more.where(F.col("bound") * (1 + SLACK) >= best[-1].score)
        rest = scored(found.join(more.select("chunk"), "chunk", "left_semi"))
        return fulltext.top(known.unionByName(rest.select("slide_id", "score")), limit)

    def _document_frequencies(self, found: DataFrame, wanted: list, dead: bool) -> dict[int, int]:
        """Of each word of a query, how many slides hold it: from the heads where it means one term, else from ids, never from places."""
        roles = [F.startswith("term", F.lit(ts[0])) for ts, _ in wanted]
        heads = found.agg(*[F.count_distinct(F.when(r, F.col("term"))).alias(f"t{p}") for p, r in enumerate(roles)], *[F.coalesce(F.sum(F.when(r, F.col("n"))), F.lit(0)).alias(f"n{p}") for p, r in enumerate(roles)]).first()
        out = {p: heads[f"n{p}"] for p in range(len(wanted))}
        many = [p for p in out if dead or heads[f"t{p}"] > 1]
        if many:
            ids = self._alive(decoded(found.where(reduce(lambda a, b: a | b, [roles[p] for p in many])), places=False), dead)
            got = ids.agg(*[F.count_distinct(F.when(roles[p], F.col("slide_id"))).alias(f"n{p}") for p in many]).first()
            out |= {p: got[f"n{p}"] for p in many}
        return out

    def _bounds(self, found: DataFrame, parsed: Parsed, wanted: list, dfs: dict[int, int], corpus) -> DataFrame:
        """chunk and bound: no slide of the chunk scores more; chunks without the words that some group needs are left out."""
        # A slide is in one segment, so of one term the largest block counts; terms of one prefix add up.
        terms = found.groupBy("chunk", "term").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        role = lambda p: F.startswith("term", F.lit(wanted[p][0][0]))
        chunk = terms.groupBy("chunk").agg(F.min("shortest").alias("shortest"), *[F.coalesce(F.sum(F.when(role(p), F.col("most"))), F.lit(0.0)).alias(f"f{p}") for p in range(len(wanted))])
        norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("shortest") / F.lit(corpus.avgdl))
        needs = fulltext.condition(Parsed([type(g)(g.required) for g in parsed.groups]), wanted)
        parts = [fulltext.idf(F.lit(corpus.n), F.lit(dfs[p])) * F.col(f"f{p}") * (BM25_K1 + 1) / (F.col(f"f{p}") + norm) for p in fulltext.scored(parsed, wanted)]
        return chunk.where(needs).select("chunk", reduce(lambda a, b: a + b, parts).alias("bound"))
