"""Operator 12, hard-negative mining over one-dimensional distance keys.

Every vector x gets one more component, sqrt(M - |x|^2), so that all have the
same length; a query gets a zero. Then a higher inner product is a smaller
distance. Pivots are fitted on a bounded sample (SAMPLE rows, by hash); each row
is stored under its nearest pivot with its distance from it, sorted by (pivot,
distance), in blocks: ranges of distances of one pivot. A row whose distance from
the pivot differs from the query's by d is d away from the query at least. So a
block is searched from the query's own distance outwards, in growing intervals
(annuli around the pivot), until no row beyond them can reach the k-th score.
A query first visits one block; with the k-th score from there it visits only the
blocks whose intervals may hold a better row. All rows are indexed and results
are exact: the sample decides the cost only.

An anchor's positives are its best rows of the same label; the negatives for a
positive are the best rows of other labels whose scores lie between two fractions
of the positive's.

Nulls: a row with a null id or label, or a vector that is null, empty or holds a
null or non-finite component takes no part. Vectors are compared with vectors of
their length only. An anchor never meets a row with its own id. Rows that repeat
an id are candidates each; equal rows are one anchor. Ties go to the smaller id.
Scores are exact; a score that does not fit a long raises an error. Very long
vectors and large groups of equal vectors are dealt over blocks by the hash of the id.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import bounded_batches, lean, parts, work_path
from pagelore.llm.topk import exact_scores, scaled

#: Rows that pivots are fitted on, pivots of each length of vectors, rows of a block (about), least rows where more tasks could run.
SAMPLE, PIVOTS, BLOCK, SMALL_BLOCK = 4096, 32, 16_384, 2_048
#: Rows that a search looks at first, on each side.
STEP = 128
#: Part of a length that rounding may move a distance by.
SLACK = 1e-9
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def pivots(rows: np.ndarray, most: float, n: int) -> np.ndarray:
    """Centres of the sample, augmented: farthest points first, then moved to their groups' means."""
    x = augmented(rows, most)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centre = x[chosen]
    for _ in range(4):
        near = nearest_pivot(x, centre)[0]
        for i in np.unique(near).tolist():
            centre[i] = x[near == i].mean(0)
    return centre


def augmented(rows: np.ndarray, most: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def nearest_pivot(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivot and distance of each augmented row."""
    square = (x * x).sum(1)[:, None] - 2 * (x @ centre.T) + (centre * centre).sum(1)
    near = square.argmin(1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(1))


def matrices(ids: np.ndarray, col: pa.Array, dims: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield at, col.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)


class Index:
    """Blocks of rows sorted by (pivot, distance), as a table in the shared folder; their bounds (some 40 bytes for a block of rows) go with the tasks."""

    def __init__(self, rows: DataFrame):
        """rows: id long, label long, v array<long>."""
        spark = rows.sparkSession
        self.n, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(0.0))).first()
        self.most = float(most)
        sample: dict[int, list] = {}
        for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect():
            sample.setdefault(len(r.v), []).append(r.v)
        self.pivots = {d: pivots(np.array(x), self.most, max(1, min(PIVOTS, len(x) // 16))) for d, x in sample.items()}
        block = max(1, min(BLOCK, max(SMALL_BLOCK, self.n // max(parts(spark), 1))))
        placed = rows.mapInArrow(lean(self._placed), "dims int, pivot int, distance double, id long, label long, v array<long>")
        most_ranges = max(1, -(-self.n // block))
        share = F.percentile_approx("distance", [(i + 1) / most_ranges for i in range(most_ranges)], 10_000)
        self.cuts = {}
        for r in placed.groupBy("dims", "pivot").agg(F.count(F.lit(1)).alias("n"), share.alias("cuts")).collect():
            own = -(-r.n // block)
            at = [round((i + 1) * most_ranges / own) - 1 for i in range(own - 1)]
            self.cuts[r.dims, r.pivot] = np.unique(np.array([r.cuts[i] for i in at], np.float64))
        ranged = placed.mapInArrow(lean(self._ranged), "dims int, pivot int, range int, distance double, id long, label long, v array<long>")
        found = ranged.groupBy("dims", "pivot", "range").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()
        #: Of each range its first block and how many blocks share its rows.
        self.first: dict[tuple[int, int, int], tuple[int, int]] = {}
        bounds: dict[int, list[tuple]] = {}
        total = 0
        for r in sorted(found, key=lambda r: (r.dims, r.pivot, r.range)):
            share_of = max(1, r.n // block)
            self.first[r.dims, r.pivot, r.range] = (total, share_of)
            bounds.setdefault(r.dims, []).extend((total + i, r.pivot, r.low, r.high) for i in range(share_of))
            total += share_of
        self.bounds = {d: tuple(np.array(x) for x in zip(*b, strict=True)) for d, b in bounds.items()}
        path = work_path(spark, "annuli")
        ranged.mapInArrow(lean(self._blocked), "block int, pivot int, distance double, id long, label long, v array<long>").repartition(parts(spark), "block").sortWithinPartitions("block", "distance").write.parquet(path)
        self.table = spark.read.parquet(path)

    def __getstate__(self) -> dict:
        """What tasks need: the bounds, not the table."""
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def pivots_of(self, dims: int) -> np.ndarray:
        """A length that the sample missed has one pivot, the origin: nothing is ruled out there."""
        return self.pivots.get(dims, np.zeros((1, dims + 1)))

    def _placed(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            pivot, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, rows in matrices(b.column(0), b.column(2), dims):
                pivot[at], distance[at] = nearest_pivot(augmented(rows, self.most), self.pivots_of(rows.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(distance), b.column(0), b.column(1), b.column(2)], ["dims", "pivot", "distance", "id", "label", "v"])

    def _ranged(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, pivot, distance = (b.column(i).to_numpy() for i in range(3))
            out = np.zeros(b.num_rows, np.int32)
            for d, p in {*zip(dims.tolist(), pivot.tolist(), strict=True)}:
                at = np.flatnonzero((dims == d) & (pivot == p))
                out[at] = np.searchsorted(self.cuts[d, p], distance[at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), *(b.column(i) for i in range(2, 6))], ["dims", "pivot", "range", "distance", "id", "label", "v"])

    def _blocked(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            first, share = np.array([self.first[k] for k in keys], np.int64).reshape(-1, 2).T
            # Rows of one place are dealt evenly by a scramble of their ids.
            mixed = (b.column(4).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = (first + (mixed % share.astype(np.uint64)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(b.column(i) for i in (1, 3, 4, 5, 6))], ["block", "pivot", "distance", "id", "label", "v"])

    # What scores a distance from the query allows

    def highest(self, square: float, distance: np.ndarray | float, reach: float) -> np.ndarray | float:
        """No row at least so far from the query scores more; reach: a length that rounding is measured by."""
        d = np.maximum(np.asarray(distance) - SLACK * reach, 0)
        return (square + self.most - d * d) / 2 + SLACK * (square + self.most)

    def lowest(self, square: float, distance: np.ndarray, reach: float) -> np.ndarray:
        d = distance + SLACK * reach
        return (square + self.most - d * d) / 2 - SLACK * (square + self.most)

    def visits(self, v: np.ndarray, caps: np.ndarray, floors: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        """The block that a query visits first, or, with the scores ``known`` from there, the others that may hold better rows."""
        if len(v) not in self.bounds:
            return np.zeros(0, np.int64)
        block, pivot, low, high = self.bounds[len(v)]
        q = np.append(v.astype(np.float64), 0)
        own = np.sqrt(((self.pivots_of(len(v)) - q) ** 2).sum(1))[pivot.astype(np.int64)]
        square, reach = float(q @ q), float(own.max() + high.max())
        least, most = np.maximum(np.maximum(low - own, own - high), 0), own + high
        # A row some way out at a right angle is the likeliest; nothing but the cost depends on it.
        target = np.sqrt(max(square + self.most - 2 * float(min(caps[0], square)), 0)) if caps[0] < HIGH else 0
        home = np.lexsort((block, np.abs(np.sqrt(own * own + ((low + high) / 2) ** 2) - target), least if caps[0] == HIGH else np.zeros(len(block))))[0]
        if known is None:
            return block[home : home + 1]
        top, bottom = self.highest(square, least, reach)[:, None], self.lowest(square, most, reach)[:, None]
        use = ((top >= np.maximum(known, floors)) & (bottom <= caps)).any(1)
        use[home] = False
        return block[use]


class Block:
    """Rows of one block by distance, and the search from a query's distance outwards."""

    def __init__(self, index: Index, pivot: int, distance: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.index, self.distance, self.ids, self.labels, self.rows = index, distance, ids, labels, rows
        self.centre = index.pivots_of(rows.shape[1])[pivot]
        self.met = 0

    def search(self, v: np.ndarray, own_id: int, label: int, same: bool, caps: np.ndarray, floors: np.ndarray, known: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Slot, ids and scores of the k best rows of each slot (a highest and a lowest score); rows below the scores known are left out."""
        n = len(self.ids)
        q = np.append(v.astype(np.float64), 0)
        own = float(np.sqrt(((self.centre - q) ** 2).sum()))
        square, reach = float(q @ q), own + float(self.distance[-1])
        lo = hi = int(np.searchsorted(self.distance, own))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in caps]
        need = np.maximum(known, floors).astype(np.float64)
        step = STEP
        while True:
            a, b = max(0, lo - step), min(n, hi + step)
            at = np.concatenate([np.arange(a, lo), np.arange(hi, b)])
            lo, hi, step = a, b, step * 8
            self.met += len(at)
            at = at[((self.labels[at] == label) == same) & (self.ids[at] != own_id)]
            score = exact_scores(self.rows[at], v)
            for s, (cap, floor) in enumerate(zip(caps.tolist(), np.maximum(known, floors).tolist(), strict=True)):
                use = (score <= cap) & (score >= floor)
                ids, scores = np.concatenate([best[s][0], self.ids[at[use]]]), np.concatenate([best[s][1], score[use]])
                if len(ids) > k:
                    good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[good], scores[good]
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                best[s] = ids, scores
                if len(scores) == k:
                    need[s] = max(need[s], float(scores.min()))
            left = own - self.distance[lo - 1] if lo else np.inf
            right = self.distance[hi] - own if hi < n else np.inf
            if min(left, right) == np.inf or (self.index.highest(square, min(left, right), reach) < need).all():
                return [(s, *x) for s, x in enumerate(best)]


def found_in(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """own, key, slot, vec_id, score of the asks in the blocks they name."""
    spark = asks.sparkSession
    none = {"caps": F.lit(None).cast("array<long>"), "floors": F.lit(None).cast("array<long>"), "known": F.lit(None).cast("array<long>"), "key": F.lit(0).cast("long")}
    mine = index.table.withColumns(none).withColumn("kind", F.lit(0))
    asks = asks.withColumnRenamed("own", "id").withColumn("kind", F.lit(1)).withColumn("pivot", F.lit(-1)).withColumn("distance", F.lit(0.0))
    cols = ["block", "kind", "pivot", "distance", "id", "key", "label", "v", "caps", "floors", "known"]
    dealt = mine.select(cols).unionByName(asks.select(cols)).repartition(parts(spark), "block").sortWithinPartitions("block", "kind", "distance")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = -1, [], None
        for b in batches:
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            out: list[tuple] = []
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])])) if b.num_rows else np.zeros(0, int)
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if at[lo] != now:
                    now, held, block = at[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held).combine_chunks()
                    col = lambda i, t=t: t.column(i).combine_chunks()
                    n = t.num_rows
                    block = Block(index, int(col(2)[0].as_py()), col(3).to_numpy(), col(4).to_numpy(), col(6).to_numpy(), col(7).flatten().to_numpy().reshape(n, -1))
                    held = []
                for j in range(part.num_rows):
                    own, key, label = (part.column(i)[j].as_py() for i in (4, 5, 6))
                    v, caps, floors, known = (part.column(i)[j].values.to_numpy() for i in (7, 8, 9, 10))
                    for s, ids, score in block.search(v, own, label, same, caps, floors, known, k):
                        out.append((np.full(len(ids), own), np.full(len(ids), key), np.full(len(ids), s, np.int32), ids, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["own", "key", "slot", "vec_id", "score"])

    return dealt.mapInArrow(lean(work), "own long, key long, slot int, vec_id long, score long")


def best_rows(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """own, key, slot, rank, vec_id, score: the k best rows of each slot of each ask (own id, key, label, v, caps, floors)."""
    spark = asks.sparkSession
    bounded_batches(spark)
    kind = "block int, own long, key long, label long, v array<long>, caps array<long>, floors array<long>, known array<long>"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, ask, known = [], [], []
            for j in range(b.num_rows):
                v, caps, floors = (b.column(i)[j].values.to_numpy() for i in (3, 4, 5))
                seen = b.column(6)[j].values
                at = index.visits(v, caps, floors, None if seen is None else seen.to_numpy())
                block.append(at)
                ask.append(np.full(len(at), j))
                known.append(pa.array(np.full(len(caps), LOW)) if seen is None else seen)
            at = pa.array(np.concatenate(ask)) if ask else pa.array([], pa.int64())
            lists = list_of(known)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block).astype(np.int32)) if block else pa.array([], pa.int32()), *(b.column(i).take(at) for i in range(6)), lists.take(at)], ["block", "own", "key", "label", "v", "caps", "floors", "known"])

    cols = ["own", "key", "label", "v", "caps", "floors"]
    path = work_path(spark, "first-blocks")
    found_in(index, asks.select(*cols, F.lit(None).cast("array<long>").alias("known")).mapInArrow(lean(deal), kind), k, same).write.parquet(path)
    first = spark.read.parquet(path)
    # The k-th score of each slot, or the lowest long where there are fewer.
    last = first.groupBy("own", "key", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    last = last.groupBy("own", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "low"))).alias("last"))  # as many as slots
    known = F.transform(F.sequence(F.lit(0), F.size("caps") - 1), lambda i: F.coalesce(F.try_element_at("last", i), F.lit(LOW)))
    again = asks.select(cols).join(last, ["own", "key"], "left").select(*cols, known.cast("array<long>").alias("known"))
    both = first.unionByName(found_in(index, again.mapInArrow(lean(deal), kind), k, same))
    rank = F.row_number().over(Window.partitionBy("own", "key", "slot").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def list_of(arrays: list[pa.Array]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays([a.cast(pa.int64()) for a in arrays]) if arrays else pa.array([], pa.int64()))


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both tables have id long, label long, v array<long>.

    For each anchor and each of its positives the best rows of other labels, scored from low to high parts of the positive's score.
    """
    spark = rows.sparkSession
    usable = lambda df: df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast("long"), F.col("label").cast("long"), "v")
    rows = usable(rows)
    asked = usable(anchors).distinct().withColumnRenamed("id", "own").withColumn("key", F.xxhash64("own", "label", "v"))
    index = Index(rows)
    everything = asked.withColumn("caps", F.array(F.lit(HIGH))).withColumn("floors", F.array(F.lit(LOW)))
    path = work_path(spark, "positives")
    best_rows(index, everything, positives, same=True).select("own", "key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(path)
    pos = spark.read.parquet(path)
    part = lambda x, of: F.col(x).cast("decimal(38,0)") * of[0]
    # Whole numbers: the least score not under the lower part, the greatest not over the upper.
    lowest = F.ceil(part("positive_score", low) / F.lit(low[1]).cast("decimal(38,0)")).cast("long")
    highest = F.floor(part("positive_score", high) / F.lit(high[1]).cast("decimal(38,0)")).cast("long")
    slots = pos.select("own", "key", lowest.alias("floor"), highest.alias("cap")).where("floor <= cap").distinct()
    # Highest first; there are no more slots than positives.
    slots = slots.groupBy("own", "key").agg(F.sort_array(F.collect_list(F.struct("cap", "floor")), asc=False).alias("slots"))
    asks = asked.join(slots, ["own", "key"]).select("own", "key", "label", "v", F.col("slots.cap").alias("caps"), F.col("slots.floor").alias("floors"), "slots")
    neg = best_rows(index, asks, negatives, same=False)
    place = slots.select("own", "key", F.posexplode("slots").alias("slot", "s")).select("own", "key", "slot", "s.cap", "s.floor")
    neg = neg.join(place, ["own", "key", "slot"]).select("own", "key", "cap", "floor", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = pos.withColumn("floor", lowest).withColumn("cap", highest)
    return pos.join(neg, ["own", "key", "floor", "cap"]).select(F.col("own").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col("embedding"), 256).alias("v"))
    return mined(rows, rows.where(F.col("id") % 100 == 0))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), a AS (
  SELECT *, row_number() OVER () AS a FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)
), s AS (
  SELECT a.a, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.v, v.v)::BIGINT AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.v) = len(v.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM n WHERE rank <= 10
"""
