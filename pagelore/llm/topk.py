"""Operator 2, exact top-k by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size; a block keeps, for each
dimension, its rows sorted by that component. A query walks all lists from the
end that its own component favours, scores every row it meets, and stops when
the sum of the components at the current depth (no unseen row scores more) lies
below its k-th score. Queries stream past their block and are never gathered.

Nulls: a vector that is null, empty, or holds a null or non-finite component
takes no part, as query or as candidate, nor does a row with a null id. Vectors
are compared with vectors of their length only. Rows that repeat an id are
candidates each; a query never meets a row with its own id. Ties go to the
smaller id. Scores are exact; a score that does not fit a long raises an error. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import bounded_batches, parts

#: Rows of a block at most, and at least where more tasks could run.
BLOCK, SMALL_BLOCK = 32_768, 2_048
#: Longs lie below it.
LARGE = 1 << 63


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer rows with a query, exact; one that does not fit a long raises OverflowError."""
    size, mine = np.abs(rows.astype(np.float64)), np.abs(query.astype(np.float64))
    if not len(rows) or size.max() * mine.sum() < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    out = (rows * query).sum(1)  # right modulo 2**64, so right where the score fits
    for i in np.flatnonzero(size @ mine >= 1 << 62).tolist():
        # A component at the end of the longs stands for one that lies beyond.
        score = sum((x if -LARGE < x < LARGE - 1 else x << 64) * y for x, y in zip(rows[i].tolist(), (y if -LARGE < y < LARGE - 1 else y << 64 for y in query.tolist()), strict=True))
        if not -LARGE <= score < LARGE:
            raise OverflowError("a score does not fit a long")
        out[i] = score
    return out


class Block:
    """Sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(-self.rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.rows, self.order, 0)
        self.top = max(abs(int(self.rows.max(initial=0))), abs(int(self.rows.min(initial=0))))
        self.exact = self.rows.astype(np.float64)

    def most(self, query: np.ndarray) -> int:
        """What no score, nor any sum on the way to it, exceeds."""
        return self.top * max(abs(int(query.max())), abs(int(query.min()))) * len(query)

    def score(self, at: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        if self.most(query) < 1 << 53:
            return (self.exact[at] @ query.astype(np.float64)).astype(np.int64)
        return exact_scores(self.rows[at], query)

    def bound(self, depth: int, up: np.ndarray, query: np.ndarray) -> int:
        """What no row that no list has shown down to this depth exceeds."""
        edge = np.where(up, self.sorted[depth - 1], self.sorted[len(self.rows) - depth])
        if self.most(query) < LARGE:
            return int(edge @ query)
        return sum(x * y for x, y in zip(edge.tolist(), query.tolist(), strict=True))

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the id ``own``."""
        n = len(self.rows)
        up = query >= 0
        seen = np.zeros(n, bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, done = min(16, n), 0
        while True:
            # Sorted access: lists run downwards where the query's component is not negative.
            met = np.concatenate([self.order[done:depth, up].ravel(), self.order[n - depth : n - done, ~up].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != own]
            best, score = np.concatenate([best, at]), np.concatenate([score, self.score(at, query)])
            if len(best) > k:
                low = np.partition(score, len(score) - k)[len(score) - k]
                good = score >= low
                best, score = best[good], score[good]
                first = np.lexsort((best, -score))[:k]
                best, score = best[first], score[first]
            if depth == n or seen.all() or (len(best) == k and int(score.min()) > self.bound(depth, up, query)):
                return self.ids[best], score
            done, depth = depth, min(n, depth * 8)


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long, null if the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(embedding) > 0) & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best vectors; both tables have id long, v array<long>."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = lambda df: df.where(F.col("id").isNotNull() & (F.size("v") > 0)).select("id", "v", F.size("v").alias("dims"))
    vectors, queries = usable(vectors), usable(queries)
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK), min(parts(spark), n // SMALL_BLOCK))
    mine = vectors.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("kind", F.lit(0))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    cols = ["block", "dims", "kind", "id", "v"]
    dealt = mine.select(cols).unionByName(asked.select(cols)).repartition(parts(spark), "block").sortWithinPartitions("block", "dims", "kind", "id")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            at, dims, kind, ids = (b.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (dims[1:] != dims[:-1]) | (kind[1:] != kind[:-1])])) if b.num_rows else []
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cut, [*cut[1:], b.num_rows]):
                if (at[lo], dims[lo]) != now:
                    now, held, block = (at[lo], dims[lo]), [], None
                rows = b.column(4).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dims[lo])
                if kind[lo] == 0:
                    held.append((ids[lo:hi], rows))
                elif held:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)))
                    for i, q in zip(ids[lo:hi], rows):
                        found, score = block.search(q, k, i)
                        out.append((np.full(len(found), i), found, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding"), 256).alias("v"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
