"""Shared plumbing: tables, work folders, Arrow text buffers, sorted groups, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line contracts: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes and rows, so that a run of very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:  # tests and laptops only
        base = "/tmp/pagelore-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pagelore-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The model that a Python worker holds.
_held: dict[Hashable, object] = {}


def held_model[M](key: Hashable, make: Callable[[], M]) -> M:
    """The model of this key: a worker, which serves many tasks, holds one and gives it up for the next."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def drop_models() -> None:
    _held.clear()


def give_back() -> None:
    """Returns free memory, which allocators else keep for the worker's later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], model: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, whose task begins without an earlier operator's model (unless it uses one) and gives free memory back as it ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            drop_models()
        yield from work(batches)
        give_back()

    return run


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word (n + 1)."""
    inner = ~SPACE[data]
    n = len(data)
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    heads = offs[:-1][offs[:-1] < n]
    begin[heads] = inner[heads]
    end = inner.copy()
    end[:-1] &= ~inner[1:]
    tails = offs[1:][(offs[1:] > offs[:-1])] - 1
    end[tails] = inner[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + l)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def spans(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose cost is about ``most`` at most."""
    if not len(cost):
        return
    total = np.cumsum(cost)
    lo = 0
    while lo < len(cost):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        yield lo, (hi := max(hi, lo + 1))
        lo = hi


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' starts (and the end), from batches sorted by keys.

    Only the group that a batch leaves unfinished is carried over to the next.
    """
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        return np.flatnonzero(new)

    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        head, tail = (tuple(b.column(k)[i].as_py() for k in keys) for i in (0, b.num_rows - 1))
        if held and head == tail == last:
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b])
        at = cuts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at
        held, last = t.slice(at[-1]).to_batches(), tail
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.array([0, t.num_rows])


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of an undirected edge list reaches.

    Alternating large-star and small-star steps over written tables. Each step
    is a partially aggregated minimum and a join whose hot keys AQE can split,
    so a hub needs no task of its own and nothing meets on the driver.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(small, name)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


#: Odd multipliers of the polynomial hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes (uint64) of byte spans: eight bytes at a time go through a bijective scramble, spans over 64 bytes through XXH64.

    Unlike a polynomial hash this has no sequences that collide whatever the multiplier.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(BASES[0]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = np.flatnonzero((size > 0) & (size <= 64))
    done = 0
    while len(at):
        left = size[at] - done
        lane = np.ascontiguousarray(lanes[starts[at] + done]).view(np.uint64).ravel()
        short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        h[at] = mix((h[at] ^ (lane << short >> short)) * np.uint64(BASES[0]))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 1)
    return h


class SpanHash:
    """Hashes of spans of a sequence of symbols, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * np.cumprod(up)[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]
