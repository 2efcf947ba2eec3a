"""Watching folders: what appeared, changed or vanished, given out in batches whose time runs from the first event.

``Watch.poll`` lists a root, compares the listing with the one before by joins, and
appends the differences as events; a heartbeat carries the time on when nothing
happened. A stream over the events keeps, for each root, what is pending and a
deadline: the first event sets it, later ones leave it where it is, and when the
watermark has passed it everything pending comes out at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from pagelore.functions import text
from pagelore.operators.vectors import work_table
from pagelore.sources import scan

EVENT = "root string, path string, what string, at_ms long"
BATCH = "root string, path string, what string, first_ms long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def relevant(path: Column) -> Column:
    """A deck, or a name without extension (it may be a folder); no lock or hidden files."""
    name = F.lower(text.base_name(path))
    return (name.endswith(".pptx") | ~name.contains(".")) & ~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit("."))


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and what (new, changed, deleted) between two listings (path, file_hash)."""
    a, b = before.select("path", F.col("file_hash").alias("old")), now.select("path", F.col("file_hash").alias("new"))
    both = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").otherwise("changed").alias("what"))


class Pending(StatefulProcessor):
    """A root's paths that wait for the deadline, the last event of each."""

    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "what string")
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part["path"].notna()].sort_values("at_ms", kind="stable")
            for path, what, at in zip(part["path"], part["what"], part["at_ms"], strict=True):
                if not self.first.exists():
                    self.first.update((int(at),))
                    self.handle.registerTimer(int(at) + self.interval_ms)
                self.paths.updateValue((path,), (what,))
        yield pd.DataFrame(columns=["root", "path", "what", "first_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists():
            first = self.first.get()[0]
            yield pd.DataFrame([(key[0], k[0], v[0], first) for k, v in self.paths.iterator()], columns=["root", "path", "what", "first_ms"])
            self.paths.clear()
            self.first.clear()

    def close(self) -> None:
        pass


def batched(events: DataFrame, interval_ms: int) -> DataFrame:
    """A stream of events as batches: rows of one root and first_ms belong together."""
    rows = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "0 seconds")
    return rows.groupBy("root").transformWithStateInPandas(statefulProcessor=Pending(interval_ms), outputStructType=BATCH, outputMode="append", timeMode="eventTime")


class Watch:
    """A root under watch; work is a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, work: str, interval: float = 1.0, globs: list[str] | None = None, now: Callable[[], float] = time.time):
        self.spark, self.root, self.work, self.interval, self.globs, self.now = spark, root, work.rstrip("/"), interval, globs or [], now
        self.events = f"{self.work}/events"
        self.before = spark.createDataFrame([], "path string, file_hash string")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.events)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        self.query: StreamingQuery | None = None

    def poll(self) -> int:
        """Lists the root once; how many paths differ from the listing before."""
        at = int(self.now() * 1000)
        now = work_table(scan.listing(self.spark, 0, self.root, self.globs).select("path", "file_hash"), "listing")
        found = work_table(differences(self.before, now), "differences")
        beat = self.spark.createDataFrame([(self.root, None, None, at)], EVENT)
        found.select(F.lit(self.root).alias("root"), "path", "what", F.lit(at).cast("long").alias("at_ms")).unionByName(beat).coalesce(1).write.mode("append").json(self.events)
        self.before = now
        return found.count()

    def start(self, on_batch: Callable[[list[tuple[str, str]]], None]) -> StreamingQuery:
        """Calls on_batch with (path, what) of each batch whose time is over."""

        def deliver(rows: DataFrame, _: int) -> None:
            got: dict[int, list[tuple[str, str]]] = {}
            for r in rows.toLocalIterator():
                got.setdefault(r.first_ms, []).append((r.path, r.what))
            for first in sorted(got):
                on_batch(sorted(got[first]))

        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        events = self.spark.readStream.schema(EVENT).json(self.events)
        self.query = batched(events, int(self.interval * 1000)).writeStream.option("checkpointLocation", f"{self.work}/checkpoint").foreachBatch(deliver).start()
        return self.query


def follow(library, root: str, work: str, interval: float = 1.0, now: Callable[[], float] = time.time) -> Watch:
    """A watch whose batches make a library scan."""
    w = Watch(library.spark, root, work, interval, now=now)
    w.start(lambda changed: library.scan())
    return w
