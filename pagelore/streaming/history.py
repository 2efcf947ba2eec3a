"""Search history that keeps what a typist ended up with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from pagelore.functions import text
from pagelore.schema import REFINEMENT_SECONDS

ROW = "session string, query string, result_count long, searched_unix long"


def collapsed(searches: DataFrame, seconds: int = REFINEMENT_SECONDS) -> DataFrame:
    """session, query, result_count, searched_unix: the last of each run of refinements.

    A search refines the one before it in its session if it follows within the
    time and either text begins with the other. Blank searches are dropped.
    """
    rows = searches.withColumn("query", text.trimmed("query")).where(F.col("query") != "")
    order = Window.partitionBy("session").orderBy("searched_unix", "id")
    near = F.col("searched_unix") - F.lag("searched_unix").over(order) <= seconds
    refines = near & text.prefix_either_way(F.col("query"), F.lag("query").over(order))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(refines, F.lit(False)), 0).otherwise(1)).over(order))
    last = F.struct("searched_unix", "id", "query", "result_count")
    return rows.groupBy("session", "run").agg(F.max(last).alias("x")).select("session", "x.query", "x.result_count", "x.searched_unix")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = list(state.get) if state.exists else None
    out = []
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([[key[0], *last]], columns=["session", "query", "result_count", "searched_unix"])
        return
    rows = pd.concat(list(batches)).sort_values(["searched_unix", "id"])
    for q, n, at in zip(rows["query"], rows["result_count"], rows["searched_unix"]):
        q = (q or "").strip()
        if not q:
            continue
        if last and not (at - last[2] <= REFINEMENT_SECONDS and (q.startswith(last[0]) or last[0].startswith(q))):
            out.append([key[0], *last])
        last = [q, int(n), int(at)]
    if last:
        state.update(tuple(last))
        state.setTimeoutTimestamp((last[2] + REFINEMENT_SECONDS) * 1000 + 1)
    yield pd.DataFrame(out, columns=["session", "query", "result_count", "searched_unix"])


def collapse_stream(searches: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The same on a stream: state is a session's last search, given out when another follows or the watermark passes its time."""
    rows = searches.withColumn("at", F.timestamp_seconds("searched_unix")).withWatermark("at", lateness)
    return rows.groupBy("session").applyInPandasWithState(_step, ROW, "query string, result_count long, searched_unix long", "append", GroupStateTimeout.EventTimeTimeout)
