import math
import os

import pandas as pd
from fixtures import deck

from pagelore.operators import vectors
from pagelore.streaming import history, watch


def typed(session, first, at, *texts):
    """A typist's searches, half a minute apart."""
    return [(session, first + i, t, len(t), at + 30 * i) for i, t in enumerate(texts)]


#: One typist narrows, widens and leaves; comes back to the same text after three minutes; another types at the same time; a third only blanks.
ROWS = [*typed("noor", 1, 1000, "la", "lam", "lamp", "lam", "   ", "soup"), *typed("noor", 9, 1330, "soup"), *typed("ines", 20, 1010, "ferry to", "ferry", "boat"), *typed("ada", 30, 1000, "\t", " ")]
WANT = [("ines", "boat", 4, 1070), ("ines", "ferry", 5, 1040), ("noor", "lam", 3, 1090), ("noor", "soup", 4, 1150), ("noor", "soup", 4, 1330)]
SCHEMA = "session string, id long, query string, result_count long, searched_unix long"


def test_collapse_of_a_batch(spark):
    assert sorted(map(tuple, history.collapsed(spark.createDataFrame(ROWS, SCHEMA)).collect())) == WANT


def test_collapse_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    pd.DataFrame(ROWS, columns=["session", "id", "query", "result_count", "searched_unix"]).to_json(src / "1.json", orient="records", lines=True)
    q = history.collapse_stream(spark.readStream.schema(SCHEMA).json(str(src))).writeStream.format("memory").queryName("collapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        pd.DataFrame([("z", 9, "later", 1, 9000)], columns=["session", "id", "query", "result_count", "searched_unix"]).to_json(src / "2.json", orient="records", lines=True)
        q.processAllAvailable()
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("collapsed").collect()))
        assert got == WANT
    finally:
        q.stop()


def test_watch_gives_out_batches_from_their_first_event(spark, tmp_path):
    """By a clock of the test's own: a batch closes one interval after its first event, later events don't move that, deleted decks come out."""
    d, clock, seen = tmp_path / "decks", [1000.0], []
    d.mkdir()
    for name in ("one.pptx", "two.pptx", "~$one.pptx", "notes.txt"):
        (d / name).write_bytes(deck("A", [("x", [], None, False)]))
    w = watch.Watch(spark, str(d), str(tmp_path / "work"), interval=2.0, now=lambda: clock[0])
    q = w.start(lambda batch: seen.append([(os.path.basename(p), what) for p, what in batch]))

    def tick(to):
        clock[0] = to
        n = w.poll()
        q.processAllAvailable()
        return n

    try:
        assert tick(1000.0) == 2 and seen == []
        (d / "three.pptx").write_bytes(deck("C", [("z", [], None, False)]))
        assert tick(1001.5) == 1 and seen == []
        assert tick(1002.5) == 0 and seen == [[("one.pptx", "new"), ("three.pptx", "new"), ("two.pptx", "new")]]
        os.remove(d / "two.pptx")
        assert tick(1003.0) == 1
        os.utime(d / "one.pptx", (5, 5))
        (d / "two.pptx").write_bytes(deck("B", [("back", [], None, False)]))
        assert tick(1004.0) == 2
        os.remove(d / "two.pptx")
        os.remove(d / "three.pptx")
        assert tick(1004.9) == 2 and len(seen) == 1
        assert tick(1005.5) == 0 and seen[1:] == [[("one.pptx", "changed"), ("three.pptx", "deleted"), ("two.pptx", "deleted")]]
        tick(1010.0)
        tick(1020.0)
        assert len(seen) == 2
    finally:
        q.stop()


def test_vectors(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([(3, "k", [0.6, 0.8]), (5, "l", [0.8, -0.6]), (7, "m", [2.0, 0.1]), (9, "n", [-3.0, -4.0])], "slide_id long, text_hash string, vector array<float>")
    v = v.withColumn("vector", vectors.normalized(F.col("vector")))
    assert [r.slide_id for r in vectors.top_k(v, [0.0, 1.0], 3).collect()] == [3, 7, 5]
    assert vectors.top_k(v, [1.0, 0.0, 0.0], 3).collect() == [] and vectors.top_k(v, [1.0, 0.0], 0).collect() == []
    turns = {11: 0.0, 12: 0.1, 13: 0.2, 21: 2.0, 22: 2.1, 31: 4.0}
    n = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in turns.items()], "slide_id long, vector array<double>")
    got = {r.slide_id: r.cluster for r in vectors.clusters(n).collect()}
    assert got == {11: 11, 12: 11, 13: 11, 21: 21, 22: 21}
    a = spark.createDataFrame([(x, i) for i, x in enumerate([41, 42, 43, 44], 1)], "slide_id long, rank int")
    b = spark.createDataFrame([(x, i) for i, x in enumerate([51, 52, 43], 1)], "slide_id long, rank int")
    assert vectors.rrf([a, b]).orderBy(F.desc("score")).first().slide_id == 43
