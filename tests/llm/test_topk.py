import numpy as np
import pytest
from oracle import duck, spark_rows

from pagelore.llm import topk


def test_embeddings(spark):
    assert spark_rows(topk.op2(spark, "/root/testdata/sf0.01")) == duck("/root/testdata/sf0.01", topk.OP2_SQL)


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SMALL_BLOCK", 7)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(0, 400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(60)]
    rows += [(2000, None), (2050, []), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, [float("nan")] * 6), (2200, [float("inf")] * 6), (2250, [0.5] * 3), (2251, [0.5] * 3), (2300, [9.0]), (2350, [0.0] * 6), (2400, [-1.0] * 6), (None, [1.0] * 6)]
    spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, block string, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert spark_rows(topk.op2(spark, str(tmp_path))) == duck(str(tmp_path), topk.OP2_SQL)


def test_bound_stops_early():
    rows = np.zeros((5000, 4), np.int64)
    rows[:, 0] = np.arange(5000)
    b = topk.Block(np.arange(5000), rows)
    met = []
    inner = b.score
    b.score = lambda at, q: met.append(len(at)) or inner(at, q)
    ids, score = b.search(np.array([3, 0, 0, 0]), 5, 4999)
    assert ids.tolist() == [4998, 4997, 4996, 4995, 4994] and sum(met) < 600


def test_large_components_are_exact_or_refused():
    rows = np.array([[1 << 34, 5], [(1 << 34) + 1, -7], [3, 4]])
    b = topk.Block(np.arange(3), rows)
    q = np.array([(1 << 26) + 1, 3])
    ids, score = b.search(q, 2, 9)
    assert dict(zip(ids.tolist(), score.tolist())) == {i: sum(int(x) * int(y) for x, y in zip(rows[i], q)) for i in (0, 1)}
    with pytest.raises(OverflowError):
        b.search(np.array([1 << 34, 0]), 2, 9)


def test_outliers_end_no_job(spark, tmp_path):
    """Components far apart: no score is large, though their product would be."""
    rows = [(0, [2.0**33, 0.0]), (50, [0.0, 2.0**33]), (100, [1.0, 2.0]), (3, [0.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id): r.score for r in topk.op2(spark, str(tmp_path)).collect()}
    v = {i: [int(256 * x) for x in e] for i, e in rows}
    assert got == {(q, c): sum(x * y for x, y in zip(v[q], v[c])) for q in (0, 50, 100) for c in v if c != q}


def test_scores_at_the_end_of_the_longs():
    rows = np.array([[(1 << 63) - 1, 0], [1 << 62, 1 << 62], [-(1 << 63), 5]])
    assert topk.exact_scores(rows, np.array([0, 1])).tolist() == [0, 1 << 62, 5]
    assert topk.exact_scores(rows[1:2], np.array([1, -1])).tolist() == [0]
    for q in ([1, 0], [2, 2]):
        with pytest.raises(OverflowError):
            topk.exact_scores(rows, np.array(q))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert topk.op2(spark, str(tmp_path)).collect() == []
