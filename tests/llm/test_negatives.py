import numpy as np
import pytest
from oracle import duck, spark_rows

from pagelore.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, key string, slot int"


def written(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_embeddings(spark, sf):
    got = spark_rows(negatives.op12(spark, f"/root/testdata/{sf}"))
    assert got == duck(f"/root/testdata/{sf}", negatives.OP12_SQL) and got[1]


@pytest.mark.parametrize("block", [1, 9, 60])
def test_small_blocks(spark, tmp_path, monkeypatch, block):
    """Many blocks, groups of equal vectors beyond a block, ties, repeated ids, other lengths, what takes no part."""
    monkeypatch.setattr(negatives, "SMALL_BLOCK", block)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "STEP", 2)
    r = np.random.default_rng(block)
    rows = [(i, (r.normal(size=3) + [1, 0, 0]).round(1).tolist(), int(r.integers(0, 4))) for i in range(0, 900, 3 if block > 1 else 9)]
    rows += [(5000 + i, [1.0, 0.5, 0.5], i % 2) for i in range(120)]
    rows += [(5000, [1.0, 0.5, 0.5], 0), (5000, [1.0, 0.5, 0.5], 0), (300, [0.3, 0.2, 0.1], 3), (6000, [0.0] * 3, 1), (6100, [-1.0, -1.0, 0.0], 2)]
    rows += [(7000, [1.0, 2.0], 1), (7001, [1.0, 2.5], 1), (7003, [0.5, 1.0], 2), (7007, [1.0, 1.0], 0), (8000, [3.0], 9)]
    rows += [(9000, None, 1), (9100, [], 1), (9200, [1.0, None, 1.0], 1), (9300, [float("nan")] * 3, 1), (9400, [float("inf"), 0.0, 0.0], 1), (9500, [1.0] * 3, None), (None, [1.0] * 3, 1)]
    path = written(spark, tmp_path, rows)
    assert spark_rows(negatives.op12(spark, path)) == duck(path, negatives.OP12_SQL)


def test_one_outlier(spark, tmp_path):
    """A row so long that distances tell nothing: all is searched, results stay exact."""
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).round(2).tolist(), i % 3) for i in range(500)] + [(1001, [0.0, 0.0, 0.0, 2.0**30], 1)]
    path = written(spark, tmp_path, rows)
    assert spark_rows(negatives.op12(spark, path)) == duck(path, negatives.OP12_SQL)


def test_annuli_rule_rows_and_blocks_out(spark):
    r = np.random.default_rng(2)
    groups = [(c * 400).astype(int) for c in r.normal(size=(8, 6))]
    rows = [(g * 1000 + i, i % 2, (groups[g] + r.integers(-20, 20, 6)).tolist()) for g in range(8) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label long, v array<long>")
    index = negatives.Index(df)
    v = np.array(rows[5][2])
    blocks = index.bounds[6][0]
    first = index.visits(v, np.array([negatives.HIGH]), np.array([negatives.LOW]), None)
    scores = sorted((int(np.dot(x, v)) for i, label, x in rows if label == rows[5][1] and i != rows[5][0]), reverse=True)
    others = index.visits(v, np.array([negatives.HIGH]), np.array([negatives.LOW]), np.array([scores[4]]))
    assert len(first) == 1 and len(others) < len(blocks) / 2
    stored = [x for x in index.table.where(f"block = {int(first[0])}").orderBy("distance").collect()]
    block = negatives.Block(index, stored[0].pivot, np.array([x.distance for x in stored]), np.array([x.id for x in stored]), np.array([x.label for x in stored]), np.array([x.v for x in stored]))
    (_, _, got), = block.search(v, rows[5][0], rows[5][1], True, np.array([negatives.HIGH]), np.array([negatives.LOW]), np.array([negatives.LOW]), 5)
    want = sorted((int(np.dot(x.v, v)) for x in stored if x.label == rows[5][1] and x.id != rows[5][0]), reverse=True)[:5]
    assert sorted(got.tolist(), reverse=True) == want


def test_empty(spark, tmp_path):
    assert negatives.op12(spark, written(spark, tmp_path, [])).collect() == []
