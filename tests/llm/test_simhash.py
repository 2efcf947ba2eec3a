import re

import xxhash
from pyspark.sql import functions as F

from pagelore.llm import simhash


def brute(rows, radius=4):
    def fp(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return sorted(((d, f"{f:016x}", low.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=str)


def run(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in simhash.op10(spark, str(tmp_path)).collect()), key=str)


def test_edges_of_input(spark, tmp_path):
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    near = long.replace("w5x", "w6x", 3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c d e"), (6, "a b c d e"), (None, "a  b\nC d\x0be"), (7, long), (8, near), (9, "é " * 700), (None, "alone here now then"), (10, "x y")]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_documents(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_hot_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    fps = sorted({(1 << i | 1 << j | 1 << k) for i in range(8) for j in range(20, 34) for k in (40, 41, 60)} | {(7 << 20) * i * 7919 % (1 << 63) for i in range(300)})
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert a in root and b in root
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {f: find(f) for f in fps}
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {f: find(f) for f in fps}


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_one_of_each(spark, monkeypatch):
    long = " ".join(f"w{i % 97}" for i in range(400))
    rows = [(5, long), (3, long), (3, long), (7, long + " end"), (None, long), (None, "alone in the world"), (8, "x y z"), (9, None), (10, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, count int")
    for most in (200_000, -1):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        got = sorted((str(r.doc_id) for r in simhash.one_of_each(df).collect()))
        assert got == ["3", "8", "9", "None", "None"]
