import random
import re

import pytest

import corpus_pipeline as cp
from pagelore.llm import jaccard


def brute(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return sorted(((d, low.get(g)) for (d, _), g in zip(rows, group)), key=str)


@pytest.mark.parametrize("size", [1 << 24, 4000])
def test_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard, "STEP", 64)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", size)
    rng = random.Random(5)
    rows = [(None, "a b c d e f"), (1, "A b  c d\ne f"), (2, None), (3, ""), (4, "one"), (5, "ONE"), (6, "one two"), (None, "alone")]
    license = [f"l{i}" for i in range(60)]
    for k in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 150)))] + license * (k % 3 == 0)
        for _ in range(6):
            t = base[:]
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
            rows.append((len(rows) + 100, " ".join(t[rng.randrange(8) :])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 20 < len({c for _, c in want}) < len(rows) - 20
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == want
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_stage_removes_copies_beyond_four_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 2, 177)")  # 1 and 177: similarity 0.83, 9 bits
    assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == {1, 2}
