"""Each stage's decisions against brute force, on what its predecessor kept."""

import hashlib
import re
from collections import defaultdict

import pytest
from test_bpe import oracle  # noqa: F401
from test_jaccard import brute as near_brute

import corpus_pipeline as cp
from pagelore.llm import mixing
from pagelore.llm.common import written

BLANKS = " \t\n\x0b\f\r"


def lines_deduplicated(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                docs[key(x)].add(d)
    gone = lambda d, x: len(docs.get(key(x), ())) >= 5 and d != max(docs[key(x)])
    return {d: "\n".join(x for x in (t or "").split("\n") if not gone(d, x)) for d, t in rows}


def test_stages(spark, oracle, tmp_path):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34 !!", "en", "src0", 8), (9003, "", None, None, 0), (9004, "xqzk vwpj " * 30, "en", "src0", 9)], docs.schema)
    docs = docs.unionByName(extra)
    seen = []
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf), f"test-{name}")
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen.append((name, docs, out))
        docs = out
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = seen
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert set(text(d0)) - set(text(d1)) == {9001, 9002, 9003, 9004}
    want = lines_deduplicated(list(text(d1).items()))
    assert text(d2) == want and all(r.n_chars == len(r.text) for r in d2.collect())
    assert set(text(d3)) == {d for d, c in near_brute(list(text(d2).items())) if d == c}
    kept = {r.doc_id for r in mixing.mixed(d3).where("kept").collect()}
    assert set(text(d4)) == kept and 0 < len(kept) < d3.count()
    final = {r.doc_id: r for r in d5.collect()}
    assert set(final) == kept
    for d, t in text(d4).items():
        ids = oracle.encode_ordinary(t)
        assert (final[d].n_tokens, final[d].ids, final[d].decoded_sha256) == (len(ids), ids, hashlib.sha256(t.encode()).hexdigest())


def test_run(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stage_names(k):
    assert cp.STAGES[k][0] == ["language_id", "line_dedup", "simhash", "mixing", "byte_bpe"][k]
