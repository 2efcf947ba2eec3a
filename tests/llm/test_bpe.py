import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pagelore.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(5)
    bits = ["'s", "'S", "'re", "'ve", "'ll", "'l", "'", "''", " ", "  ", "\n", "\t", " ", "　", "a", "Zür", "ß", "1", "٣", "½", "!", "…", "😀", "é", "​", "\x1c", "don't", "'tis", " 's", "\r\n", "x'dre", "中文", "<|endoftext|>"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(3000)]


def test_as_tiktoken(spark, oracle, tmp_path):
    texts = [None, "", " ", "a" * 30_000, "xyz'" * 9000, " \n" * 5000, *odd_texts()]
    rows = [(i % 3000 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, ids int, offsets string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        ids = oracle.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op6(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents_and_round_trip(spark, oracle):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    enc = bpe.encode(docs, PATH)
    for r in enc.collect():
        assert r.ids == oracle.encode_ordinary(text[r.doc_id])
        raw = text[r.doc_id].encode()
        assert all(raw[a : a + len(x)] == x for a, x in zip(r.offsets[:50], map(oracle.decode_single_token_bytes, r.ids)))
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(enc, PATH).collect()} == text


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
