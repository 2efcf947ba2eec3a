import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagelore.llm import sketch
from pagelore.llm.common import text_buffer, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, words=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketched(*texts, k=sketch.K):
    s, at = sketch.sketches(*text_buffer(pa.array(texts, pa.string())), k)
    return [s[x:y] for x, y in zip(at[:-1], at[1:])]


def edited(rows):
    """doc_id, n_chars, edited text of rows (doc_id, text), by the contract, each list in ring order."""
    key = lambda r: (r[0] is None, -(r[0] or 0))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (*key(r), r[1]))
    return [(i, len(t), t[: len(t) - len(t) // 2] + rows[(p + 1) % len(rows)][1][: len(t) // 2], t, rows[(p + 1) % len(rows)][1]) for p, (i, t) in enumerate(rows)]


def check(df, rows):
    got = {}
    for r in df.collect():
        got.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
    want = edited(rows)
    assert sum(len(v) for v in got.values()) == len(want)
    prints = {}
    for i, n, e, t, following in want:
        r = got[i, n, hashlib.sha256(e.encode()).hexdigest()].pop()
        a, b, c = shingles(t), shingles(e), shingles(following)
        for near, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            exact = len(x | y) < sketch.K
            assert near == pytest.approx(jaccard(x, y), abs=1e-9 if exact else 0.15)
            assert 0 <= near <= 1
        assert r.n_shingles == pytest.approx(len(a), rel=0 if len(a) < sketch.K else 0.3)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert len(sketch.decoded(r.fingerprint)) == min(sketch.K, len(a))
    small = {p: frozenset(shingles(t)) for t, p in prints.items() if len(shingles(t)) < sketch.K}
    assert len(small) == len(set(small.values()))


@pytest.mark.parametrize("partitions", [1, 3])
def test_query_by_brute_force(spark, partitions):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(sketch.op11(spark, sf), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_edges(spark):
    r = random.Random(5)
    long = " ".join(r.choice(["ünder", "Öl", "x" * 70, "日本", "und"]) + str(r.randrange(10**6)) for _ in range(60_000))
    rows = [(7, None), (9, ""), (8, "a"), (3, "ab"), (-5, "Ä€𝄞 x"), (0, long), (11, long), (4, " \t\n"), (None, "no id"), (2**62 + 1, "large"), (2**62, "ids"), (6, "same text here, five words"), (5, "same text here, five words"), (5, "of a repeated id"), (5, "of a repeated id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, ghost string").repartition(3)
    check(sketch.edits(df), rows)


def test_rows_without_ids(spark):
    rows = [(None, f"no id {i % 40}") for i in range(60)] + [(None, None), (3, "a b"), (2, "c d")]
    out = sketch.edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 63 and sum(r.n_chars == 0 for r in out) == 1
    first = min((t for i, t in rows if i is None), key=lambda t: [-xxhash64(spark, t or ""), t or ""]) or ""
    assert next(r for r in out if r.doc_id == 2).edited_sha256 == hashlib.sha256(("c " + first[:1]).encode()).hexdigest()


def xxhash64(spark, t):
    return spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) AS h").first().h


def test_one_row_and_none(spark):
    kind = "doc_id long, text string"
    check(sketch.edits(spark.createDataFrame([(1, "one two three four five six seven")], kind)), [(1, "one two three four five six seven")])
    assert sketch.edits(spark.createDataFrame([], kind)).collect() == []
    assert sketch.fingerprints(spark.createDataFrame([], kind)).collect() == []


def test_estimates_of_large_sets():
    r = random.Random(2)
    w = [f"w{r.randrange(10**9)}" for _ in range(30_000)]
    whole, half, other = " ".join(w), " ".join(w[:15_000]), " ".join(w[10_000:])
    a, b, c = sketched(whole, half, other)
    assert sketch.resemblance(a, b) == pytest.approx(0.5, abs=0.1)
    assert sketch.resemblance(b, c) == pytest.approx(1 / 6, abs=0.08)
    assert sketch.containment(b, a) == pytest.approx(1, abs=0.15) and sketch.containment(a, b) == pytest.approx(0.5, abs=0.15)
    assert sketch.distinct(a) == pytest.approx(29_996, rel=0.2)
    assert sketch.union(b, sketched(" ".join(w[14_996:]))[0]).tolist() == a.tolist()
    assert sketch.decoded(sketch.encoded(a)).tolist() == a.tolist()


def test_merging_of_parts(spark):
    r = random.Random(3)
    parts = [(r.choice([1, 2, None]), " ".join(f"v{r.randrange(40)}" for _ in range(30))) for _ in range(400)] + [(3, None), (4, "")]
    df = spark.createDataFrame(parts, "doc_id long, text string").repartition(7)
    got = {x.doc_id: list(x.sketch) for x in sketch.merged(sketch.fingerprints(df)).collect()}
    want = {}
    for i, t in parts:
        want[i] = sketch.union(want.get(i, np.zeros(0, np.int64)), sketched(t)[0]).tolist()
    assert got == want and len(want[None]) == sketch.K


def test_words_that_differ_have_other_hashes():
    """Also the Thue-Morse words, on which every polynomial hash modulo 2**64 fails."""
    a = [bin(i).count("1") % 2 for i in range(1024)]
    words = ["".join("ab"[x] for x in a), "".join("ab"[1 - x] for x in a), "a", "aa", "a\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 64, "x" * 65]
    data, offs = text_buffer(pa.array(words))
    assert len(set(word_hashes(data, offs[:-1], offs[1:]).tolist())) == len(words)
    assert len(set(word_hashes(data, np.repeat(offs[:-1], 2), np.repeat(offs[1:], 2)).tolist())) == len(words)
