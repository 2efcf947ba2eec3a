import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(w, least=6, times=4):
    """Every stretch that keeps a period and can't be extended, by comparing words q apart."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and all(any(w[x] != w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, least=6, times=4):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([x for t in texts for x in t], np.int64)
    start, length, period = periodic.runs(codes, first, least, times)
    out = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        i = int(np.searchsorted(first, s, "right")) - 1
        out[i].append((s - int(first[i]), n, q))
    return out


texts = st.lists(st.lists(st.integers(0, 2), max_size=60) | st.builds(lambda u, n, t: u * n + t, st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=9)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_runs_by_brute_force(ts, kind):
    least, times = kind
    assert found(ts, least, times) == [brute(t, least, times) for t in ts]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_vocabulary_is_complete(ts):
    """Without the selection of stretches: the string holds every primitive square of all texts, from the leftmost ones only."""
    codes = np.array([x for i, t in enumerate(ts) for x in [*t, 1000 + i]], np.int64)
    if not len(codes):
        return
    _, codes = np.unique(codes, return_inverse=True)
    tree = periodic.Tree(codes, len(codes))
    half, low, high = periodic.vocabulary(tree, len(codes))
    w = codes.tolist()
    got = {tuple(w[tree.order[a] : tree.order[a] + 2 * h]) for h, a in zip(half.tolist(), low.tolist())}
    places = {(h, int(p)) for h, a, b in zip(half.tolist(), low.tolist(), high.tolist()) for p in tree.order[a : b + 1]}
    prim = lambda u: all(u != u[: len(u) // f] * f for f in range(2, len(u) + 1) if len(u) % f == 0)
    want = {(q, i) for q in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * q + 1) if w[i : i + q] == w[i + q : i + 2 * q] and prim(w[i : i + q])}
    assert places == want and got == {tuple(w[i : i + 2 * q]) for q, i in want}


def test_fibonacci_and_small_strings(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 1200:
        a, b = b, b + a
    assert found([b], 2, 2) == [brute(b, 2, 2)]
    r = random.Random(4)
    ts = [[r.randrange(2) for _ in range(r.randrange(90))] for _ in range(40)]
    monkeypatch.setattr(periodic, "STRING", 50)
    assert found(ts) == [brute(t) for t in ts]


def expected(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = [(a, n, q) for (a, n, q) in found_words(w)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {x for a, n, q in runs for x in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *four, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for y, x in enumerate(w) if y not in gone)))


def found_words(w):
    """As brute, quicker: stretches of equal words q apart by numpy; a shorter period of the same stretch rules it out."""
    codes = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, np.int64)
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (codes[q:] == codes[:-q]).astype(np.int8), [0]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a + q >= max(6, 4 * q) and not any(s <= a and a + (b - a + q) <= s + n and q % p == 0 and p < q for s, n, p in out):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=str)


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = [expected(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert digests(periodic.op13(spark, sf)) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 20


def test_edges(spark, tmp_path):
    r = random.Random(8)
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (None, None), (5, "x " * 5), (5, "x " * 5), (6, "Ä b\tc\r" * 20), (7, "ab ab ab " * 3 + "q " + "ab ab ab " * 9), (8, "only one")]
    rows += [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 300)))) for i in tens] + [(tens[0], None)]
    long = [f"w{int(r.paretovariate(0.6))}" for _ in range(40_000)]
    rows += [(9, " ".join(long[:9_000] + long[9_000:9_700] * 12 + long[30_000:])), (tens[1], " ".join(long))]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert digests(periodic.op13(spark, str(tmp_path))) == sorted((expected(*x) for x in rows), key=str)


def test_empty(spark):
    assert periodic.collapsed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
