"""Operators 4 and 8 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagelore.llm import anchors, bwt, jaccard, passages, rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, size, window):
    """rows: (doc_id, units); flags of removed units."""
    first = {}
    for d, u in rows:
        for s in range(len(u) - window + 1) if d is not None else ():
            k = tuple(u[s : s + window]) if isinstance(u, list) else u[s : s + window]
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for d, u in rows:
        gone = [False] * len(u)
        for s in range(len(u) - window + 1) if d is not None else ():
            k = tuple(u[s : s + window]) if isinstance(u, list) else u[s : s + window]
            if first[k] < (d, s):
                gone[s : s + window] = [True] * window
        out.append(gone)
    return out


def brute4(rows):
    units = [(d, WORD.findall(t or "")) for d, t in rows]
    out = []
    for (d, u), gone in zip(units, removed(units, None, 20)):
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        out.append((d, len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute8(rows):
    units = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, u), gone in zip(units, removed(units, None, 100)):
        kept = bytes(c for c, g in zip(u, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(9)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b = prose(90), prose(25)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, a), (5, a), (5, a), (None, a), (None, a), (6, a.replace(" ", "\n ")), (7, prose(30) + " " + a[:300] + " " + prose(9))]
    rows += [(10 + i, prose(r.randrange(5, 40)) + " " + b + " " + prose(r.randrange(5, 40))) for i in range(90)]
    rows += [(200, "la " * 300), (201, "la " * 150), (202, "la " * 19), (203, ("x y " * 80) + a), (204, "z" * 1500), (205, "y" + "z" * 120)]
    near = prose(200).split()
    for i in range(30):
        near[r.randrange(200)] = "edit" + str(i)
        rows.append((300 - i, " ".join(near)))
    rows.append((400, " ".join(prose(1) for _ in range(20_000))))
    return rows


@pytest.mark.parametrize("op,brute", [(rlz.op4, brute4), (bwt.op8, brute8)])
@pytest.mark.parametrize("small", [False, True])
def test_as_brute_force(spark, tmp_path, monkeypatch, op, brute, small):
    if small:  # many buckets, small blocks, frequent grams
        for k, v in {"BUCKET_BYTES": 3000, "HOME_BYTES": 5000, "SAMPLE_DOCS": 60, "CHUNK": 4000}.items():
            monkeypatch.setattr(passages, k, v)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        rows = cases()
        spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, blob string, bucket int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
        assert sorted(map(tuple, op(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def blocks():
    r = random.Random(3)
    for n in range(40):
        strings = [[r.randrange(r.choice([2, 3, 30])) for _ in range(r.randrange(120))] for _ in range(1 + n % 8)]
        strings.append(strings[0][5:90] + strings[-1][:20])
        yield strings, r.sample(range(50), len(strings)), [r.randrange(900) for _ in strings]


@pytest.mark.parametrize("search,kind", [(rlz.factored, np.uint64), (lambda *a: rlz.factored(*a, 7), np.uint64), (bwt.shard_repeats, np.uint8), (bwt.merged_repeats, np.uint8)])
@pytest.mark.parametrize("window", [8, 20, 100])
def test_blocks(search, kind, window):
    """Every removed window is one that a factor, a check at a boundary or an interval gave: the searches alone find all."""
    for strings, doc, start in blocks():
        first = {}
        every = [(tuple(s[j : j + window]), (d, at + j), (i, j)) for i, (s, d, at) in enumerate(zip(strings, doc, start)) for j in range(len(s) - window + 1)]
        for k, place, _ in every:
            first[k] = min(first.get(k, place), place)
        flat = np.array([x for s in strings for x in s], kind)
        got = search(flat, np.cumsum([0, *map(len, strings)]), np.array(doc), np.array(start), window)
        assert set(zip(*(x.tolist() for x in got))) == {at for k, place, at in every if first[k] < place}


def test_factors_are_longest_and_earlier():
    text = [1, 2, 3, 4, 5, 1, 2, 3, 9, 3, 4, 5, 1, 2, 8]
    ref = rlz.Reference(np.array(text, np.uint64), np.array([0, len(text)]), np.array([1]), np.array([0]), 3, len(text))
    piece, at, size = ref.factors(np.array([0]), np.array([len(text)]))
    assert list(zip(at.tolist(), size.tolist())) == [(5, 3), (9, 5)]


@pytest.mark.parametrize("op,brute", [(rlz.op4, brute4), (bwt.op8, brute8)])
def test_documents(spark, op, brute):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("op", [rlz.op4, bwt.op8])
def test_empty(spark, tmp_path, op):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op(spark, str(tmp_path)).collect() == []


def test_frequent_grams_are_avoided():
    symbols = anchors.mix(np.arange(1, 400, dtype=np.uint64))
    first = np.array([0, len(symbols)])
    none, h = anchors.Frequent(np.zeros(0, np.uint64)), anchors.gram_hashes(symbols, first, 6)[0]
    plain = anchors.Runs(symbols, first, 20, 6, none)
    rare = anchors.Runs(symbols, first, 20, 6, anchors.Frequent(h[::2]))
    assert not np.isin(rare.anchor, h[::2]).any() and np.isin(plain.anchor, h[::2]).any()
    assert plain.count.sum() == rare.count.sum() == 399 - 20 + 1


def test_merge_is_a_suffix_order():
    r = random.Random(4)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(20, 60))).encode() for _ in range(40)]
    first = np.cumsum([0, *map(len, strings)])
    string, offset, interval = bwt.intervals(np.frombuffer(b"".join(strings), np.uint8), first, 12, 3)
    rows = [(strings[s][o : o + 12], i) for s, o, i in zip(string.tolist(), offset.tolist(), interval.tolist()) if o + 12 <= len(strings[s])]
    assert [w for w, _ in rows] == sorted(w for w, _ in rows)
    assert len({w for w, _ in rows}) == len({i for _, i in rows}) == len(set(rows))
    assert len(rows) == sum(len(s) - 11 for s in strings)


def test_words_as_sql(spark):
    from oracle import duck, spark_rows

    sf = "/root/testdata/sf0.01"
    assert spark_rows(rlz.op4(spark, sf)) == duck(sf, rlz.OP4_SQL)


def test_words_of_one_polynomial_hash_are_not_copies(spark):
    """Thue-Morse words and their complements share every polynomial hash modulo 2**64; they are no repeats."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    pairs = [("".join(x[b] for b in bits), "".join(x[1 - b] for b in bits)) for x in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx", "yz", "AB", "CD", "EF", "GH", "IJ", "KL", "MN")]
    docs = spark.createDataFrame([(1, " ".join(a for a, _ in pairs)), (2, " ".join(b for _, b in pairs)), (3, " ".join(a for a, _ in pairs))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz.deduplicated(docs).collect()) == [(1, 20, 0), (2, 20, 0), (3, 20, 20)]
    sets, at, _, _ = jaccard.shingle_sets(pa.array([" ".join(x) for x in zip(*pairs)]), 5)
    assert not set(sets[: at[1]].tolist()) & set(sets[at[1] :].tolist())
