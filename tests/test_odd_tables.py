"""Registered queries against their SQL on tables whose values are odd: many vectors of nearly one cosine, blank texts, texts with spaces and line ends around them."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from duck import duck, spark_rows

from pagelore.functions import text
from pagelore.operators import vectors
from pagelore.plans import testbed

SF = "/root/testdata/sf0.001"


def near_vectors():
    """Cosines with the vector asked for (7) from 0.30 to 0.31, so that many round to one."""
    r = np.random.default_rng(11)
    x = r.normal(size=(500, 64))
    asked = x[7] / np.linalg.norm(x[7])
    apart = x - np.outer(x @ asked, asked)
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
    cosine = r.uniform(0.30, 0.31, size=(500, 1))
    near = cosine * asked + np.sqrt(1 - cosine**2) * apart
    near[7] = asked
    return pa.table({"vec_id": np.arange(500), "embedding": pa.array(near.astype(np.float32).tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 500, pa.int32())})


#: Text and language. The first ones have a vector, those from LATER on have none.
ODD = [
    ("", "en"), ("Iron gate\n", "en"), ("Iron gate", None), (" Iron gate\u3000", "de"), ("\n", "fr"), ("\u00a0Copper lamp \n", "en"), ("x\u2028", "en"),
    ("   ", None), ("\t\n ", " "), ("\tIron gate", "en\n"), ("Iron gate \n", None), ("\n\nLast line ", "\ten"), ("\r\n", None), ("Copper lamp\u2003", "en"), ("\u0085 Tin roof", "en"), ("\u200bTin roof", "\u00a0"),
]
LATER = 7


def odd_documents(rows, later=LATER):
    known = pq.read_table(f"{SF}/documents.parquet")
    ids = [470 + i if i < later else 5000 + i for i in range(len(rows))]
    new = {"doc_id": ids, "text": [t for t, _ in rows], "lang": [x for _, x in rows], "source": ["src3"] * len(rows), "n_chars": [len(t or "") for t, _ in rows]}
    return pa.concat_tables([known, pa.table(new, schema=known.schema)])


def folder(path, changed):
    for f in os.listdir(SF):
        if f.endswith(".parquet") and f not in changed:
            os.symlink(f"{SF}/{f}", f"{path}/{f}")
    for f, rows in changed.items():
        pq.write_table(rows, f"{path}/{f}")
    return str(path)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("odd"), {"embeddings.parquet": near_vectors(), "documents.parquet": odd_documents(ODD)})


@pytest.fixture(scope="module")
def unknown(tmp_path_factory):
    """A vector whose text is null: SQL's NOT IN then finds nothing pending."""
    rows = odd_documents([*ODD[:3], (None, "en")], later=4)
    return folder(tmp_path_factory.mktemp("unknown"), {"documents.parquet": rows})


@pytest.mark.parametrize("name", ["vec6_semantic", "vec8_semantic_within_filters", "agg12_pending_count", "jn9_embedding_counts", "jn8_pending_texts", "hsh_identities"])
def test_query(spark, odd, name):
    got, want = spark_rows(testbed.QUERIES[name](spark, odd)), duck(odd, testbed.ORACLE_SQL[name])
    assert want[1] and got == want


@pytest.mark.parametrize("name", ["agg12_pending_count", "jn8_pending_texts"])
def test_vector_of_a_null_text(spark, unknown, name):
    assert spark_rows(testbed.QUERIES[name](spark, unknown)) == duck(unknown, testbed.ORACLE_SQL[name])


def test_space_trimmed(spark):
    """Every character that SQL's trim takes off, and no other one of the plane."""
    import duckdb

    points = [*range(1, 0xD800), *range(0xE000, 0x10000)]
    want = [p for (p,) in duckdb.execute("SELECT p FROM (SELECT unnest(?) AS p) WHERE trim(chr(p)) = '' ORDER BY p", [points]).fetchall()]
    c = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    assert [r.p for r in c.where(text.space_trimmed("c") == "").orderBy("p").collect()] == want
    row = spark.createDataFrame([(" \u3000a b\n \u00a0", None, "  ")], "a string, b string, c string").select(*[text.space_trimmed(x) for x in "abc"]).first()
    assert tuple(row) == ("a b\n", None, "")


def test_top_k_of_rounded_scores(spark):
    rows = [(i, [c, (1 - c * c) ** 0.5]) for i, c in ((9, 0.5004), (2, 0.4996), (5, 0.7), (3, 0.4999), (1, 0.4994))]
    v = spark.createDataFrame(rows, "slide_id long, vector array<double>")
    assert [r.slide_id for r in vectors.top_k(v, [1.0, 0.0], 3).collect()] == [5, 9, 3]
    assert [tuple(r) for r in vectors.top_k(v, [1.0, 0.0], 3, digits=3).collect()] == [(5, 0.7), (2, 0.5), (3, 0.5)]
    # The floor is for whole scores: 0.4996 shows as 0.5.
    assert [r.slide_id for r in vectors.top_k(v, [1.0, 0.0], 5, floor=0.4998, digits=3).collect()] == [5, 3, 9]
