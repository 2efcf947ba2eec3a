"""Backfills go one at a time, can be cancelled, and never make anything twice; stored results follow their version."""

import os

import pytest
from fixtures import deck
from pyspark.sql import functions as F

from pagelore.backfill import Backfill, Busy
from pagelore.library import Library
from pagelore.operators.vectors import FakeEmbedder


def counting(dims, path):
    """An embedder that writes down every text it is asked for, from whichever process."""

    class Counting(FakeEmbedder):
        def embed_passages(self, texts):
            fd = os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY)
            os.write(fd, "".join(t.replace("\n", " ") + "\n" for t in texts).encode())
            os.close(fd)
            return FakeEmbedder.embed_passages(self, texts)

    out = Counting(dims)
    out.path = path
    return out


def asked(path):
    return open(path).read().splitlines() if os.path.exists(path) else []


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("backfill")
    (base / "decks").mkdir()
    for i in range(4):
        (base / "decks" / f"d{i}.pptx").write_bytes(deck(f"D{i}", [(f"slide {i} {j}", ["same bullet"], None, False) for j in range(4)]))
    lib = Library(spark, str(base / "lib"), counting(16, str(base / "asked")))
    lib.add_root(str(base / "decks"))
    lib.scan()
    lib.base = base
    return lib


def test_cancel_and_resume(spark, made):
    whole = {(r.id, r.content_hash) for r in made.table("slides").collect()}
    made.put("slides", made.table("slides").withColumn("content_hash", F.when(F.col("slide_index") % 2 == 0, F.col("content_hash"))))
    job, other = Backfill(made, slices=4), Backfill(Library(spark, made.path, FakeEmbedder(16)), slices=4)
    stopped = []

    def progress(stage, n):
        if stage == "embedded" and n and not stopped:
            with pytest.raises(Busy):
                other.run()
            assert other.cancel()
            stopped.append(n)

    got = job.run(progress)
    assert got["cancelled"] and 0 < got["embedded"] < 16
    assert {(r.id, r.content_hash) for r in made.table("slides").collect()} == whole and got["hashed"] == 16
    stored = made.table("embeddings").count()
    assert 0 < stored < 16 and len(asked(made.embedder.path)) == stored == got["embedded"]
    again = Backfill(made, slices=4).run()
    assert (again["hashed"], again["embedded"], again["cancelled"]) == (0, 16 - stored, False)
    assert len(asked(made.embedder.path)) == len(set(asked(made.embedder.path))) == 16  # nothing twice
    assert made.table("leases").isEmpty() and not other.cancel()
    assert Backfill(made, slices=2).run() == {"hashed": 0, "embedded": 0, "cancelled": False}


def test_a_lost_run_is_taken_over(spark, made):
    lost = Backfill(made, seconds=50)
    lost._take()
    with pytest.raises(Busy):
        Backfill(made).run()
    real = made.now
    made.now = lambda: real() + 60
    try:
        assert not Backfill(made, slices=1).run()["cancelled"]
    finally:
        made.now = real


def test_stored_results_follow_their_version(spark, made, monkeypatch):
    from pagelore.operators import vectors

    made.embed_missing()
    n = made.vector_store().count()
    assert n == 16 and made.refreshed == 16
    version = made.store.version
    first = sorted(map(tuple, made.near_clusters(0.1).collect()))
    monkeypatch.setattr(vectors, "clusters", lambda *a: 1 / 0)
    assert sorted(map(tuple, made.near_clusters(0.1).collect())) == first and made.vector_store().count() == n
    assert made.store.version == version + 1  # one commit for the clusters; what was stored is read
    with pytest.raises(ZeroDivisionError):
        made.near_clusters(0.2)
    (made.base / "decks" / "d1.pptx").write_bytes(deck("D1", [("another", ["text"], None, False)] + [(f"slide 1 {j}", ["same bullet"], None, False) for j in range(1, 4)]))
    made.scan()
    assert made.vector_store().count() == 15 and made.refreshed == 0  # the new text has no vector yet
    made.embed_missing()
    assert made.vector_store().count() == 16 and made.refreshed == 1
