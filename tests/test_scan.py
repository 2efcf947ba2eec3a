"""Scans read what changed and commit at once; the stored index follows."""

import json
import os

import pytest
from fixtures import deck
from pyspark.sql import functions as F

from pagelore.library import Library
from pagelore.operators import fulltext, segments
from pagelore.operators.filters import Filters
from pagelore.plans import query_parser
from pagelore.schema import struct
from pagelore.sources import scan


def write(folder, name, *titles, notes=None):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(deck(name, [(t, [f"point of {t}"], notes, False) for t in titles]))


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("scan")
    for i in range(40):
        write(base / "decks" / f"f{i % 3}", f"d{i}.pptx", f"topic{i}", "shared words")
    write(base / "decks", "odd [1]{a},b*.pptx", "brackets")
    one = Library(spark, str(base / "lib"))
    one.base = base
    one.add_root(str(base / "decks"))
    one.first = one.scan()
    return one


def found(lib, q):
    by = {r.id: r.title for r in lib.slides().collect()}
    return sorted(by[r.slide_id] for r in lib.search(q, Filters(limit=500)).collect())


def test_one_changed_file_is_the_only_one_opened(spark, lib, monkeypatch):
    assert lib.first["indexed"] == 41
    opened = []
    inner = scan.read_paths
    monkeypatch.setattr(scan, "read_paths", lambda s, paths: opened.append(inner(s, paths)) or opened[-1])
    write(lib.base / "decks" / "f1", "d7.pptx", "changed heading", "third", "fourth")
    before, frame = lib.store.version, lib.slides()
    kept = {d for dirs in lib.store._entry("slides")["rows"].values() for d, _ in dirs}
    got = lib.scan()
    assert (got["indexed"], got["unchanged"]) == (1, 40)
    assert [sorted(os.path.basename(f) for f in df.inputFiles()) for df in opened] == [["d7.pptx"]]
    assert lib.store.version == before + 1  # one commit for all tables
    assert frame.where("title = 'topic7'").count() == 1 and lib.slides().where("title = 'topic7'").count() == 0
    assert kept <= {d for dirs in lib.store._entry("slides")["rows"].values() for d, _ in dirs}  # nothing was rewritten
    assert found(lib, "topic7") == [] and found(lib, "third") == ["third"] and "changed heading" in found(lib, "heading")
    assert len(found(lib, "shared")) == 39
    os.utime(lib.base / "decks" / "odd [1]{a},b*.pptx", (1, 1))
    opened.clear()
    assert lib.scan()["indexed"] == 1 and len(opened) == 1 and found(lib, "brackets") == ["brackets"]
    opened.clear()
    assert lib.scan()["indexed"] == 0 and opened == []


def test_a_scan_that_fails_leaves_everything(spark, lib, monkeypatch):
    write(lib.base / "decks" / "f2", "d8.pptx", "half way")
    before = lib.store.version
    monkeypatch.setattr(lib, "_record_scan", lambda *a: 1 / 0)  # slides, decks and index are written by then
    with pytest.raises(ZeroDivisionError):
        lib.scan()
    again = Library(spark, lib.path)
    assert again.store.version == before and again.slides().where("title = 'half way'").count() == 0 and found(again, "half") == []
    monkeypatch.undo()
    assert lib.scan()["indexed"] == 1 and found(lib, "half") == ["half way"]


def test_a_favorite_writes_one_file(spark, lib):
    ids = [r.id for r in lib.slides().orderBy("id").limit(4).collect()]
    for i in ids[:3]:
        lib.toggle_slide_favorite(i)
    root = f"{lib.path}/slide_favorites"
    count = lambda: sum(f.startswith("part-") for _, _, fs in os.walk(root) for f in fs)
    n, whole = count(), {t: lib.store._entry(t) for t in ("slides", "decks", "segments")}
    assert lib.toggle_slide_favorite(ids[3]) and count() == n + 1
    assert not lib.toggle_slide_favorite(ids[0]) and count() == n + 2
    assert all(lib.store._entry(t) == e for t, e in whole.items())
    assert sorted(r.id for r in lib.slides().where("favorite").collect()) == sorted(ids[1:])


def test_batches_of_paths_and_roots_with_a_scheme(spark, lib):
    files = scan.files(spark, f"file://{lib.base}/decks").where(scan.is_deck(F.col("path")))
    assert {r.relative for r in files.collect()} == {os.path.relpath(os.path.join(d, f), lib.base / "decks") for d, _, fs in os.walk(lib.base / "decks") for f in fs}
    some = files.where(~F.col("path").contains("d1"))
    frames = list(scan.contents(spark, str(lib.base / "decks"), some, 1000, batch=9))
    assert [len(f.inputFiles()) for f in frames] == [9, 9, 9, 3]
    assert {r.path for f in frames for r in f.collect()} == {r.path for r in some.collect()}
    whole, = scan.contents(spark, str(lib.base / "decks"), some, 31)
    assert {r.path for r in whole.collect()} == {r.path for r in some.collect()}


@pytest.mark.parametrize("q", ["topic1 shared", "t OR third NOT topic3", 'title:"shared words"', "zzz"])
def test_index_equals_postings_made_anew(spark, lib, q):
    """Through segments with dead slides, and again once they are merged."""
    deck_names = lib.table("decks").select(F.col("id").alias("deck_id"), F.concat_ws(" ", "title", "file_name").alias("deck_title"))
    rows = lib.table("slides").select("deck_id", F.col("id").alias("slide_id"), "title", F.col("body_text").alias("body"), "notes").join(deck_names, "deck_id")
    parsed = query_parser.parse(q)
    if q == "zzz":
        lib.index.merge()
    want = {r.slide_id: round(r.score, 9) for r in fulltext.match(fulltext.postings(rows), fulltext.lengths(rows), parsed).collect()}
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    assert {r.slide_id: round(r.score, 9) for r in lib.index.matches(parsed).collect()} == want
    assert [(r.slide_id, round(r.score, 9)) for r in lib.index.top(parsed, 3).collect()] == best[:3]
    if q == "zzz":
        assert found(lib, "shared") and found(lib, "zzz") == []


def test_block_maxima_rule_chunks_out(spark, tmp_path, monkeypatch):
    """A rare term reads few postings; a common one reads only chunks whose bound reaches the k-th score."""
    monkeypatch.setattr(segments, "CHUNK", 20)
    monkeypatch.setattr(segments, "FIRST", 2)
    lib = Library(spark, str(tmp_path / "lib"))
    rows = [(i, i, "common " * (30 if i == 77 else 1), "common filler " * (1 + i % 7) + ("rare" if i % 200 == 5 else ""), None, "deck") for i in range(800)]
    df = spark.createDataFrame(rows, "deck_id long, slide_id long, title string, body string, notes string, deck_title string")
    lib.index.add(df, replaced=False)
    total = segments.decoded(lib.table("segments")).count()
    rare = query_parser.parse("rare")
    assert total / 10 > segments.decoded(lib.index.candidates(rare)).count() == 4 == lib.index.matches(rare).count()
    common, read = query_parser.parse("common"), []
    inner = segments.decoded
    monkeypatch.setattr(segments, "decoded", lambda found, places=True: read.append(found.select("chunk").distinct().count()) or inner(found, places))
    got = [r.slide_id for r in lib.index.top(common, 1).collect()]
    chunks = lib.table("segments").select("chunk").distinct().count()
    assert got == [77] and sum(read) < chunks / 2, (read, chunks)


def test_texts_are_exchanged_once(spark, tmp_path, monkeypatch):
    """No token travels alone, and a chunk of many tokens is held in parts: the index is the same."""
    monkeypatch.setattr(segments, "HELD", 60)
    ids = [-(1 << 63), (1 << 63) - 1, -5, 0, *range(7, 4000, 100)]
    rows = [(i % 4, i, None if i % 3 else f"Über word{i % 5}", f"word{i % 7} und word1 und " * (i % 6), "de", f"src{i % 2}") for i in ids] + [(1, 9, None, None, None, None)]
    df = spark.createDataFrame(rows, "deck_id long, slide_id long, title string, body string, notes string, deck_title string")
    plan = segments.blocks(df, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    lib = Library(spark, str(tmp_path / "lib"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # parts end with a batch
    lib.index.add(df, replaced=False)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = lib.table("segments")
    assert blocks.count() > blocks.select("term", "chunk").distinct().count()
    assert {(r.slide_id, r.n_tokens) for r in lib.table("lengths").collect()} == {(r.slide_id, r.n_tokens) for r in fulltext.lengths(df).collect()}
    parsed = query_parser.parse("word1 und OR deck:src1 uber")
    want = {r.slide_id: round(r.score, 9) for r in fulltext.match(fulltext.postings(df), fulltext.lengths(df), parsed).collect()}
    assert want and {r.slide_id: round(r.score, 9) for r in lib.index.matches(parsed).collect()} == want
    assert sorted(segments.decoded(blocks).select("slide_id", "col", "pos", "term").collect()) == sorted(fulltext.postings(df).collect())


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    lib = Library(spark, str(tmp_path / "lib"))
    for i in range(5):
        df = spark.createDataFrame([(i % 3, 10 * i, f"word{i}", "all", None, "deck")], "deck_id long, slide_id long, title string, body string, notes string, deck_title string")
        lib.index.add(df, replaced=i > 2)
        assert lib.index._meta()["index_segments"] <= 2
    assert sorted(r.slide_id for r in lib.index.matches(query_parser.parse("all")).collect()) == [20, 30, 40]
    lib.index.drop(spark.createDataFrame([(2,)], "deck_id long"))
    assert sorted(r.slide_id for r in lib.index.top(query_parser.parse("all"), 9).collect()) == [30, 40]


def test_library_of_an_earlier_version_opens(spark, lib, tmp_path):
    """Whole snapshots behind a pointer file, without segments or newer columns, become tables of the log."""
    old = tmp_path / "old"
    names = {}
    for name in ("roots", "decks", "slides", "tags", "meta"):
        rows = lib.table(name).drop("thumb_path") if name == "slides" else lib.table(name)
        if name == "meta":
            rows = spark.createDataFrame([("schema_version", 5)], struct("meta"))
        rows.write.parquet(str(old / name / "v1"))
        names[name] = "v1"
    (old / "_current.json").write_text(json.dumps(names))
    one = Library(spark, str(old))
    assert one.store.state["schema"] == 7 and one.store.version == 2
    assert sorted(r.title for r in one.slides().collect()) == sorted(r.title for r in lib.slides().collect())
    assert found(one, "shared") == found(lib, "shared") and len(found(one, "shared")) > 30
    assert one.scan()["indexed"] == 0 and Library(spark, str(old)).store.version == one.store.version
    one.store.set_schema(99)
    with pytest.raises(ValueError, match="newer"):
        Library(spark, str(old))


def test_a_file_for_each_supplier_in_few_folders(spark, tmp_path, monkeypatch):
    from pagelore.operators import vectors
    from pagelore.plans import testbed

    monkeypatch.setattr(vectors, "shared_folder", lambda s: str(tmp_path))
    sf = "/root/testdata/sf0.001"
    got = {(r.s_suppkey, r.content) for r in testbed.QUERIES["src9_changed_contents"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/supplier.parquet").collect()
    assert got == {(r.s_suppkey, f"{r.s_name}|{r.s_nationkey}") for r in rows if r.s_suppkey % 4 == 1}
    root, = tmp_path.glob("pagelore-suppliers-*")
    made = list(root.rglob("part-*.txt"))
    assert len(made) == len(rows) and len({f.parent for f in made}) <= 4
