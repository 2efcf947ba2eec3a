import json
import os

import pytest
from fixtures import deck, two_decks

from pagelore.__main__ import main
from pagelore.library import Library, LibraryError
from pagelore.operators.filters import Filters
from pagelore.operators.vectors import FakeEmbedder


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("lib")
    two_decks(base / "decks")
    (base / "decks" / "node_modules").mkdir()
    (base / "decks" / "node_modules" / "x.pptx").write_bytes(deck("no", [("no", [], None, False)]))
    (base / "decks" / "~$lock.pptx").write_bytes(b"lock")
    (base / "decks" / "broken.pptx").write_bytes(b"not a zip")
    one = Library(spark, str(base / "tables"), FakeEmbedder(32))
    root = one.add_root(str(base / "decks"))
    assert one.add_root(str(base / "decks")) == root
    events = []
    got = one.scan(events.append)
    assert (got["indexed"], got["skipped"], got["removed"]) == (2, 1, 0)
    assert [e["kind"] for e in events] == ["started", "skipped", "finished"]
    one.base = base
    return one


def ids(df):
    return [r.slide_id for r in df.collect()]


def titles(lib, df):
    by = {r.id: r.title for r in lib.slides().collect()}
    return [by[i] for i in ids(df)]


def test_rescan_changes_nothing(lib):
    got = lib.scan()
    assert (got["indexed"], got["unchanged"], got["removed"]) == (0, 2, 0)


def test_records(lib):
    assert sorted((r.title, r.author) for r in lib.decks().collect()) == [("Fleet Handbook", "P. Lindqvist"), ("Kitchen Rota", None)]
    s = {r.title: r for r in lib.slides().collect()}
    assert s["Ferry Timetable"].body_text == "Ferry Timetable\nIsland line at noon\nNight boat on Fridays\nNo boat in storms"
    assert s["Ferry Timetable"].notes == "Ask the skipper about storms" and s[None].body_text == "Spare ropes\nSpare lamps"
    assert s["Crew"].notes is None and not s["Crew"].favorite
    with pytest.raises(LibraryError):
        lib.slide(1)


def test_search(lib):
    soups = {"Monday soup", "Friday soup"}
    assert titles(lib, lib.search("skipper")) == ["Ferry Timetable"] and titles(lib, lib.search("notes:ropes")) == [None]
    assert titles(lib, lib.search("jorgen")) == titles(lib, lib.search("Jo\u0308rgen")) == ["Crew"]
    assert set(titles(lib, lib.search("title:soup"))) == soups and titles(lib, lib.search("body:barl")) == ["Friday soup"]
    assert set(titles(lib, lib.search("deck:fleet"))) == {"Ferry Timetable", "Crew", None}
    assert set(titles(lib, lib.search("lentil OR steers"))) == {"Friday soup", "Crew"}
    assert titles(lib, lib.search("deck:kitchen NOT friday")) == ["Monday soup"] and titles(lib, lib.search('"no boat"')) == ["Ferry Timetable"]
    assert titles(lib, lib.search("soup before:2001-01-01")) == []
    assert len(ids(lib.search(""))) == len(ids(lib.search("-soup"))) == len(ids(lib.search("%%% ;;;"))) == 5
    assert "<mark>Island</mark> line" in lib.search("island").first().snippet
    assert len(ids(lib.search("", Filters(deck_query="KITCHEN")))) == 2
    for q in ['"', "NOT", "title:", "a OR", "((", "NEAR(", '"x', "-"]:
        lib.search(q).collect()


def test_vectors(lib):
    assert lib.embed_missing() == 5 and lib.embed_missing() == 0
    assert lib.embedding_counts().first().embedded == 5
    text = lib.pending_texts().collect()
    assert text == []
    assert lib.cleanup_orphan_embeddings() == 0
    crew = next(r.id for r in lib.slides().collect() if r.title == "Crew")
    got = lib._vector_pool("Crew\nCrew\nJörgen steers", Filters(), 5).collect()
    assert [r.slide_id for r in got] == [crew] and got[0].score > 0.999
    assert titles(lib, lib.search("lentil", Filters(mode="hybrid"))) == ["Friday soup"]
    assert lib.similar(crew).collect() == []


def test_favorites_tags_and_saved(lib):
    s = {r.title: r.id for r in lib.slides().collect()}
    assert lib.toggle_slide_favorite(s["Crew"]) is True
    assert titles(lib, lib.search("", Filters(favorites_only=True))) == ["Crew"]
    assert lib.toggle_slide_favorite(s["Crew"]) is False
    lib.set_slide_tags(s["Monday soup"], [" Plan ", "plan", "", "Next"])
    assert [(r.name, r.n_slides) for r in lib.tags().collect()] == [("Next", 1), ("Plan", 1)]
    tag = {r.name: r.id for r in lib.tags().collect()}
    with pytest.raises(LibraryError):
        lib.rename_tag(tag["Next"], "PLAN")
    lib.set_slide_tags(s["Monday soup"], ["PLAN"])
    assert [r.name for r in lib.slide_tags(s["Monday soup"]).collect()] == ["Plan"]
    assert titles(lib, lib.search("", Filters(tag_id=tag["Plan"]))) == ["Monday soup"]
    lib.save_search("mine", "soup", Filters(deck_query="x"))
    row = lib.saved_searches().first()
    assert (row.name, row.position, row.filters.deck_query) == ("mine", 0, "x")
    lib.delete_saved_search(row.id)


def test_histories(lib):
    clock = iter([1000, 1010, 1020, 5000])
    lib.now = lambda: next(clock)
    for q in ("sou", "soup", "  "):
        lib.record_search(q, 1)
    lib.record_search("ropes", 2)
    assert [r.query for r in lib.table("search_history").orderBy("id").collect()] == ["soup", "ropes"]
    lib.now = lambda: 9000
    lib.record_export("menu.pptx", "t", [("kitchen", 2)])
    lib.record_export("all.pptx", "t", [("fleet", i) for i in (3, 1, 2)] + [("kitchen", 1), ("kitchen", 2)])
    assert {r.deck_path: r.n_exports for r in lib.export_counts().collect()} == {"fleet": 3, "kitchen": 3}
    lib.record_render_issues("p", 1, "h", ["chart", "chart"])
    assert lib.render_issues_for("p", 1, "h") == ["chart"] and lib.render_issues_for("p", 1, "x") == []
    o = lib.stats_overview().first()
    assert (o.decks, o.slides) == (2, 5) and [e.source_decks for e in o.recent_exports] == [2, 1] and len(o.issues) == 1


def test_duplicates(spark, tmp_path):
    """Three copies of one slide and two of another, in three decks; a deck that vanishes takes its copies along."""
    d = tmp_path / "d"
    d.mkdir()
    rule, map_ = ("House rule", ["Shoes off"], None, False), ("Map", ["North is up"], "turn it", False)
    (d / "hall.pptx").write_bytes(deck("Hall", [rule, map_]))
    (d / "porch.pptx").write_bytes(deck("Porch", [("Welcome", [], None, False), rule, rule]))
    (d / "attic.pptx").write_bytes(deck("Attic", [map_]))
    lib = Library(spark, str(tmp_path / "t"), FakeEmbedder(32))
    lib.add_root(str(d))
    lib.scan()
    lib.embed_missing()
    rows = lib.duplicate_groups().collect()
    assert [(r.kind, r.n, {m.title for m in r.members}) for r in rows] == [("exact", 3, {"House rule"}), ("exact", 2, {"Map"})]
    os.remove(d / "porch.pptx")
    assert lib.scan()["removed"] == 1
    assert [(r.n, {m.title for m in r.members}) for r in lib.duplicate_groups().collect()] == [(2, {"Map"})]
    lib.clear()
    assert lib.table("slides").count() == 0 and lib.roots().count() == 1 and lib.table("embeddings").count() == 2


def test_excludes(lib):
    root = lib.roots().first().id
    with pytest.raises(LibraryError):
        lib.set_root_excludes(root, ["ok*", "[bad"])
    assert lib.roots().first().exclude_globs == []
    lib.set_root_excludes(root, [" fleet* ", ""])
    assert lib.scan()["removed"] == 1
    lib.set_root_excludes(root, [])
    assert lib.scan()["indexed"] == 1


def test_command_line(spark, lib, tmp_path, capsys):
    decks, tables = str(lib.base / "decks"), str(tmp_path / "cli")
    assert main(["index", decks, "--library", tables], spark) == 0
    capsys.readouterr()
    assert main(["search", "skipper", "--library", tables, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["title"] == "Ferry Timetable"
    assert main(["stats", "--library", tables], spark) == 0
    assert main(["stats", "--library", str(tmp_path / "none")], spark) == 1
    assert main(["nonsense"], spark) == 2
    out = str(tmp_path / "new.pptx")
    assert main(["compose", f"{decks}/fleet.pptx:1", f"{decks}/kitchen.pptx:1", "--out", out]) == 0
    assert main(["compose", "nonsense", "--out", out]) == 2
