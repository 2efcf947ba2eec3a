import itertools

from pagelore import tray
from pagelore.functions.numbering import alpha, numbered, roman, shaded, with_luminance
from pagelore.operators.filters import Filters
from pagelore.plans import query_parser, saved
from pagelore.tray import Pick, Trays


def fresh():
    n = itertools.count()
    return lambda: f"t{next(n)}"


def test_trays():
    m = Trays(fresh())
    t = m.trays[m.active]
    assert t.name == "Tray 1"
    assert t.add([Pick("a", 1), Pick("a", 1), Pick("b", 2)]) == 2 and t.add([Pick("a", 1)]) == 0
    t.commit(t.items[::-1])
    t.undo()
    assert t.items[0].deck_path == "a"
    t.redo()
    assert t.items[0].deck_path == "b"
    second = m.create()
    m.create("  Own ")
    assert [x.name for x in m.trays.values()] == ["Tray 1", "Tray 2", "Own"]
    m.switch(second)
    m.delete(second)
    assert m.trays[m.active].name == "Own"
    m.reconcile({"a"})
    assert [p.moved for p in t.items] == [True, False]
    other = Trays(fresh())
    other.load(m.dump())
    assert [x.name for x in other.trays.values()] == ["Tray 1", "Own"]
    other.load("{broken")
    for k in list(other.trays):
        other.delete(k)
    assert [x.name for x in other.trays.values()] == ["Tray 1"]


def test_tray_rows(spark):
    rows = spark.createDataFrame([("t", 1, "x/a.pptx", 3, 16, 9, "h"), ("t", 2, "y/a.pptx", 3, 32, 18, "h"), ("t", 3, "b.pptx", 1, 4, 3, None), ("t", 4, "c.pptx", 1, None, 3, None)], "tray_id string, pos int, deck_path string, slide_index int, width long, height long, content_hash string")
    got = tray.mismatched(rows).orderBy("pos").collect()
    assert [(r.off_size, r.off_shape) for r in got] == [(False, False), (True, False), (True, True), (False, False)]
    assert [r.file_name for r in tray.png_names(rows).orderBy("pos").collect()] == ["a-003.png", "a-003 (2).png", "b-001.png", "c-001.png"]
    assert tray.duplicates(rows).first().n == 2


def test_numbers_and_colours():
    assert [alpha(n) for n in (1, 26, 27, 0)] == ["a", "z", "aa", "a"]
    assert [roman(n) for n in (1, 4, 9, 1994, 0)] == ["i", "iv", "ix", "mcmxciv", "i"]
    assert [numbered(k, 4) for k in ("arabicPeriod", "arabicParenBoth", "alphaUcParenR", "romanLcPeriod")] == ["4.", "(4)", "D)", "iv."]
    assert with_luminance("4472C4") == "4472C4" and shaded("804020", 0.5) == "402010" and shaded("000000", tint=0.5) == "808080"


def test_saved_scopes():
    f = Filters(deck_query=' my "deck" ', modified_from=1577836800, modified_to=1640908800)
    q = saved.as_query("revenue", f)
    assert q == 'deck:"my deck" after:2020-01-01 before:2021-12-31 revenue'
    p = query_parser.parse(q)
    assert (p.after, p.before) == (1577836800, 1640908800)
    assert saved.of_place("root", "/x") == Filters(path_prefix="/x") and saved.of_place("all") == Filters()
