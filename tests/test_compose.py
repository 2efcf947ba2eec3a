import pytest
from fixtures import deck

from pagelore.compose import compose
from pagelore.functions.scaling import Scale, compute
from pagelore.sources.opc import DeckError, Package, resolve
from pagelore.sources.pptx import Presentation, allows_harvest, classify_graphic
from pagelore.sources.scan import glob_regex

DECKS = {
    "a": deck("A", [("One", ["x"], "note", True), ("Two", ["y"], None, True)]),
    "small": deck("S", [("Small", ["z"], None, True)], size=(9144000, 5143500)),
    "narrow": deck("N", [("Narrow", ["n"], None, False)], size=(9144000, 6858000)),
}


def test_slides_come_over_in_order():
    data, report = compose([("a", 2), ("small", 1), ("a", 1), ("a", 2)], DECKS.__getitem__)
    p = Presentation.read(data)
    assert [p.content(i).title for i in range(1, 5)] == ["Two", "Small", "One", "Two"]
    assert p.content(3).notes == "note"
    assert (report.slides, report.decks) == (4, 2) and report.notes == ["small: scaled to 133%"]
    assert sum(n.startswith("ppt/media/") for n in p.package.parts) == 1  # equal images once
    assert sum(n.startswith("ppt/slideMasters/slideMaster") for n in p.package.parts) == 2  # one for each deck
    assert b'x="1200000" y="800000"' in p.package.parts[p.slides[1]] and b'sz="2400"' in p.package.parts[p.slides[1]]
    for part in [*p.slides, *[n for n in p.package.parts if "slideMasters/slideMaster" in n]]:
        for r in p.package.rels(part):
            assert resolve(part, r.target) in p.package.parts


def test_shapes_that_differ():
    _, report = compose([("a", 1), ("narrow", 1)], DECKS.__getitem__)
    assert report.warnings == ["narrow: its slides have another shape"]
    _, report = compose([("a", 1), ("narrow", 1)], DECKS.__getitem__, fit="fit")
    assert report.warnings == [] and report.notes == ["narrow: scaled to 100%"]
    with pytest.raises(DeckError):
        compose([], DECKS.__getitem__)
    with pytest.raises(DeckError):
        compose([("a", 9)], DECKS.__getitem__)


def test_hashes_follow_content():
    a, b = Presentation.read(DECKS["a"]), Presentation.read(compose([("a", 2), ("a", 1)], DECKS.__getitem__)[0])
    assert a.content_hash(1) == b.content_hash(2) != a.content_hash(2) == b.content_hash(1)


def test_small_things():
    assert compute((9144000, 5143500), (12192000, 6858000)).apply(900000) == 1200000
    assert Scale(4, 3).percent == 133 and Scale(2, 3).percent == 66
    assert allows_harvest(0) and allows_harvest(8) and not allows_harvest(2) and not allows_harvest(4)
    assert classify_graphic("http://x/drawingml/2006/chart") == "chart" and classify_graphic("q") == "unknown-shape"
    assert resolve("ppt/slides/slide1.xml", "../media/i.png") == "ppt/media/i.png" == resolve("x", "/ppt/media/i.png")
    with pytest.raises(DeckError):
        Package.read(b"PK")
    import re

    assert re.match(glob_regex("**/old/*.pptx"), "a/old/b.pptx") and re.match(glob_regex("{a,b}?.pptx"), "b1.pptx")
    assert not re.match(glob_regex("[!a]*.pptx"), "abc.pptx")
