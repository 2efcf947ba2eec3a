import pytest

from pagelore.operators.fulltext import snippet


def body(n, **hits):
    words = [f"w{i:02d}" for i in range(n)]
    for name, places in hits.items():
        for p in places:
            words[p] = name
    return " ".join(words)


ONE = [(("hit",), None)]


@pytest.mark.parametrize(
    "text,wanted,out",
    [
        (body(30, hit=[0]), ONE, "<mark>hit</mark> " + " ".join(f"w{i:02d}" for i in range(1, 12)) + "…"),
        (body(30, hit=[15]), ONE, "…" + " ".join(f"w{i}" for i in range(10, 15)) + " <mark>hit</mark> " + " ".join(f"w{i}" for i in range(16, 22)) + "…"),
        (body(30, hit=[29]), ONE, "…" + " ".join(f"w{i}" for i in range(18, 29)) + " <mark>hit</mark>"),
        (body(12, hit=[4]), ONE, body(12, hit=[4]).replace("hit", "<mark>hit</mark>")),
        (body(13, hit=[4]), ONE, body(12, hit=[4]).replace("hit", "<mark>hit</mark>") + "…"),
        (body(30), ONE, " ".join(f"w{i:02d}" for i in range(12)) + "…"),
        ("", ONE, ""),
        ("The widget costs", [(("the", "widget"), None)], "<mark>The widget</mark> costs"),
        ("Zürich (opens)\nnow", [(("zurich",), None)], "<mark>Zürich</mark> (opens)\nnow"),
        ("hit there", [(("hit",), "title")], "hit there"),
    ],
)
def test_window(text, wanted, out):
    assert snippet(text, wanted) == out


def test_both_phrases_win():
    got = snippet(body(40, hit=[5, 30], zap=[33]), [*ONE, (("zap",), None)])
    assert got.startswith("…w26 ") and "<mark>hit</mark> w31 w32 <mark>zap</mark>" in got
