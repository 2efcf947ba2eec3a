import unicodedata

import duckdb
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.operators import fulltext
from pagelore.plans import query_parser

SAMPLES = ["Zürich", "Ἀθῆναι καὶ Σπάρτη", "Ёлка й Ї Ўладзімір", "Tiếng Việt ở Huế", "naïve façade coöperate", "Łódź Ångström", "한국어 각", "가\u11a8 ᄀ \u1161x 힣", "ﬁn ½", "İstanbul ıI", "ǖǘ ṩ ẛ̣", "हिन्दी", "العَرَبِيَّة", "straße", ""]


def test_folded_text_equals_duckdb(spark):
    rows = [(x,) for s in SAMPLES for x in {s, unicodedata.normalize("NFD", s), s.upper()}]
    got = {r.s: r.f for r in spark.createDataFrame(rows, "s string").select("s", text.fold("s").alias("f")).collect()}
    con = duckdb.connect()
    for s, f in got.items():
        assert f == con.execute("SELECT lower(strip_accents(?))", [s]).fetchone()[0], (s, f)
        assert f == text.folded(s)


def test_every_letter_with_marks_equals_duckdb(spark):
    """All code points of the scripts in use whose decomposition holds a mark, composed and apart."""
    con = duckdb.connect()
    points = [chr(p) for p in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if unicodedata.category(chr(p)) in ("Ll", "Lt", "Lo")]
    want = {c: con.execute("SELECT lower(strip_accents(?))", [c]).fetchone()[0] for c in points}
    for form in ("NFC", "NFD"):
        df = spark.createDataFrame([(c, unicodedata.normalize(form, c)) for c in points], "c string, x string")
        wrong = [(r.c, r.f, want[r.c]) for r in df.select("c", text.fold("x").alias("f")).collect() if r.f != want[r.c]]
        assert not wrong, wrong[:9]


def test_searches_find_marked_words_whatever_their_form(spark):
    words = ["Zürich", "Αθήνα", "Ёлка", "Huế"]
    rows = [(i, unicodedata.normalize(form, f"am {w} rot")) for i, (w, form) in enumerate((w, f) for w in words for f in ("NFC", "NFD"))]
    df = spark.createDataFrame([(i, None, t, None, None) for i, t in rows], "slide_id long, title string, body string, notes string, deck_title string")
    for n, w in enumerate(words):
        for q in {w, unicodedata.normalize("NFD", w), text.folded(w)}:
            p = query_parser.parse(q)
            found = fulltext.match(fulltext.postings(df), fulltext.lengths(df), p)
            assert sorted(r.slide_id for r in found.collect()) == [2 * n, 2 * n + 1]
            shown = [fulltext.snippet(t, fulltext.phrases(p)) for _, t in rows[2 * n : 2 * n + 2]]
            assert shown == [f"am <mark>{unicodedata.normalize(f, w)}</mark> rot" for f in ("NFC", "NFD")]
    assert df.select(F.size(text.tokens("body")).alias("n")).distinct().collect()[0].n == 3


def test_sizes_are_rounded_as_printf_does(spark):
    """Halves go to the even tenth, and nothing is rounded twice."""
    sizes = [0, 1023, 1024, 1280, 1331, 1792, 10496, 10752, 61286, 1048575, 1048576, 1310720, 1835008, 5 << 28, 7 << 38, (1 << 40) + 1]
    got = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(text.human_bytes("n").alias("s")).collect()]
    units = [(1024**i, u) for i, u in enumerate(("KiB", "MiB", "GiB", "TiB"), 1)]
    assert got == [next((f"{n / one:.1f} {u}" for one, u in reversed(units) if n >= one), f"{n} B") for n in sizes]
