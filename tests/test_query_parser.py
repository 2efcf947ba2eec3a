"""The query language: sequences of tokens made from the grammar, and what they mean to a small evaluator of their own."""

import itertools
import random

import pytest

from pagelore.plans.query_parser import parse, parse_date, plain

WORDS = ["ferry", "soup", "lamp", "ferry boat"]
SLIDES = [dict(zip(("title", "body"), t)) for t in itertools.product(["", "ferry", "soup lamp", "boat"], ["", "ferry boat", "lamp", "soup ferry"])]


def holds(slide, words, column):
    """Whether the words follow each other in the column, or in any, the last one perhaps only begun."""
    for name, text in slide.items():
        have = text.split()
        want = words.split()
        for i in range(len(have) - len(want) + 1):
            if column in (None, name) and have[i : i + len(want) - 1] == want[:-1] and have[i + len(want) - 1].startswith(want[-1]):
                return True
    return False


def meant(tokens, slide):
    """Alternatives of lists of (wanted, words, column); one without a wanted term says nothing."""
    groups = [list(g) for is_or, g in itertools.groupby(tokens, lambda t: t == "OR") if not is_or]
    real = [g for g in groups if any(t[0] for t in g)]
    return any(all(holds(slide, w, c) == wanted for wanted, w, c in g) for g in real)


def written(token, r):
    if token == "OR":
        return "OR"
    wanted, words, column = token
    text = f'"{words}"' if " " in words or r.random() < 0.3 else words
    text = f"{column}:{text}" if column else text
    return text if wanted else r.choice(["-", "NOT "]) + text


def evaluated(parsed, slide):
    return any(all(holds(slide, t.text, t.column) for t in g.required) and not any(holds(slide, t.text, t.column) for t in g.excluded) for g in parsed.groups)


@pytest.mark.parametrize("seed", range(60))
def test_sequences_of_the_grammar(seed):
    r = random.Random(seed)
    tokens = ["OR" if r.random() < 0.2 else (r.random() < 0.7, r.choice(WORDS), r.choice([None, None, "title", "body"])) for _ in range(r.randrange(1, 8))]
    text = (" " * r.randrange(1, 3)).join(written(t, r) for t in tokens)
    parsed = parse(text)
    for slide in SLIDES:
        assert evaluated(parsed, slide) == meant(tokens, slide), (text, slide)
    assert parsed.semantic_text == " ".join(t[1] for t in tokens if t != "OR" and t[0])
    # What is shown names each wanted term as a phrase whose last word may go on.
    shown = [f"{c + ':' if c else ''}\"{w}\"*" for t in tokens if t != "OR" for wanted, w, c in [t] if wanted]
    assert (parsed.match or "").count("*") >= len(shown) and all(x in (parsed.match or "") for x in shown)


@pytest.mark.parametrize("years", [(1970, 1999), (1600, 1970), (2000, 2400)])
def test_days_count_from_1970(years):
    r = random.Random(years[0])
    for _ in range(50):
        y, m, d = r.randint(*years), r.randint(1, 12), r.randint(1, 28)
        leap = lambda x: (x % 4 == 0 and x % 100 != 0) or x % 400 == 0
        days = sum(366 if leap(x) else 365 for x in range(1970, y)) - sum(366 if leap(x) else 365 for x in range(y, 1970))
        days += sum([31, 28 + leap(y), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][: m - 1]) + d - 1
        assert parse_date(f"{y}-{m}-{d}") == days * 86_400
        got = parse(f"before:{y}-{m:02}-{d:02} lamp -after:{y}-{m}-{d} soup")
        assert (got.before, got.after) == (days * 86_400, days * 86_400) and [t.text for t in got.groups[0].required] == ["lamp", "soup"]


def test_dates_that_are_none():
    for bad in ("1999-00-01", "1999-13-01", "1999-01-00", "1999-01-32", "0-5-5", "1999-1", "x-1-1", "1999-1-1-1", ""):
        assert parse_date(bad) is None and parse(f"before:{bad}z").before is None
    assert parse_date("2001-02-30") == parse_date("2001-03-02")
    twice = parse("after:1990-01-01 after:1995-01-01 before:1999-01-01 before:1998-01-01")
    assert (twice.after, twice.before) == (parse_date("1995-01-01"), parse_date("1998-01-01")) and not twice.groups


def test_what_no_term_uses():
    assert parse("§§ lamp -soup ¿").residual == "§§ ¿" and parse("-soup").residual == ""
    assert parse("-soup").match is None and parse("§§").match is None
    assert plain("ferry_boat;lamp").match == '"ferry"* AND "boat"* AND "lamp"*'


@pytest.mark.parametrize("seed", range(30))
def test_nothing_is_an_error(seed):
    r = random.Random(seed)
    text = "".join(r.choice(list('ab "-:()*^\x00\t') + ["OR", "NOT", " NOT ", " OR ", "title:", "after:", "2020-1-1"]) for _ in range(r.randrange(12)))
    parse(text)
    plain(text)
