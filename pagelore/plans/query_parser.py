"""The query language: terms, phrases, fields, OR / NOT, dates.

A query is words and "quoted phrases" split by blanks. ``title:``, ``body:``,
``notes:`` and ``deck:`` limit a term to a field, a leading ``-`` or NOT
excludes it, upper-case OR separates alternatives (NOT binds before AND before
OR), ``before:`` and ``after:`` bound the modification date. Every term is a
phrase whose last token may go on. No input is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

FIELDS = {"title": "title", "body": "body", "notes": "notes", "deck": "deck_title"}


@dataclass(frozen=True)
class Term:
    """A phrase of raw text, in one column or any."""

    text: str
    column: str | None = None

    def shown(self) -> str:
        quoted = '"' + self.text.replace('"', '""') + '"*'
        return f"{self.column}:{quoted}" if self.column else quoted


@dataclass
class Group:
    """Terms that must all occur, and terms that must not."""

    required: list[Term] = field(default_factory=list)
    excluded: list[Term] = field(default_factory=list)


@dataclass
class Parsed:
    groups: list[Group]
    after: int | None = None
    before: int | None = None
    #: What plain search may still use if there is no group with a required term.
    residual: str = ""
    #: What a model embeds: the text of the required terms.
    semantic_text: str = ""

    @property
    def match(self) -> str | None:
        """The groups as text, for display and tests."""
        shown = []
        for g in self.groups:
            s = " AND ".join(t.shown() for t in g.required)
            shown.append(s + "".join(f" NOT {t.shown()}" for t in g.excluded))
        if not shown:
            return None
        if len(shown) > 1:
            return " OR ".join(f"({s})" for s in shown)
        g = self.groups[0]
        if len(g.required) > 1 and g.excluded:
            return "(" + " AND ".join(t.shown() for t in g.required) + ")" + "".join(f" NOT {t.shown()}" for t in g.excluded)
        return shown[0]


def lex(text: str) -> list[str]:
    """Blank-separated tokens; blanks inside double quotes do not separate, and an open quote runs to the end."""
    return re.findall(r'(?:[^\s"]|"[^"]*(?:"|$))+', text)


def ymd_to_unix(y: int, m: int, d: int) -> int:
    """Midnight UTC; days past a month's end run over into the next."""
    return (date(y, m, 1).toordinal() - date(1970, 1, 1).toordinal() + d - 1) * 86_400


def parse_date(s: str) -> int | None:
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})", s, re.ASCII)
    if not m:
        return None
    y, mo, d = map(int, m.groups())
    return ymd_to_unix(y, mo, d) if y >= 1 and 1 <= mo <= 12 and 1 <= d <= 31 else None


def unquote(s: str) -> str:
    return s.replace('"', "")


def parse(text: str) -> Parsed:
    out = Parsed([])
    group, negate = Group(), False
    meant: list[str] = []
    junk: list[str] = []
    groups = [group]
    for raw in lex(text):
        if raw == "OR":
            group, negate = Group(), False
            groups.append(group)
            continue
        if raw == "NOT":
            negate = True
            continue
        minus = raw.startswith("-") and len(raw) > 1
        token = raw[1:] if minus else raw
        name, colon, rest = token.partition(":")
        if colon and name.lower() in ("before", "after") and (day := parse_date(unquote(rest))) is not None:
            if name.lower() == "after":
                out.after = day if out.after is None else max(out.after, day)
            else:
                out.before = day if out.before is None else min(out.before, day)
            negate = False
            continue
        column = FIELDS.get(name.lower()) if colon and '"' not in name else None
        words = unquote(rest if column else token)
        if any(c.isalnum() for c in words):
            term = Term(words.strip(), column)
            if minus or negate:
                group.excluded.append(term)
            else:
                group.required.append(term)
                meant.append(term.text)
        else:
            junk.append(raw)
            meant.append(raw)
        negate = False
    out.groups = [g for g in groups if g.required]
    out.semantic_text, out.residual = " ".join(meant), " ".join(junk)
    return out


def plain(text: str) -> Parsed:
    """Every run of letters and digits, all required, no operators."""
    words = ["".join(m) for m in re.findall(r"[^\W_]+", text)]
    return Parsed([Group([Term(w) for w in words])] if words else [], semantic_text=" ".join(words))
